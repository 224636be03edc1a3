"""What to do about the gaps of captions, and which method a transcript comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.plans.hybrid import upgraded_method


def verified(captions: DataFrame, gaps: DataFrame, activity: DataFrame, speech: DataFrame) -> DataFrame:
    """(transcript_id, gaps, supplements, state, method, note): captions after their long gaps were looked into.

    ``captions``: (transcript_id, method); ``gaps``: (transcript_id, ...) one row per long gap; ``activity``: (transcript_id,
    activity); ``speech``: (transcript_id, supplements), null where recognition failed. Silent gaps are noted and kept.
    Otherwise speech that touches gaps supplements the captions and upgrades the method. Whatever fails, captions stay:
    they are pending then. Each of the inputs is one row per transcript but the gaps, which are counted first.
    """
    n = gaps.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("gaps"))
    heard = speech.select("transcript_id", "supplements", F.lit(True).alias("tried"))
    j = captions.join(n, "transcript_id", "left").join(activity.select("transcript_id", "activity"), "transcript_id", "left").join(heard, "transcript_id", "left")
    state = (
        F.when(F.col("gaps").isNull(), "complete").when(F.col("activity") == "silent", "complete").when(F.col("tried").isNotNull() & F.col("supplements").isNull(), "pending")
        .when(F.coalesce("supplements", F.lit(0)) > 0, "supplemented").otherwise("reviewed")
    )
    j = j.withColumn("state", state)
    note = F.when(F.col("gaps").isNotNull() & (F.col("activity") == "silent"), "long gaps are silent").when(F.col("state") == "pending", "speech could not be checked").when(F.col("state") == "reviewed", "long gaps need review")
    return j.select(
        "transcript_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("supplements", F.lit(0)).alias("supplements"), "state",
        F.when(F.col("state") == "supplemented", upgraded_method(F.col("method"))).otherwise(F.col("method")).alias("method"), note.alias("note"),
    )


def with_fetch(outcome: DataFrame, fetched: DataFrame) -> DataFrame:
    """``verified`` rows where sound was fetched for the check only: without it (``fetched`` false or missing) transcripts with
    gaps keep their captions and are pending, however the check would have ended."""
    j = outcome.join(fetched.select("transcript_id", "fetched"), "transcript_id", "left")
    failed = (F.col("gaps") > 0) & ~F.coalesce("fetched", F.lit(False))
    return j.select("transcript_id", F.when(failed, "pending").otherwise(F.col("state")).alias("state"), (failed | (F.col("state") == "pending")).alias("pending"))


def acquired(requests: DataFrame) -> DataFrame:
    """(source_key, mode, method, warning, error): captions, then text on screen, then speech; forced modes never switch.

    ``requests``: (source_key, mode, audio_only, captions, ocr) with captions true where usable ones are there, ocr one of
    'usable', 'unusable' and 'failed'.
    """
    mode, sound, ocr = F.col("mode"), F.coalesce("audio_only", F.lit(False)), F.coalesce("ocr", F.lit("unusable"))
    captions = F.coalesce("captions", F.lit(False)) & mode.isin("auto", "captions")
    error = (
        F.when(captions, F.lit(None).cast("string")).when(mode == "captions", "no usable captions").when(sound & mode.isin("ocr", "hybrid"), "sound alone has no text to read")
        .when((mode == "ocr") & (ocr == "failed"), "reading failed").when((mode == "ocr") & (ocr == "unusable"), "no usable text on screen")
    )
    speech_alone = (mode == "whisper") | sound
    method = F.when(captions, "captions").when(speech_alone, "whisper").when((ocr == "usable") & (mode == "hybrid"), "ocr-whisper").when(ocr == "usable", "ocr").otherwise("whisper")
    warning = F.when(~captions & ~speech_alone & (ocr != "usable"), F.when(ocr == "failed", "reading failed, speech was used").otherwise("text on screen was unusable, speech was used"))
    return requests.select("source_key", "mode", F.when(error.isNull(), method).alias("method"), F.when(error.isNull(), warning).alias("warning"), error.alias("error"))


def ready(checks: DataFrame, by: str) -> DataFrame:
    """(by, ready, failing): ready if every required check (by, name, required, ok) is ok; what fails, by name."""
    g = checks.groupBy(by).agg(F.coalesce(F.bool_and(F.when(F.col("required"), F.coalesce("ok", F.lit(False)))), F.lit(True)).alias("ready"), F.collect_set(F.when(F.col("required") & ~F.coalesce("ok", F.lit(False)), F.col("name"))).alias("f"))
    return g.select(by, "ready", F.array_join(F.array_sort("f"), ",").alias("failing"))


def paired(left: Column, right: Column) -> Column:
    """Two arrays element by element as (left, right) structs; null where their lengths differ."""
    return F.when(F.size(left) == F.size(right), F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right"))))
