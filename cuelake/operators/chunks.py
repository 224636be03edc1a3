"""Fixed windows over long media and what recognisers return for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import collapse_ws, is_blank
from cuelake.functions.times import finite
from cuelake.operators.sequences import running

#: A medium with more windows than this has none but a row with an error.
MOST_WINDOWS = 1_000_000


def chunk_windows(media: DataFrame, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """(media, chunk, ws, we, error): overlapping windows of a fixed length over [0, duration_ms], the last one cut.

    Media without a duration above 0 have none. A medium of more than MOST_WINDOWS, whose duration can only be corrupt, is
    one row with an error and no window; it fails nothing else.
    """
    if not 0 <= overlap_ms < chunk_ms:
        raise ValueError("0 <= overlap < chunk")
    stride = chunk_ms - overlap_ms
    more = F.greatest(F.ceil((F.col("duration_ms") - chunk_ms) / stride), F.lit(0))
    few = F.col("duration_ms") / stride < MOST_WINDOWS
    chunks = F.when(few, F.sequence(F.lit(0).cast("bigint"), F.when(few, more).otherwise(F.lit(0).cast("bigint")))).otherwise(F.array(F.lit(None).cast("bigint")))
    w = media.where("duration_ms > 0").select("media", "duration_ms", F.explode(chunks).alias("chunk"))
    end = F.when(F.col("chunk").isNotNull(), F.least("duration_ms", F.col("chunk") * stride + chunk_ms))
    return w.select("media", "chunk", (F.col("chunk") * stride).alias("ws"), end.alias("we"), F.when(F.col("chunk").isNull(), "too many windows").alias("error"))


def in_windows(cues: DataFrame, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """``cues`` (media, duration_ms, s, e, ...) once for every window of ``chunk_windows`` they reach into: chunk, ws, we.

    The numbers of these windows follow from the times alone, so that no window is ever a row of a join: Spark takes what
    an ``explode`` makes for as small as what it was made from, and would send all windows to the driver as a broadcast.
    """
    stride = chunk_ms - overlap_ms
    sound = cues.where((F.col("duration_ms") > 0) & (F.col("duration_ms") / stride < MOST_WINDOWS) & (F.col("s") < F.col("duration_ms")) & (F.col("s") >= 0) & (F.col("e") >= F.col("s")))
    last = F.greatest(F.ceil((F.col("duration_ms") - chunk_ms) / stride), F.lit(0))
    first_met = F.greatest(F.floor((F.col("s") - chunk_ms) / stride) + 1, F.lit(0))
    last_met = F.least(last, F.ceil(F.least("e", "duration_ms") / stride) - 1)
    met = sound.withColumn("chunk", F.explode(F.when(first_met <= last_met, F.sequence(first_met, last_met))))
    ws = F.col("chunk") * stride
    return met.withColumns({"ws": ws, "we": F.least("duration_ms", ws + chunk_ms)}).drop("duration_ms")


def rebase(results: DataFrame) -> DataFrame:
    """Recogniser cues (ws, we, s, e, ... local to a window) on the clock of the medium; those that start past it go."""
    length = F.col("we") - F.col("ws")
    kept = results.where(F.col("s") < length)
    return kept.withColumn("e", F.col("ws") + F.least("e", length)).withColumn("s", F.col("ws") + F.least("s", length))


def normal_speech(raw: DataFrame, key: str) -> DataFrame:
    """Raw recogniser rows (key, index, start, end, text): blank, invalid and non-finite ones go, starts are at least 0,
    ends at least starts; ``place`` numbers a window's rows by start, then index."""
    ok = raw.where(~is_blank(F.col("text")) & finite(F.col("start")) & finite(F.col("end")))
    ok = ok.withColumn("text", collapse_ws(F.col("text"))).withColumn("start", F.greatest(F.lit(0.0), "start")).withColumn("end", F.greatest("start", "end"))
    placed = running(ok.withColumn("_b", F.floor(F.col("start") / 600)), [key], "_b", ["start", "index"], F.lit(1), "sum", "_n")
    return placed.withColumn("place", F.col("_n") + 1).drop("_b", "_n")
