"""Cues: valid rows of segments in whole milliseconds, and the folds over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions.text import collapse_ws, is_blank
from cuelake.operators.intervals import to_ms
from cuelake.operators.sequences import running, scanned
from cuelake.sources.tables import distinct_by, table


def valid_cues(segments: DataFrame) -> DataFrame:
    """(segment_id, transcript_id, ordinal, s, e, text, confidence): each segment once, if it is one.

    White space is collapsed and blank texts go; times must be finite with 0 <= s <= e; a confidence outside [0, 1] is
    unknown.
    """
    once = distinct_by(segments.where(~is_blank(F.col("text"))), "segment_id", "transcript_id", "ordinal", "start_seconds", "end_seconds", "text", "confidence")
    c = once.select(
        "segment_id", "transcript_id", "ordinal", to_ms(F.col("start_seconds")).alias("s"), to_ms(F.col("end_seconds")).alias("e"), collapse_ws(F.col("text")).alias("text"),
        F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence"),
    )
    return c.where("s >= 0 and e >= s")


def cues(spark: SparkSession, directory: str) -> DataFrame:
    return valid_cues(table(spark, directory, "segments"))


def speech_and_visible(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two timelines of one transcript for tests: every third cue is visible, the others are speech widened by 3 s."""
    visible = c.where("ordinal % 3 = 0")
    speech = c.where("ordinal % 3 <> 0").withColumn("s", F.greatest(F.col("s") - 3000, F.lit(0))).withColumn("e", F.col("e") + 3000)
    return speech, visible


ROLLED = "transcript_id bigint, s bigint, e bigint, text string"


def merge_rolling(c: DataFrame, slack_ms: int = 500, block_ms: int = 600_000) -> DataFrame:
    """(transcript_id, s, e, text): rolling captions as one cue each.

    A cue that starts at most ``slack_ms`` after the previous merged cue's end and equals it, extends it, or is a beginning
    of it, is merged with it, in order of start, end and ordinal. A merged text is the longest of its cues and all others
    are beginnings of it, so where neither of two neighbours begins the other nothing can merge: there, and at gaps, the
    sequence is cut. Single cues stay as they are; only longer stretches are folded, as streams of sorted rows. Confidence
    doesn't outlive a merge and is left out.
    """
    order = ["s", "e", "ordinal", "segment_id"]
    rows = c.select("transcript_id", *order, "text").withColumn("_b", F.floor(F.col("s") / block_ms))
    seen = scanned(rows, ["transcript_id"], "_b", order, {"_reach": (F.col("e"), "max")}, {"before": "text"})
    goes_on = (F.col("s") <= F.col("_reach") + slack_ms) & (F.startswith(F.col("text"), F.col("before")) | F.startswith(F.col("before"), F.col("text")))
    cut = seen.withColumn("_cut", (~F.coalesce(goes_on, F.lit(False))).cast("bigint"))
    grouped = running(cut, ["transcript_id"], "_b", order, F.col("_cut"), "sum", "_n").withColumn("stretch", F.col("_n") + F.col("_cut"))
    counted = grouped.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("transcript_id", "stretch")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, merged = None, None
        for b in batches:
            out = []
            for t, stretch, s, e, text in zip(b["transcript_id"], b["stretch"], b["s"], b["e"], b["text"]):
                if merged and key == (t, stretch) and s <= merged[2] + slack_ms and (text.startswith(merged[3]) or merged[3].startswith(text)):
                    merged = (t, merged[1], max(merged[2], e), max(merged[3], text, key=len))
                    continue
                if merged:
                    out.append(merged)
                key, merged = (t, stretch), (t, s, e, text)
            yield pd.DataFrame(out, columns=["transcript_id", "s", "e", "text"])
        yield pd.DataFrame([merged] if merged else [], columns=["transcript_id", "s", "e", "text"])

    several = counted.where("n > 1").sortWithinPartitions("transcript_id", "stretch", *order).select("transcript_id", "stretch", "s", "e", "text")
    return counted.where("n = 1").select("transcript_id", "s", "e", "text").unionByName(several.mapInPandas(fold, ROLLED))
