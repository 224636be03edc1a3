"""Visible captions and speech of one timeline as one transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import fold_caption, without_repeats
from cuelake.operators.joins import overlaps


def merge(speech: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Both timelines (key, segment_id, s, e, text, ...), with ``branch``; speech goes where the captions say the same.

    A speech cue is dropped if captions cover 0.8 of it or more and their texts in order, repeats aside, read as it does.
    Similar texts stay: they may differ in a negation or a number. Only the captions that overlap one cue are gathered.
    """
    met = overlaps(speech, visible, key).select("segment_id", (F.col("e") - F.col("s")).alias("length"), "text", F.struct("os", "oe", "r_segment_id", fold_caption(F.col("r_text")).alias("norm")).alias("v"))
    g = met.groupBy("segment_id", "length").agg(F.first("text").alias("text"), F.sort_array(F.collect_list("v")).alias("v"))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(-1).cast("bigint").alias("reach"))

    def step(a: Column, x: Column) -> Column:
        more = F.greatest(x["oe"] - F.greatest(x["os"], a["reach"]), F.lit(0))
        return F.struct((a["total"] + more).alias("total"), F.greatest(a["reach"], x["oe"]).alias("reach"))

    covered = F.aggregate("v", start, step, lambda a: a["total"])
    said = F.array_join(without_repeats(F.transform("v", lambda x: x["norm"])), "")
    same = g.where((covered >= 0.8 * F.col("length")) & (F.col("length") > 0) & (fold_caption(F.col("text")) == said)).select("segment_id")
    kept = speech.join(same, "segment_id", "left_anti")
    return kept.withColumn("branch", F.lit("speech")).unionByName(visible.withColumn("branch", F.lit("visible")))


def upgraded_method(method: Column) -> Column:
    """How a transcript was made once speech has supplemented it."""
    return F.when(method == "platform-captions", "platform-captions-whisper").when(method == "local-captions", "local-captions-whisper").otherwise("ocr-whisper")
