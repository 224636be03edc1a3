"""Is recognised text usable? Gates over observations and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import collapse_ws, common_prefix, fold_caption, is_blank


def caption_line(centred: bool = True) -> Column:
    """The observation may be a caption line: readable, tall enough, below the overlays, around the middle."""
    top, left, right = (0.76, 0.3, 0.7) if centred else (1.0, 0.0, 1.0)
    c = F.col
    ok = (c("confidence") >= 0.3) & (c("height") >= 0.018) & (c("y") <= top) & (c("x") <= right) & (c("x") + c("width") >= left)
    return F.coalesce(~is_blank(c("text")) & ok & ~F.isnan("confidence") & (F.length(fold_caption(c("text"))) >= 2), F.lit(False))


def frame_captions(observations: DataFrame) -> DataFrame:
    """(source_key, frame_ordinal, timestamp_seconds, text, confidence): the caption of each frame, empty with 0 where no
    line passes. Lines go from top to bottom, then from left to right, ties by id; a frame holds few."""
    o = observations.dropDuplicates(["observation_id"]).withColumn("ok", caption_line())
    line = F.when(F.col("ok"), F.struct((-F.col("y")).alias("y"), "x", "observation_id", collapse_ws(F.col("text")).alias("text")))
    g = o.groupBy("source_key", "frame_ordinal").agg(
        F.max("timestamp_seconds").alias("timestamp_seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), " ").alias("text"), F.avg(F.when(F.col("ok"), F.col("confidence"))).alias("confidence")
    )
    return g.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def repeated_label(texts: DataFrame, key: str) -> DataFrame:
    """(key, label): five or more texts that are one label with short changing ends.

    The common prefix of all texts is that of the least and the greatest; both come from one aggregate, the rest from the
    lengths.
    """
    g = texts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("lo"), F.max("norm").alias("hi"), F.min(F.length("norm")).alias("short"), F.max(F.length("norm")).alias("long"))
    p = F.length(common_prefix(F.col("lo"), F.col("hi")))
    label = (F.col("n") >= 5) & (p >= 6) & (p >= 0.7 * F.col("long")) & (F.col("long") - p <= 6)
    return g.select(key, label.alias("label"))


def usable() -> Column:
    """Policy over (n, kinds, chars, covered_ms, duration_ms, label): may the text stand for the medium's speech?"""
    c, d = F.col, F.coalesce(F.col("duration_ms"), F.lit(0))
    least = F.greatest(F.lit(60), F.bround(d / 60_000 * 15, 0))
    return (
        F.when(c("n") == 0, False)
        .when((d > 0) & (c("chars") * 1000 > 30 * d), False)
        .when(c("label"), False)
        .when(d <= 10_000, c("chars") >= 4)
        .when(d <= 30_000, (c("n") >= 2) & (c("kinds") >= 2) & (c("chars") >= 12) & (c("covered_ms") >= 0.2 * d))
        .otherwise((c("n") >= 5) & (c("chars") >= least) & (c("kinds") >= 0.4 * c("n")) & (c("covered_ms") >= 0.35 * d))
    )
