"""Joins on intervals: by key and bucket of time, so that a long timeline isn't one task and no pairs are tried in vain.

Intervals have a level by their length: a bucket of a level is 64 times as long as one of the level below, and an interval
touches at most 65 buckets of its own level, however long it is. Intervals of one level meet in its buckets. Those of
different levels meet in the buckets of the longer one's level, into which the shorter ones are put only if there are
longer ones at all. Without outsized intervals all of them are of level 0 and stand in their own buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of a bucket of level 0: cues are much shorter, so that most stand in one or two.
BUCKET_MS = 60_000
#: Buckets of its level that an interval touches at most, less one; levels that times of 64 bits can need.
SPAN, LEVELS = 64, 8


def _sizes(bucket_ms: int) -> list[int]:
    return [bucket_ms * SPAN**k for k in range(LEVELS)]


def _bucket(at: Column, size: Column) -> Column:
    return F.floor(at / size)


def _level(start: Column, end: Column, bucket_ms: int) -> Column:
    return sum(((end - start > SPAN * size - size).cast("int") for size in _sizes(bucket_ms)[:-1]), F.lit(0))


def placed(df: DataFrame, start: str, end: str, others: DataFrame, o_start: str, o_end: str, left: bool, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """``df`` once for every place ``_at`` (level, bucket, role) at which it may meet one of ``others``.

    Equal levels meet as 'equal'. A longer interval meets shorter ones as 'left' or 'right', by the side it is on; shorter
    ones take that role in the buckets of every level above their own at which the other side has intervals. Which levels
    these are, eight at most, comes from an aggregate of one row. Rows that end before they start, or lack a time, go.
    """
    there = others.where(F.col(o_start) <= F.col(o_end)).select(_level(F.col(o_start), F.col(o_end), bucket_ms).alias("l")).where("l > 0").agg(F.collect_set("l").alias("l")).scalar()
    rows = df.where(F.col(start) <= F.col(end)).withColumn("_level", _level(F.col(start), F.col(end), bucket_ms)).withColumn("_there", there)
    sizes = F.array(*[F.lit(s).cast("bigint") for s in _sizes(bucket_ms)])
    mine, theirs = ("left", "right") if left else ("right", "left")

    def at(level: Column, role: str) -> Column:
        size = F.element_at(sizes, level + 1)
        return F.transform(F.sequence(_bucket(F.col(start), size), _bucket(F.col(end), size)), lambda b: F.struct(level.alias("level"), b.alias("bucket"), F.lit(role).alias("role")))

    own = at(F.col("_level"), "equal")
    longer = F.when(F.col("_level") > 0, at(F.col("_level"), mine)).otherwise(F.filter(own, lambda x: F.lit(False)))
    raised = F.flatten(F.transform(F.filter("_there", lambda x: x > F.col("_level")), lambda x: at(x, theirs)))
    return rows.withColumn("_at", F.explode(F.concat(own, longer, raised))).drop("_level", "_there")


def _joined(left: DataFrame, right: DataFrame, key: str, ls: str, le: str, rs: str, re: str, meets: Column, how: str, bucket_ms: int) -> DataFrame:
    """Rows that share a place and satisfy ``meets``; a pair comes out once for every place they share."""
    a = placed(left, ls, le, right, rs, re, True, bucket_ms)
    b = placed(right, rs, re, left, ls, le, False, bucket_ms).withColumnsRenamed({key: "_r_key", "_at": "_r_at"})
    return a.join(b, (a[key] == b["_r_key"]) & (a["_at"] == b["_r_at"]) & meets, how).drop("_r_key", "_r_at")


def overlaps(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs with a common key whose intervals (s, e) overlap in more than a point; the right's columns get an ``r_``.

    ``os`` and ``oe`` are the bounds of the overlap. Each pair comes out once: in the bucket in which the overlap starts.
    """
    r = right.select(F.col(key), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != key])
    met = _joined(left, r, key, "s", "e", "r_s", "r_e", F.greatest("s", "r_s") < F.least("e", "r_e"), "inner", bucket_ms)
    met = met.withColumn("os", F.greatest("s", "r_s")).withColumn("oe", F.least("e", "r_e"))
    size = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in _sizes(bucket_ms)]), F.col("_at.level") + 1)
    return met.where(_bucket(F.col("os"), size) == F.col("_at.bucket")).drop("_at")


def touching(cues: DataFrame, gaps: DataFrame, key: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Cues (segment_id, s, e, ...) that touch a gap (gap_start_ms, gap_end_ms); cues without length if they lie in one."""
    g = gaps.select(key, "gap_start_ms", "gap_end_ms")
    c, gs, ge = F.col, F.col("gap_start_ms"), F.col("gap_end_ms")
    inside = (c("s") < ge) & (c("e") > gs) | ((c("s") == c("e")) & (c("s") >= gs) & (c("s") < ge))
    met = _joined(cues, g, key, "s", "e", "gap_start_ms", "gap_end_ms", inside, "left_semi", bucket_ms)
    return met.drop("_at").dropDuplicates(["segment_id"])


def same_boundary_cue(s: Column, e: Column, ps: Column, pe: Column) -> Column:
    """Equal cues of two chunks up to clock jitter: 0.8 of the shorter overlaps and the midpoints are close."""
    shorter = F.least(e - s, pe - ps)
    overlap = F.least(e, pe) - F.greatest(s, ps)
    apart = F.abs(s + e - ps - pe) / 2
    return F.when(shorter <= 0, (s == ps) & (e == pe)).otherwise((overlap >= 0.8 * shorter) & (apart <= F.greatest(F.lit(200.0), 0.2 * shorter)))


def without_boundary_copies(cues: DataFrame, key: str, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """Cues (key, chunk, ws, s, e, text, ...) without those that the chunk before has too; they lie in their windows.

    Only equal texts meet (a join on key, text and the neighbouring chunk), so that a text said a thousand times in one
    chunk pairs with its namesakes in the chunk before alone. Copies overlap, hence one starts and the other ends in what
    their windows share: texts of all other cues are not moved, and a null text has no copy. The join
    is never a broadcast: how many windows a cue reaches into is in no size that Spark estimates.
    """
    c = F.col
    before = cues.where(c("e") >= c("ws") + chunk_ms - overlap_ms)
    before = before.select(c(key).alias("p_key"), c("text").alias("p_text"), (c("chunk") + 1).alias("p_next"), c("s").alias("p_s"), c("e").alias("p_e"))
    after = cues.withColumn("_said", F.when(c("s") <= c("ws") + overlap_ms, c("text")))
    same = (after[key] == before.p_key) & (after["_said"] == before.p_text) & (after.chunk == before.p_next) & same_boundary_cue(after.s, after.e, before.p_s, before.p_e)
    return after.join(before.hint("merge"), same, "left_anti").drop("_said")


def contained(gaps: DataFrame, spans: DataFrame, key: str, tolerance_ms: int = 250, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Gaps that lie in one span each, up to a tolerance at the outer bounds; spans are never joined."""
    c, gs, ge = F.col, F.col("gap_start_ms"), F.col("gap_end_ms")
    fits = (c("s") <= gs + tolerance_ms) & (c("e") >= ge - tolerance_ms) & (F.greatest(c("s"), gs) < F.least(c("e"), ge))
    met = _joined(gaps, spans.select(key, "s", "e"), key, "gap_start_ms", "gap_end_ms", "s", "e", fits, "left_semi", bucket_ms)
    return met.drop("_at").distinct()
