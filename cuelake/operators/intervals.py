"""Unions and complements of intervals per key, as a mergeable aggregate.

State: for a key and a bucket of time, the sorted list of disjoint intervals that start in the bucket. Lists
combine by a linear merge, so the union is built as a reduction tree: every input partition first folds its
own rows (map side), the partial lists are shuffled by (key, bucket) and merged there, and a window over the
few bucket summaries of a key carries the furthest end across buckets. No task ever holds all rows of a key:
a key with a third of all rows is spread over its buckets, and what is shuffled are lists, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.joins import overlaps

#: Milliseconds of start time that one partial list spans.
BUCKET_MS = 3_600_000
#: Rows that the map side folds at once; bounds the memory of a task.
FOLD_ROWS = 500_000
#: Finite times beyond this are clipped, so that milliseconds fit in 64 bits.
LAST_MS = 9_000_000_000_000_000

STATE = "key bigint, bucket bigint, starts array<bigint>, ends array<bigint>"


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds (half up); null where the time is null, NaN or infinite."""
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    bounded = F.greatest(F.least(seconds * 1000, F.lit(float(LAST_MS))), F.lit(-float(LAST_MS)))
    return F.when(finite, F.round(bounded).cast("bigint"))


def from_zero(ms: Column) -> Column:
    """Times before the start of the media are its start; null stays null (``greatest`` alone would skip it)."""
    return F.when(ms >= 0, ms).when(ms < 0, F.lit(0).cast("bigint"))


def linear_merge(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted disjoint intervals of each group; touching intervals become one.

    ``group`` holds small non-negative codes. Running maxima are taken over ranks of the ends, with the group as the
    high digits, so that one pass serves all groups.
    """
    if not len(start):
        return group, start, end
    order = np.lexsort((end, start, group))
    g, s, e = group[order], start[order], end[order]
    levels, rank = np.unique(e, return_inverse=True)
    width = len(levels)
    furthest = np.maximum.accumulate(rank + g.astype(np.int64) * width)
    reach = levels[furthest % width]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(s)) - 1
    return g[first], s[first], reach[last]


class IntervalFold:
    """The aggregate's state for many (key, bucket) groups at once."""

    def __init__(self, bucket_ms: int) -> None:
        self.bucket_ms, self.parts, self.size = bucket_ms, [], 0

    def add(self, key: np.ndarray, bucket: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.parts.append((key, bucket, start, end))
        self.size += len(key)

    def combine(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.empty(0, np.int64),) * 4
        key, bucket, start, end = (np.concatenate(x) for x in zip(*self.parts))
        pairs, code = np.unique(np.stack([key, bucket]), axis=1, return_inverse=True)
        g, s, e = linear_merge(code.reshape(-1), start, end)
        merged = pairs[0][g], pairs[1][g], s, e
        self.parts, self.size = [merged], len(s)
        return merged

    def emit(self) -> Iterator[pa.RecordBatch]:
        key, bucket, start, end = self.combine()
        self.parts, self.size = [], 0
        if not len(key):
            return
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
        offsets = pa.array(np.append(cut, len(key)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[cut]), pa.array(bucket[cut]), pa.ListArray.from_arrays(offsets, pa.array(start)), pa.ListArray.from_arrays(offsets, pa.array(end))],
            ["key", "bucket", "starts", "ends"],
        )


def _fold_rows(bucket_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = IntervalFold(bucket_ms)
        for b in batches:
            key, start, end = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            fold.add(key, start // bucket_ms, start, end)
            if fold.size > FOLD_ROWS:
                fold.combine()
                if fold.size > FOLD_ROWS // 2:
                    yield from fold.emit()
        yield from fold.emit()

    return run


def _merge_lists(bucket_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, previous = IntervalFold(bucket_ms), None
        for b in batches:  # sorted by (key, bucket): all but the last group of a batch are whole
            starts, ends = b.column(2), b.column(3)
            n = np.diff(starts.offsets.to_numpy())
            key = np.repeat(b.column(0).to_numpy(), n)
            bucket = np.repeat(b.column(1).to_numpy(), n)
            s, e = starts.flatten().to_numpy(), ends.flatten().to_numpy()
            if not len(key):
                continue
            tail = (key == key[-1]) & (bucket == bucket[-1])
            fold.add(key[~tail], bucket[~tail], s[~tail], e[~tail])
            if (key[-1], bucket[-1]) != previous or not tail.all():
                yield from fold.emit()
            fold.add(key[tail], bucket[tail], s[tail], e[tail])
            if fold.size > FOLD_ROWS:
                fold.combine()
            previous = (key[-1], bucket[-1])
        yield from fold.emit()

    return run


def interval_union(df: DataFrame, key: str, start_ms: str, end_ms: str, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """(key, bucket, starts, ends, carry): the union of each key's intervals.

    ``starts`` and ``ends`` are the sorted disjoint intervals that start in ``bucket``; ``carry`` is the furthest end of
    the key's earlier buckets (null in the first). Rows with a null key or time, and those with end <= start, count as
    nothing. Repeated rows, ties and extra columns change nothing; an empty table gives an empty result. ``key`` must
    be integral.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(start_ms).cast("bigint").alias("s"), F.col(end_ms).cast("bigint").alias("e"))
    rows = rows.where("key is not null and s is not null and e is not null and e > s")
    partial = rows.mapInArrow(_fold_rows(bucket_ms), STATE)
    merged = partial.repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(_merge_lists(bucket_ms), STATE)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("carry", F.max(F.element_at("ends", -1)).over(before))


def periods(union: DataFrame) -> DataFrame:
    """(key, start_ms, end_ms): the continuous periods as rows; periods that continue over bucket borders are one."""
    pieces = union.select("key", "bucket", F.explode(F.arrays_zip("starts", "ends")).alias("p"), "carry").select(
        "key", "bucket", F.col("p.starts").alias("s"), F.col("p.ends").alias("e"), "carry"
    )
    pieces = pieces.where("carry is null or e > carry").withColumn("opens", F.expr("carry is null or s > carry"))
    # only pieces that reach over a border need stitching: group by the number of openings, counted per bucket first
    counts = pieces.groupBy("key", "bucket").agg(F.sum(F.col("opens").cast("bigint")).alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "bucket").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.join(base, ["key", "bucket"]).withColumn("period", F.col("base") + F.sum(F.col("opens").cast("bigint")).over(within))
    return numbered.groupBy("key", "period").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).select("key", "start_ms", "end_ms")


def gaps(union: DataFrame, bounds: DataFrame, default_threshold_ms: int = 60_000) -> DataFrame:
    """(key, gap_start_ms, gap_end_ms): complements of the union that reach a key's threshold.

    ``bounds``: (key, limit_ms, threshold_ms). With ``limit_ms`` the complement is taken in [0, limit], leading and
    trailing parts included, and a key without any interval is one gap; with a null limit only holes between two
    intervals count. Keys missing from ``bounds`` have no limit. Negative times are clipped to 0.
    """
    b = bounds.select(F.col("key"), "limit_ms", "threshold_ms")
    inner = union.join(b, "key", "left").withColumn("least", F.coalesce("threshold_ms", F.lit(default_threshold_ms)))
    inner = inner.withColumn("from", F.coalesce(from_zero(F.col("carry")), F.when(F.col("limit_ms").isNotNull(), F.lit(0).cast("bigint")))).withColumn(
        "holes",
        F.expr(
            """filter(zip_with(starts, concat(array(coalesce(`from`, starts[0])), slice(ends, 1, greatest(size(ends) - 1, 0))),
                 (s, p) -> named_struct('s', greatest(p, `from`, 0L), 'e', if(limit_ms is null, s, least(s, limit_ms)))),
               h -> h.e - h.s >= least)"""
        ),
    )
    holes = inner.select("key", F.explode("holes").alias("h")).select("key", F.col("h.s").alias("gap_start_ms"), F.col("h.e").alias("gap_end_ms"))
    reach = union.groupBy("key").agg(F.max(F.element_at("ends", -1)).alias("reach"))
    trailing = (
        b.where("limit_ms is not null")
        .join(reach, "key", "left")
        .select("key", F.greatest(F.coalesce("reach", F.lit(0)), F.lit(0)).alias("gap_start_ms"), F.col("limit_ms").alias("gap_end_ms"), "threshold_ms")
        .where(F.col("gap_end_ms") - F.col("gap_start_ms") >= F.coalesce("threshold_ms", F.lit(default_threshold_ms)))
        .drop("threshold_ms")
    )
    return holes.unionByName(trailing)


def coverage_of(spans: DataFrame, covers: DataFrame) -> DataFrame:
    """``spans`` (key, gap_start_ms, gap_end_ms) with ``covered_ms``: how much the union of ``covers`` (key, s, e) covers.

    The covers' continuous periods are disjoint, so what each covers of a span adds up; spans meet them in buckets of time
    that grow with their length.
    """
    whole = periods(interval_union(covers, "key", "s", "e")).select("key", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    met = overlaps(spans.select("key", F.col("gap_start_ms").alias("s"), F.col("gap_end_ms").alias("e")), whole, "key")
    sums = met.groupBy("key", F.col("s").alias("gap_start_ms"), F.col("e").alias("gap_end_ms")).agg(F.sum(F.col("oe") - F.col("os")).alias("covered_ms"))
    return spans.join(sums, ["key", "gap_start_ms", "gap_end_ms"], "left").fillna(0, ["covered_ms"])
