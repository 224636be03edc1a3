"""Running aggregates over long ordered sequences, in two levels.

A sequence is cut into blocks; a window runs inside each block, and what earlier blocks contribute comes from a window over
one summary row per block. No task ever orders more than a block, however long a key's sequence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(df: DataFrame, keys: list[str], block: str, order: list[str], totals: dict[str, tuple[Column, str]] | None = None, before: dict[str, str] | None = None) -> DataFrame:
    """``df`` with aggregates of all rows of the key before this one, and with columns of the row before.

    ``totals``: name -> (value, 'max' or 'sum'), null or 0 at a key's first row; ``before``: name -> column, null there. Both
    reach over blocks, however far apart: a block's rows are followed by what one summary row per block says of the blocks
    before. ``order`` must tell rows of a block apart, else ties are put in any order.
    """
    totals, before = totals or {}, before or {}
    agg = {"max": F.max, "sum": F.sum}
    rows = df.withColumns({f"_v_{n}": v for n, (v, _) in totals.items()}).repartition(*keys, block)
    here = Window.partitionBy(*keys, block).orderBy(*order)
    earlier_here = here.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(block)
    summary = [agg[how](f"_v_{n}").alias(f"_a_{n}") for n, (_, how) in totals.items()]
    if before:
        summary.append(F.max_by(F.struct(*[F.col(v).alias(n) for n, v in before.items()]), F.struct(*order)).alias("_last"))
    blocks = rows.groupBy(*keys, block).agg(*summary)
    carry = [agg[how](f"_a_{n}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}") for n, (_, how) in totals.items()]
    carry += [F.lag("_last").over(earlier).alias("_handed")] if before else []
    local = {f"_l_{n}": agg[how](f"_v_{n}").over(earlier_here) for n, (_, how) in totals.items()}
    local |= {f"_b_{n}": F.lag(v).over(here) for n, v in before.items()}
    if before:
        local["_first"] = F.row_number().over(here) == 1
    joined = rows.withColumns(local).join(blocks.select(*keys, block, *carry), [*keys, block], "left")
    found = {
        n: F.greatest(f"_l_{n}", f"_c_{n}") if how == "max" else F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n, (_, how) in totals.items()
    } | {n: F.when(F.col("_first"), F.col(f"_handed.{n}")).otherwise(F.col(f"_b_{n}")) for n in before}
    return joined.withColumns(found).drop("_first", "_handed", *[f"_{k}_{n}" for n in totals for k in "vlc"], *[f"_b_{n}" for n in before])


def running(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, how: str, name: str) -> DataFrame:
    """``df`` with ``name``: the max or sum of ``value`` over all rows of the key before this one (null or 0 at the first)."""
    return scanned(df, keys, block, order, {name: (value, how)})


def previous(df: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with columns of the row before, however far its block lies back; null at a key's first row."""
    return scanned(df, keys, block, order, before=values)


def islands(cues: DataFrame, key: str, slack_ms: int = 0, block_ms: int = 600_000) -> DataFrame:
    """``cues`` (key, s, e, ordinal, ...) with ``island``: numbers of stretches that no gap of more than ``slack_ms`` parts."""
    rows = cues.withColumn("_b", F.floor(F.col("s") / block_ms))
    order = ["s", "e", "ordinal", "segment_id"]
    reached = running(rows, [key], "_b", order, F.col("e"), "max", "_reach")
    opened = reached.withColumn("_new", (F.col("_reach").isNull() | (F.col("s") > F.col("_reach") + slack_ms)).cast("bigint"))
    return running(opened, [key], "_b", order, F.col("_new"), "sum", "_n").withColumn("island", F.col("_n") + F.col("_new")).drop("_b", "_reach", "_new", "_n")
