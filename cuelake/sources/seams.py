"""Narrow interfaces to what lies outside an analytics engine: downloaders, probes and recognisers.

Each is a plain callable over picklable values; ``apply_isolated`` runs one over the rows of a DataFrame on the executors,
with bounded retries and errors as data.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seconds to wait before each retry of an error that the platform calls transient.
BACKOFF = (0.5, 1.5, 3.0)


class Transient(Exception):
    """An error worth another attempt."""


def with_retries(call: Callable[[], object], delays: tuple[float, ...] = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``call``; transient errors are retried after each delay, others raise at once."""
    for delay in (*delays, None):
        try:
            return call()
        except Transient:
            if delay is None:
                raise
            sleep(delay)
    raise AssertionError


@dataclass(frozen=True)
class Authentication:
    """Cookies for a downloader: a browser's or a file's, not both; only a file's can be part of a cache key."""

    browser: str | None = None
    cookie_file: str | None = None

    def __post_init__(self) -> None:
        if self.browser and self.cookie_file:
            raise ValueError("choose cookies of a browser or of a file, not both")

    def scope(self) -> str | None:
        """What a cache key says of it: anonymous, a file's digest, or nothing for a browser's, which can't be in a key."""
        if self.browser:
            return None
        return f"cookie-file:{hashlib.sha256(self.cookie_file.encode()).hexdigest()}" if self.cookie_file else "anonymous"


def largest_finished(files: dict[str, int]) -> str | None:
    """The largest file that isn't a part of a download; of equal ones the first by name."""
    done = {p: n for p, n in files.items() if not p.endswith((".part", ".ytdl", ".tmp"))}
    return min(done, key=lambda p: (-done[p], p)) if done else None


def finished_files(files: DataFrame) -> DataFrame:
    """(media, path, size): each medium's largest file (media, path, size) that isn't a part of a download, ties by name."""
    done = files.where(~F.col("path").rlike(r"\.(part|ytdl|tmp)$"))
    return done.groupBy("media").agg(F.min(F.struct((-F.col("size")).alias("n"), "path")).alias("b")).select("media", "b.path", (-F.col("b.n")).alias("size"))


def queued(inputs: DataFrame, column: str, call: Callable[[str], str], at_once: int, order: str = "ordinal", delays: tuple[float, ...] = BACKOFF) -> DataFrame:
    """(order, column, result, error): every distinct input once, under its first place; at most ``at_once`` run at a time.

    Blank inputs are errors of their own. The caller sorts by ``order`` if it collects.
    """
    first = inputs.withColumn(column, F.trim(F.coalesce(column, F.lit("")))).groupBy(column).agg(F.min(order).alias(order))
    blank = first.where(F.col(column) == "").select(order, column, F.lit(None).cast("string").alias("result"), F.lit("an empty input").alias("error"))
    ran = apply_isolated(first.where(F.col(column) != "").select(order, column).repartition(at_once, column), column, call, delays)
    return ran.unionByName(blank)


def apply_isolated(inputs: DataFrame, column: str, call: Callable[[str], str], delays: tuple[float, ...] = BACKOFF) -> DataFrame:
    """``inputs`` with ``result`` and ``error``: one failing row never fails the others; order columns are kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results, errors = [], []
            for value in f[column]:
                try:
                    results.append(with_retries(lambda value=value: call(value), delays))
                    errors.append(None)
                except Exception as x:  # errors are data here
                    results.append(None)
                    errors.append(" ".join(str(x).split()) or type(x).__name__)
            yield f.assign(result=pd.Series(results, dtype=object), error=pd.Series(errors, dtype=object))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInPandas(run, f"{schema}, result string, error string")
