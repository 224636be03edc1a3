"""Streams of frame readings: bounded micro-batches, exact copies once, and captions folded with state.

Frames carry their own global ordinal, so results don't depend on where micro-batches begin.
"""

from __future__ import annotations

import hashlib
import os
import socket
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cuelake.operators.folds import BLANK_FRAMES, SEGMENT, Caption, continued, folded
from cuelake.session import mounted

#: Files of one micro-batch.
BATCH_FILES = 32
#: Most frames that a medium can have: a week at four a second, and more.
MOST_FRAMES = 3_000_000
FRAME = "source_key bigint, frame_ordinal int, timestamp_seconds double, text string, confidence double, last boolean"
_STATE = "start bigint, seen bigint, text string, norm string, confidence double"


def read_frames(spark: SparkSession, path: str, schema: str = FRAME, batch_files: int = BATCH_FILES) -> DataFrame:
    """A stream of Parquet files of frames, at most ``batch_files`` of them at once."""
    return spark.readStream.schema(StructType.fromDDL(schema)).option("maxFilesPerTrigger", batch_files).parquet(path)


def fold_stream(frames: DataFrame, frame_ms: int = 500) -> DataFrame:
    """Captions as they end; a frame marked ``last`` ends its source's stream.

    Only the caption on screen is state. Frames of one source must arrive in order from batch to batch; inside a batch they
    are put in order here.
    """
    blank_ms = int(frame_ms * BLANK_FRAMES)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown = Caption(*state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["timestamp_seconds", "frame_ordinal"])
        out: list[tuple] = []

        def note(caption: Caption, following: int | None = None) -> None:
            out.append((key[0], caption.start, caption.ends(frame_ms, following), caption.text, caption.confidence))

        for seconds, text, confidence in zip(rows["timestamp_seconds"], rows["text"], rows["confidence"]):
            at = round(seconds * 1000)
            if not text:
                if shown and at - shown.seen > blank_ms:
                    note(shown)
                    shown = None
                continue
            frame = Caption(at, at, text, folded(text), float(confidence))
            longer = continued(shown, frame) if shown else None
            if shown and not longer:
                note(shown, at)
            shown = longer or frame
        ended = bool(rows["last"].fillna(False).any())
        if ended and shown:
            note(shown)
        if ended or not shown:
            if state.exists:
                state.remove()
        else:
            state.update(shown)
        yield pd.DataFrame(out, columns=["source_key", "start_ms", "end_ms", "text", "confidence"])

    return frames.groupBy("source_key").applyInPandasWithState(step, SEGMENT, _STATE, "append", GroupStateTimeout.NoTimeout)


def once_per_content(frames: DataFrame) -> DataFrame:
    """The first frame of each content in a stream: later copies needn't be recognised again."""
    return frames.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["digest"])


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there into Parquet and stops; the checkpoint makes a second run go on where this one ended."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    q.awaitTermination()
    return q


def start_batches(stream: DataFrame, key: list[str], target: str, checkpoint: str, failing: int | None = None) -> StreamingQuery:
    """Each micro-batch into its own folder by batch number: a repeated batch replaces itself, so that a batch that failed or
    was cut off half-way is there once. ``failing``: the number of a batch to fail in, for tests."""

    def put(batch: DataFrame, number: int) -> None:
        if number == failing:
            raise RuntimeError("planned failure")
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(stream: DataFrame, key: list[str], target: str, checkpoint: str, failing: int | None = None) -> StreamingQuery:
    """``start_batches``, until all that is there is written."""
    q = start_batches(stream, key, target, checkpoint, failing)
    q.awaitTermination()
    return q


def frame_grid(media: DataFrame, interval_ms: int) -> DataFrame:
    """(media, ordinal, at_ms, batch, error): the sampling grid of each medium; ordinals are global, batches hold
    BATCH_FILES. A medium of more than MOST_FRAMES frames, whose duration can only be corrupt, is one row with an error."""
    last = F.expr(f"(duration_ms - 1) div {interval_ms}")
    few = last < MOST_FRAMES
    ordinals = F.when(few, F.sequence(F.lit(0).cast("bigint"), F.when(few, last).otherwise(F.lit(0).cast("bigint")))).otherwise(F.array(F.lit(None).cast("bigint")))
    g = media.where("duration_ms > 0").select("media", F.explode(ordinals).alias("ordinal"))
    return g.select("media", "ordinal", (F.col("ordinal") * interval_ms).alias("at_ms"), F.floor(F.col("ordinal") / BATCH_FILES).alias("batch"), F.when(F.col("ordinal").isNull(), "too many frames").alias("error"))


def split_jpegs(chunks: Iterable[bytes], most: int = 64 * 1024 * 1024) -> Iterator[bytes]:
    """Images of a byte stream of JPEG files, wherever its chunks are cut; bytes between images are skipped.

    An image begins with FF D8 and ends with FF D9, which stuffing keeps out of its data. A stream that ends inside an
    image, or an image of more than ``most`` bytes, is an error.
    """
    held = bytearray()
    inside, looked = False, 0
    for chunk in chunks:
        held += chunk
        while True:
            at = held.find(b"\xff\xd9" if inside else b"\xff\xd8", looked)
            if at < 0:
                if not inside:
                    del held[: max(0, len(held) - 1)]
                    looked = 0
                else:
                    looked = max(2, len(held) - 1)
                    if len(held) > most:
                        raise ValueError("an image without an end")
                break
            if inside:
                yield bytes(held[: at + 2])
                del held[: at + 2]
                inside, looked = False, 0
            else:
                del held[:at]
                inside, looked = True, 2
    if inside:
        raise ValueError("the stream ended inside an image")


def frames_of_streams(streams: DataFrame, interval_ms: int) -> DataFrame:
    """(media, ordinal, at_ms, digest, size, error): the images of recorded byte streams (media, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for medium, content in zip(b["media"], b["content"]):
                rows, error = [], None
                try:
                    rows = [(medium, i, i * interval_ms, hashlib.sha256(x).hexdigest(), len(x), None) for i, x in enumerate(split_jpegs([bytes(content or b"")]))]
                except ValueError as x:
                    error = str(x)
                if error or not rows:
                    rows = [(medium, None, None, None, None, error or "no image")]
                yield pd.DataFrame(rows, columns=["media", "ordinal", "at_ms", "digest", "size", "error"]).astype({"ordinal": "Int64", "at_ms": "Int64", "size": "Int64"})

    return streams.select("media", "content").mapInPandas(run, "media bigint, ordinal bigint, at_ms bigint, digest string, size bigint, error string")


class Busy(RuntimeError):
    """Another run holds the task."""


@contextmanager
def single_flight(folder: str) -> Iterator[None]:
    """Only one run at a time works on a task's folder: the lock file is made atomically, and a second run is refused.

    The lock holds its owner's process; a lock whose process is gone on this host is taken over.
    """
    lock = mounted(folder) / ".lock"
    lock.parent.mkdir(parents=True, exist_ok=True)
    mine = f"{socket.gethostname()} {os.getpid()}"
    for again in (True, False):
        try:
            with lock.open("x") as f:
                f.write(mine)
            break
        except FileExistsError:
            host, _, pid = lock.read_text().partition(" ")
            gone = host == socket.gethostname() and pid.isdigit() and not Path(f"/proc/{pid}").exists()
            if not (again and gone):
                raise Busy(f"{folder} is worked on by {host} {pid}") from None
            lock.unlink(missing_ok=True)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def stop_and_wait(query: StreamingQuery, seconds: float = 60.0) -> bool:
    """Stops a query and waits until the batch at hand has had its effects; whether it ended in time."""
    query.stop()
    return bool(query.awaitTermination(seconds)) or not query.isActive


def progress_log(spark: SparkSession) -> tuple[list[tuple[str, int]], Callable[[list], list[tuple[str, int]]]]:
    """Registers a listener; returns the list that it fills with (query name, input rows) of every micro-batch, and a
    function that waits for the last event, takes the listener away and returns the list."""
    from pyspark.sql.streaming.listener import StreamingQueryListener

    seen: list[tuple[str, int]] = []
    ended: list[str] = []

    class Log(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:  # noqa: ANN001
            pass

        def onQueryProgress(self, event) -> None:  # noqa: ANN001
            seen.append((event.progress.name or str(event.progress.id), event.progress.numInputRows))

        def onQueryIdle(self, event) -> None:  # noqa: ANN001
            pass

        def onQueryTerminated(self, event) -> None:  # noqa: ANN001
            ended.append(str(event.id))

    log = Log()
    spark.streams.addListener(log)

    def stop(log_of: list, seconds: float = 30.0) -> list[tuple[str, int]]:
        until = time.monotonic() + seconds
        while not ended and time.monotonic() < until:
            time.sleep(0.1)
        spark.streams.removeListener(log)
        return list(log_of)

    return seen, stop
