"""Idempotent incremental work: results kept by content-addressed keys in one Parquet folder per store.

Every run writes what it has done as one new generation; the newest row of a key holds. A key is written once its result is
complete and final, so an interrupted run is simply asked for the missing keys again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuelake.functions.identity import joined_key
from cuelake.session import keep


class Store:
    """Results (key, identity, payload, pending) of one recipe revision under ``path``, a folder that all executors share."""

    SCHEMA = "key string, identity string, payload string, pending boolean, revision string, written_at timestamp"

    def __init__(self, spark: SparkSession, path: str, revision: str) -> None:
        self.spark, self.path, self.revision = spark, path.rstrip("/"), revision

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p)

    def _valid(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], StructType.fromDDL(self.SCHEMA))
        kept = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return kept.where((F.col("revision") == self.revision) & F.col("payload").isNotNull() & F.col("key").rlike("^[0-9a-f]{64}$"))

    def keys(self) -> DataFrame:
        """(key, identity, written_at) of the newest result of each key; payloads aren't read, let alone moved."""
        newest = F.max(F.struct("written_at", "identity")).alias("n")
        return self._valid().groupBy("key").agg(newest).select("key", "n.identity", "n.written_at")

    def rows(self) -> DataFrame:
        """The valid newest result of each key; rows of another revision, or without payload, are misses."""
        all_rows = self._valid()
        newest = self.keys().withColumnsRenamed({"identity": "n_identity", "written_at": "n_at"})
        met = all_rows.join(newest, "key").where((F.col("written_at") == F.col("n_at")) & F.col("identity").eqNullSafe(F.col("n_identity"))).drop("n_identity", "n_at")
        return met.dropDuplicates(["key"])

    def pending_work(self, work: DataFrame) -> DataFrame:
        """Rows of ``work`` (key, identity, ...) that have no result; a key with another identity is a miss."""
        return work.join(self.keys().select("key", "identity"), ["key", "identity"], "left_anti")

    def finished(self, work: DataFrame) -> DataFrame:
        """``work`` with the payloads that are there; neither is broadcast, as work that an ``explode`` made looks small."""
        return work.join(self.rows().select("key", "identity", "payload").hint("merge"), ["key", "identity"])

    def put(self, results: DataFrame) -> None:
        """Keeps final results; those that still wait for verification are refused."""
        final = results.where(~F.coalesce("pending", F.lit(False))).select("key", "identity", "payload", F.lit(False).alias("pending"))
        final.withColumn("revision", F.lit(self.revision)).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def usage(self) -> DataFrame:
        """(results, bytes) that are kept."""
        return self.rows().agg(F.count(F.lit(1)).alias("results"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes"))


def run_incrementally(store: Store, work: DataFrame, compute) -> DataFrame:  # noqa: ANN001
    """Computes what is missing (``compute``: DataFrame -> key, identity, payload, pending), keeps it, and returns all results."""
    missing = store.pending_work(work)
    store.put(compute(missing))
    return store.finished(work)


class EphemeralStore:
    """The store's interface for runs that keep nothing: what one run put is there for that run only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._kept = spark, spark.createDataFrame([], StructType.fromDDL("key string, identity string, payload string"))

    def pending_work(self, work: DataFrame) -> DataFrame:
        return work.join(self._kept, ["key", "identity"], "left_anti")

    def put(self, results: DataFrame) -> None:
        self._kept = self._kept.unionByName(keep(results.where(~F.coalesce("pending", F.lit(False))).select("key", "identity", "payload")))

    def finished(self, work: DataFrame) -> DataFrame:
        return work.join(self._kept, ["key", "identity"])


def open_store(spark: SparkSession, path: str | None, revision: str) -> tuple[Store | EphemeralStore, str | None]:
    """A store, or, where the folder can't be used, an ephemeral one with a warning: storage trouble stops no work."""
    if path is None:
        return EphemeralStore(spark), None
    try:
        store = Store(spark, path, revision)
        store.rows().limit(1).collect()
    except Exception as x:
        return EphemeralStore(spark), f"results can't be kept: {' '.join(str(x).split())[:160]}"
    return store, None


def manifest(events: DataFrame) -> DataFrame:
    """(key, state, path, size): the newest event of each medium; 'complete' only where the file has the size noted.

    ``events``: (key, state, path, size, actual_size, at). A medium whose file is gone or of another size is downloaded
    again.
    """
    newest = events.groupBy("key").agg(F.max(F.struct("at", "state", "path", "size", "actual_size")).alias("n"))
    whole = (F.col("n.state") == "complete") & F.col("n.size").eqNullSafe(F.col("n.actual_size")) & F.col("n.size").isNotNull()
    return newest.select("key", F.when(whole, "complete").otherwise("downloading").alias("state"), "n.path", "n.size")


def frame_batches(frames: DataFrame, recipe: Column, size: int = 32) -> DataFrame:
    """(source_key, batch, first, frames, key, identity): batches of a source's frames (source_key, frame_ordinal, digest).

    ``recipe`` describes how they are read. The key names recipe, source and batch; the identity is a digest of all
    (ordinal, content) pairs, so a batch of which any frame has changed is read again.
    """
    b = frames.withColumn("batch", F.floor(F.col("frame_ordinal") / size))
    g = b.groupBy("source_key", "batch").agg(F.min("frame_ordinal").alias("first"), F.count(F.lit(1)).alias("frames"), F.array_sort(F.collect_set(F.struct("frame_ordinal", "digest"))).alias("f"))
    return g.select("source_key", "batch", "first", "frames", joined_key(recipe, F.col("source_key"), F.col("batch")).alias("key"), F.sha2(F.to_json("f"), 256).alias("identity"))


def valid_checkpoint(payload: Column, key: Column, index: Column, length_ms: Column, schema: int = 1, revision: str = "r1") -> Column:
    """Whether a chunk's kept JSON can be used: schema, revision, key and index as asked, cues inside the chunk and in order.

    No cue at all is a valid result: the chunk was silent.
    """
    kind = "schema int, revision string, key string, index int, segments array<struct<start_ms: bigint, end_ms: bigint, text: string>>"
    p = F.from_json(payload, kind)
    cues = p["segments"]
    inside = F.forall(cues, lambda c: (c["start_ms"] >= 0) & (c["end_ms"] >= c["start_ms"]) & (c["end_ms"] <= length_ms) & (F.trim(c["text"]) != ""))
    ordered = F.forall(F.zip_with(cues, F.slice(cues, F.lit(2), F.greatest(F.size(cues), F.lit(1))), lambda x, y: y.isNull() | (y["start_ms"] >= x["start_ms"])), lambda ok: ok)
    return F.coalesce((p["schema"] == schema) & (p["revision"] == revision) & (p["key"] == key) & (p["index"] == index) & inside & ordered, F.lit(False))


def cleanup_counts(actions: DataFrame, by: str) -> DataFrame:
    """(by, removed, active, kept) of what ``clearable`` decided."""
    of = lambda a: F.count_if(F.col("action") == a)
    return actions.groupBy(by).agg(of("remove").alias("removed"), of("active").alias("active"), of("keep").alias("kept"))


def usage_by_class(files: DataFrame) -> DataFrame:
    """(class, files, size) of files (path, length) under class folders, and their total."""
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), "length")
    g = named.rollup("class").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size"))
    return g.select(F.coalesce("class", F.lit("total")).alias("class"), "files", "size")


def snapshot(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as it is now, written to the shared folder: later changes of what it was read from don't show in it."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clearable(tasks: DataFrame, *columns: str) -> DataFrame:
    """(key, *columns, action): incomplete tasks are removed, locked ones are left active, completed ones and links are kept."""
    action = F.when(F.col("completed") | F.col("is_link"), "keep").when(F.col("locked"), "active").otherwise("remove")
    return tasks.select("key", *columns, action.alias("action"))


def abandoned(fallbacks: DataFrame, captions: DataFrame) -> DataFrame:
    """Fallback work (key, ...) of media for which captions have arrived since: nothing needs it any more."""
    return fallbacks.join(captions.select("key").distinct(), "key", "left_semi")
