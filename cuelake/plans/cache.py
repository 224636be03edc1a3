"""Completed transcripts, kept under keys of everything their text depends on.

A kept transcript is one or more JSON payloads of a bounded number of cues. What is read back is trusted only if it has the
right schema, revision and types and belongs to the source that asks: anything else is a miss, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.identity import canonical_key
from cuelake.operators.intervals import to_ms

SCHEMA, REVISION = 1, "r1"
#: What must be equal, key aside, for a kept transcript to be a source's own.
IDENTITY = ["platform", "source_id", "url", "webpage_url", "duration_seconds", "media_type"]
METADATA = ["url", "platform", "source_id", "title", "author", "duration_seconds", "webpage_url", "media_type"]
# How transcripts are made.
METHODS = [
    "platform-captions", "platform-captions-whisper", "local-captions", "local-captions-whisper", "apple-vision-ocr", "rapidocr", "mlx-whisper", "faster-whisper", "ocr-whisper",
]


@dataclass(frozen=True)
class Options:
    """What a caller asks for; where the result is written isn't part of it."""

    mode: str = "auto"
    language: str = "auto"
    caption_languages: tuple[str, ...] = ("en",)
    whisper_model: str = "small"
    ocr_profile: str = "balanced"
    ocr_region: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    auth_scope: str = "anonymous"


def transcript_key(o: Options) -> Column:
    """The key of a source (platform, source_id, url, webpage_url, duration_seconds, media_type) under ``o``: 15 fields."""
    return canonical_key(
        schema=F.lit(SCHEMA), pipeline_revision=F.lit(REVISION), platform=F.col("platform"), source_id=F.col("source_id"), requested_url=F.trim("url"), webpage_url=F.trim("webpage_url"),
        duration_ms=to_ms(F.col("duration_seconds")), mode=F.lit(o.mode), language=F.lit(o.language.strip()), caption_languages=F.array(*map(F.lit, o.caption_languages)),
        whisper_model=F.lit(o.whisper_model), ocr_profile=F.lit(o.ocr_profile), ocr_region=F.array(*map(F.lit, o.ocr_region)), media_type=F.col("media_type"), auth_scope=F.sha2(F.lit(o.auth_scope), 256),
    )


def identity_digest() -> Column:
    """One digest of the six identity fields."""
    return F.sha2(F.to_json(F.struct(*[F.trim(c).alias(c) if c.endswith("url") else (to_ms(F.col(c)).alias(c) if c == "duration_seconds" else F.col(c)) for c in IDENTITY]), {"ignoreNullFields": "false"}), 256)


def encode(heads: DataFrame, cues: DataFrame, key: Column) -> DataFrame:
    """(transcript_id, key, part, payload): ``heads`` (transcript_id, metadata, language, method, warnings, pending) with their
    numbered ``cues`` (transcript_id, part, place, s, e, text, confidence) as JSON, one payload for each part."""
    seg = F.struct("place", F.struct((F.col("s") / 1000).alias("start_seconds"), (F.col("e") / 1000).alias("end_seconds"), "text", "confidence").alias("seg"))
    lists = cues.groupBy("transcript_id", "part").agg(F.transform(F.array_sort(F.collect_list(seg)), lambda x: x["seg"]).alias("segments"))
    parts = cues.groupBy("transcript_id").agg((F.max("part") + 1).alias("parts"))
    warnings = F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings")
    transcript = F.struct(F.struct(*METADATA).alias("metadata"), "language", "method", "segments", warnings, F.col("pending").alias("verification_pending"))
    body = F.struct(F.lit(SCHEMA).alias("schema"), F.lit(REVISION).alias("pipeline_revision"), "part", "parts", transcript.alias("transcript"))
    joined = heads.withColumn("key", key).join(parts, "transcript_id").join(lists, "transcript_id")
    return joined.select("transcript_id", "key", "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


_SEGMENTS = "array<struct<start_seconds: double, end_seconds: double, text: string, confidence: double>>"
_BODY = (
    "schema int, pipeline_revision string, part bigint, parts bigint, transcript struct<metadata: struct<url: string, platform: string, source_id: string, title: string, author: string, "
    f"duration_seconds: double, webpage_url: string, media_type: string>, language: string, method: string, segments: {_SEGMENTS}, warnings: array<string>, verification_pending: boolean>"
)


def decode(kept: DataFrame) -> DataFrame:
    """(key, part, parts, metadata, language, method, warnings, segments) of the payloads (key, payload) that can be trusted.

    Types are checked as written, so a number in quotes or a string instead of a list is a miss, as are other schemas and
    revisions, unknown methods, pending transcripts, and cues with blank texts or impossible times.
    """
    v = F.try_parse_json("payload")

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")), F.lit(""))

    number = r"^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT|SMALLINT|TINYINT)$"
    typed = (
        kind("transcript.metadata").startswith("OBJECT") & kind("transcript.segments").rlike(r"^ARRAY<(OBJECT.*|VOID)>$") & kind("transcript.warnings").isin("ARRAY<STRING>", "ARRAY<VOID>", "")
        & kind("transcript.metadata.source_id").eqNullSafe("STRING") & kind("transcript.metadata.duration_seconds").rlike(number + "|^VOID$|^$")
        & kind("transcript.language").isin("STRING", "VOID") & (kind("transcript.method") == "STRING") & kind("transcript.verification_pending").isin("BOOLEAN", "") & kind("schema").rlike(number)
    )
    read = kept.withColumn("typed", typed).withColumn("b", F.from_json("payload", _BODY))
    t = F.col("b.transcript")
    cue_ok = F.forall(t["segments"], lambda s: s["start_seconds"].isNotNull() & (s["start_seconds"] >= 0) & (s["end_seconds"] >= s["start_seconds"]) & (F.trim(s["text"]) != "") & F.coalesce(s["confidence"].between(0, 1), F.lit(True)))
    right = (F.col("b.schema") == SCHEMA) & (F.col("b.pipeline_revision") == REVISION) & t["method"].isin(METHODS) & ~F.coalesce(t["verification_pending"], F.lit(False))
    ok = read.where(F.coalesce(F.col("typed") & right & cue_ok, F.lit(False)))
    return ok.select("key", "b.part", "b.parts", t["metadata"].alias("metadata"), t["language"].alias("language"), t["method"].alias("method"), t["warnings"].alias("warnings"), t["segments"].alias("segments"))


def lookup(sources: DataFrame, entries: DataFrame, o: Options) -> DataFrame:
    """``sources`` with ``key`` and ``cached``: whether all parts of a transcript are kept under the key for this very source.

    ``entries`` are decoded payloads. The key decides where to look; the six identity fields must be equal as well.
    """
    whole = entries.groupBy("key").agg(F.countDistinct("part").alias("n"), F.max("parts").alias("parts"), F.min("metadata").alias("m"), F.max("metadata").alias("other")).where("n = parts and m = other")
    keyed = sources.withColumn("key", transcript_key(o))
    same = [F.trim(keyed[c]).eqNullSafe(F.trim(F.col(f"m.{c}"))) if c.endswith("url") else keyed[c].eqNullSafe(F.col(f"m.{c}")) for c in IDENTITY]
    on = keyed.key == whole.key
    for s in same:
        on &= s
    return keyed.join(whole.select("key", "m"), on, "left").select(*[keyed[c] for c in keyed.columns], whole.key.isNotNull().alias("cached"))


def chosen(sources: DataFrame, fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """(source_key, origin): 'captions' where fresh captions are there, whatever is kept; else 'cache', else 'work'."""
    f = fresh.select("source_key").distinct().withColumn("fresh", F.lit(True))
    k = cached.select("source_key").distinct().withColumn("kept", F.lit(True))
    j = sources.select("source_key").distinct().join(f, "source_key", "left").join(k, "source_key", "left")
    return j.select("source_key", F.when(F.col("fresh"), "captions").when(F.col("kept"), "cache").otherwise("work").alias("origin"))
