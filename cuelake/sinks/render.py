"""Transcripts as text documents, one row per transcript.

A document is one value, so the cues of a transcript are gathered for it; ``most_cues`` bounds that: longer transcripts
come as several numbered parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import escape_markup
from cuelake.functions.times import display_time, subtitle_time
from cuelake.operators.sequences import running

#: Cues of one document part.
MOST_CUES = 50_000


def numbered(cues: DataFrame, most_cues: int = MOST_CUES) -> DataFrame:
    """Cues with ``place`` (from 1, in order of time) and ``part``."""
    r = running(cues.withColumn("_b", F.floor(F.col("s") / 600_000)), ["transcript_id"], "_b", ["s", "e", "ordinal", "segment_id"], F.lit(1), "sum", "_p")
    return r.withColumn("place", F.col("_p") + 1).withColumn("part", F.floor(F.col("_p") / most_cues)).drop("_b", "_p")


def bodies(cues: DataFrame, line: Column, separator: str, name: str) -> DataFrame:
    """(transcript_id, part, name): the lines of a transcript joined in order of time."""
    lines = cues.select("transcript_id", "part", F.struct("place", line.alias("line")).alias("l"))
    return lines.groupBy("transcript_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), separator).alias(name))


def _range(s: Column, e: Column) -> Column:
    return F.concat(display_time(s / 1000.0), F.lit(" - "), display_time(e / 1000.0))


def text_line() -> Column:
    return F.concat(F.lit("["), _range(F.col("s"), F.col("e")), F.lit("] "), F.col("text"))


def markdown_line() -> Column:
    return F.concat(F.lit("**["), _range(F.col("s"), F.col("e")), F.lit("]**\n\n"), F.col("text"))


def cue_block(separator: str) -> Column:
    end = F.greatest(F.col("e"), F.col("s") + 1)
    return F.concat(F.col("place").cast("string"), F.lit("\n"), subtitle_time(F.col("s"), separator), F.lit(" --> "), subtitle_time(end, separator), F.lit("\n"), escape_markup(F.col("text")))


def header() -> Column:
    """Head of a Markdown document over (title, webpage_url, url, platform, author, duration_seconds, language, method)."""
    or_unknown = lambda x: F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("unknown"))
    return F.concat(
        F.lit("# "), F.coalesce("title", "source_id"), F.lit("\n\n- Source: "), F.coalesce(F.nullif("webpage_url", F.lit("")), "url"), F.lit("\n- Platform: "), F.col("platform"),
        F.lit("\n- Author: "), or_unknown("author"), F.lit("\n- Duration: "), display_time(F.col("seconds")), F.lit("\n- Language: "), or_unknown("language"), F.lit("\n- Extraction: "), F.col("method"), F.lit("\n\n## Transcript\n\n"),
    )


def last_parts(cues: DataFrame) -> DataFrame:
    """(transcript_id, last_part)"""
    return cues.groupBy("transcript_id").agg(F.max("part").alias("last_part"))


def markdown(heads: DataFrame, cues: DataFrame, timed: bool) -> DataFrame:
    """(transcript_id, part, document): Markdown with or without times: the head before the first part, warnings, if any,
    behind the last."""
    body = bodies(cues, markdown_line() if timed else F.col("text"), "\n\n", "body")
    warned = F.when(F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0, F.concat(F.lit("\n\n## Warnings\n\n- "), F.array_join("warnings", "\n- "))).otherwise("")
    head = F.when(F.col("part") == 0, header()).otherwise("")
    tail = F.when(F.col("part") == F.col("last_part"), warned).otherwise("")
    joined = heads.join(last_parts(cues), "transcript_id").join(body, "transcript_id")
    return joined.select("transcript_id", "part", F.concat(head, "body", tail, F.lit("\n")).alias("document"))


def webvtt(cues: DataFrame) -> DataFrame:
    """(transcript_id, part, document): WebVTT; the signature stands before the first part only."""
    body = bodies(cues, cue_block("."), "\n\n", "body")
    return body.select("transcript_id", "part", F.concat(F.when(F.col("part") == 0, "WEBVTT\n\n").otherwise(""), "body").alias("document"))


def segments_json(heads: DataFrame, cues: DataFrame) -> DataFrame:
    """(transcript_id, part, payload): schema version 1 with unrounded times; unknown confidences are null."""
    seg = F.struct("place", F.struct((F.col("s") / 1000).alias("start_seconds"), (F.col("e") / 1000).alias("end_seconds"), "text", "confidence").alias("seg"))
    rows = cues.groupBy("transcript_id", "part").agg(F.transform(F.array_sort(F.collect_list(seg)), lambda x: x["seg"]).alias("segments"))
    meta = F.struct("url", "platform", "source_id", "title", "author", F.col("seconds").alias("duration_seconds"), "webpage_url", "media_type")
    body = F.struct(F.lit(1).alias("schema_version"), meta.alias("metadata"), "language", F.col("method").alias("extraction_method"), "warnings", "segments")
    return heads.join(rows, "transcript_id").select("transcript_id", "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def metadata_json(heads: DataFrame, cues: DataFrame) -> DataFrame:
    """(transcript_id, payload): metadata and counts without segments."""
    n = cues.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("segment_count"))
    body = F.struct("url", "platform", "source_id", "title", "author", F.col("seconds").alias("duration_seconds"), "webpage_url", "media_type", "language", F.col("method").alias("extraction_method"), "segment_count", "warnings")
    return heads.join(n, "transcript_id").select("transcript_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
