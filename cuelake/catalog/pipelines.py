"""Queries for sources, sinks, folds, plans and streams, with SQL twins where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.catalog.relational import CUE, MEDIA, QUERIES, SQL, TR, _media, c, query
from cuelake.catalog.scalars import sql_clock, sql_stamp
from cuelake.functions import times as tm
from cuelake.functions.udfs import portable_name
from cuelake.operators import cues as cu
from cuelake.operators import folds, quality
from cuelake.plans import incremental, planning
from cuelake.session import shared_folder
from cuelake.sinks import render
from cuelake.sources import captions
from cuelake.sources.tables import current_transcripts, latest_by, table
from cuelake.streaming import frames as stream

SRCS = "sr AS (SELECT DISTINCT ON (source_key) * FROM sources WHERE source_key IS NOT NULL ORDER BY source_key, ingested_at DESC)"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    columns = ["source_id", "url", "platform", "title", "author", "duration_seconds", "webpage_url", "media_type"]
    return latest_by(table(spark, d, "sources"), "source_key", "ingested_at", *columns)


_STAMP = r"((?:\d{1,3}:)?\d{1,2}:\d{2}[.,]\d{1,3})"
_P = rf"{_STAMP}\s*-->\s*{_STAMP}"


def _ms(i: int) -> str:
    x = f"regexp_extract(timing, '{_P}', {i})"
    p = f"string_split(replace({x}, ',', '.'), ':')"
    return f"CAST(round((CASE WHEN len({p}) = 3 THEN CAST({p}[1] AS DOUBLE) * 3600 ELSE 0 END + CAST({p}[len({p}) - 1] AS DOUBLE) * 60 + CAST({p}[len({p})] AS DOUBLE)) * 1000) AS BIGINT)"


@query(
    "SRC01",
    rf"""WITH b AS (SELECT doc_id, bl, i - 1 AS place FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '^\x{{feff}}', ''), '\r\n?', chr(10), 'g'), '\n[ \t]*\n') AS a FROM documents WHERE text IS NOT NULL), unnest(a) WITH ORDINALITY AS t(bl, i)),
l AS (SELECT doc_id, place, string_split(bl, chr(10)) AS ls FROM b WHERE contains(bl, '-->')),
t AS (SELECT doc_id, place, ls, len(list_filter(range(1, len(ls) + 1), lambda i: len(list_filter(ls[1:i], lambda x: contains(x, '-->'))) = 0)) + 1 AS k FROM l),
u AS (SELECT doc_id, place, ls[k] AS timing, list_filter(list_transform(ls[k + 1:], lambda x: trim(regexp_replace(translate(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\{{\\[^}}]+\}}', '', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(8206) || chr(8207), ''), '[\x09-\x0d\x1c-\x20\x{{85}}\p{{Z}}]+', ' ', 'g'))), lambda x: x <> '') AS a FROM t)
SELECT doc_id, place, {_ms(1)} AS s, {_ms(2)} AS e, array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), ' ') AS text FROM u WHERE regexp_matches(timing, '{_P}') AND len(a) > 0 AND {_ms(2)} >= {_ms(1)}""",
)
def caption_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are caption files, as cues."""
    return captions.scan_captions(table(spark, d, "documents").where("text is not null"), "doc_id", "text").withColumn("place", c("place").cast("bigint"))


@query("SRC04", f"WITH {SRCS} SELECT source_key, CASE WHEN media_type = 'audio' THEN 'audio' ELSE 'audio,video' END AS kinds, round(CASE WHEN isfinite(duration_seconds) THEN duration_seconds ELSE 7.5 END, 6) AS duration_seconds FROM sr")
def probe(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    one = lambda kind, cover: F.struct(F.lit(kind).alias("codec_type"), F.lit("7.5").alias("duration"), F.struct(F.lit(cover).alias("attached_pic")).alias("disposition"))
    streams = F.when(c("media_type") == "audio", F.array(one("audio", 0), one("video", 1))).otherwise(F.array(one("audio", 0), one("video", 0)))
    known = F.when(tm.finite(c("duration_seconds")), c("duration_seconds").cast("string"))
    j = s.select("source_key", F.to_json(F.struct(F.struct(known.alias("duration")).alias("format"), streams.alias("streams"))).alias("json"))
    return captions.probed(j, "source_key", "json").withColumn("duration_seconds", F.round("duration_seconds", 6))


_URL = "replace(replace(url, 'yt.example.invalid', 'www.YouTube.com.'), 'bili.example.invalid', 'm.bilibili.com')"
_URLC = lambda: F.replace(F.replace(c("url"), F.lit("yt.example.invalid"), F.lit("www.YouTube.com.")), F.lit("bili.example.invalid"), F.lit("m.bilibili.com"))
_HOST = f"regexp_replace(lower(regexp_extract({_URL}, '^(?i:https?)://([^/?#:]*)', 1)), '\\.$', '')"
_PLAT = f"CASE WHEN regexp_matches({_HOST}, '(^|\\.)(youtube\\.com|youtu\\.be)$') THEN 'youtube' WHEN regexp_matches({_HOST}, '(^|\\.)(bilibili\\.com|b23\\.tv)$') THEN 'bilibili' ELSE 'unsupported' END"
QUERIES["SRC06"] = lambda spark, d: table(spark, d, "sources").select("source_key", captions.platform_of(_URLC()).alias("host_platform"))
SQL["SRC06"] = f"SELECT source_key, {_PLAT} AS host_platform FROM sources"
QUERIES["SRC07"] = lambda spark, d: table(spark, d, "sources").select("source_key", captions.request_url(F.regexp_replace(_URLC(), "/$", "")).alias("request"))
SQL["SRC07"] = f"SELECT source_key, CASE WHEN {_PLAT} = 'bilibili' THEN regexp_replace(regexp_replace({_URL}, '/$', ''), '^([^?#]*/video/[^/?#]+)($|[?#])', '\\1/\\2') ELSE regexp_replace({_URL}, '/$', '') END AS request FROM sources"


@query(
    "SRC08",
    f"""WITH {SRCS} SELECT source_key, trim(source_id) AS source_id, coalesce(nullif(trim(title), ''), trim(source_id)) AS title, coalesce(nullif(trim(author), ''), platform) AS author,
round(CASE WHEN isfinite(duration_seconds) AND duration_seconds >= 0 THEN duration_seconds ELSE 0.0 END, 6) AS duration_seconds, coalesce(nullif(trim(webpage_url), ''), url) AS webpage_url FROM sr WHERE trim(source_id) <> ''""",
)
def downloader_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    body = F.struct(c("source_id").alias("id"), "title", c("author").alias("uploader"), c("platform").alias("channel"), F.when(~F.isnan("duration_seconds"), c("duration_seconds")).cast("string").alias("duration"), "webpage_url")
    j = s.select("source_key", "url", F.to_json(body).alias("json"))
    return captions.metadata(j, "source_key", "json", "url").withColumn("duration_seconds", F.round("duration_seconds", 6))


@query("SRC09", f"WITH {TR} SELECT source_key, trim(language) AS language, count(*) AS formats FROM tr WHERE source_key IS NOT NULL AND trim(coalesce(language, '')) <> '' GROUP BY 1, 2")
def track_listing(spark: SparkSession, d: str) -> DataFrame:
    t = current_transcripts(spark, d).where("source_key is not null").select("source_key", F.trim(F.coalesce("language", F.lit(""))).alias("language"), "transcript_id")
    lists = t.groupBy("source_key", "language").agg(F.collect_list("transcript_id").alias("formats"))
    maps = lists.groupBy("source_key").agg(F.map_from_entries(F.collect_list(F.struct("language", "formats"))).alias("m"))
    with_noise = maps.withColumn("m", F.map_concat("m", F.map_from_arrays(F.array(F.lit("live_chat"), F.lit("zz")), F.array(F.array(F.lit(1).cast("bigint")), F.array().cast("array<bigint>")))))
    return captions.listed_tracks(with_noise, "source_key", "m").withColumn("formats", c("formats").cast("bigint"))


@query("SRC15", f"SELECT DISTINCT observation_id, text, round(confidence, 6) AS confidence, round(x, 6) AS x, round(y, 6) AS y FROM observations WHERE trim(text) <> '' AND isfinite(confidence) AND isfinite(x) AND isfinite(y) AND observation_id % 9 <> 4")
def recogniser_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations")
    num = lambda n: F.when(tm.finite(c(n)), c(n)).alias(n)
    one = F.struct("text", num("confidence"), F.struct(num("x"), num("y"), num("width"), num("height")).alias("boundingBox"))
    body = F.struct(F.lit("r1").alias("engine"), F.array(F.struct(F.lit("f").alias("path"), F.lit(None).cast("string").alias("error"), F.array(one).alias("observations"))).alias("frames"))
    expected = F.when(c("observation_id") % 9 == 4, 2).otherwise(1).alias("expected")  # every ninth answer lacks a frame
    r = captions.readings(o.select("observation_id", expected, F.to_json(body).alias("json")), "observation_id", "json", "r1", "expected")
    return r.select("observation_id", "text", *[F.round(n, 6).alias(n) for n in ("confidence", "x", "y")]).distinct()


HEAD = f"""{TR}, {SRCS}, wn AS (SELECT transcript_id, warnings FROM transcripts QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST) = 1),
hd AS (SELECT tr.transcript_id, tr.language, tr.method, warnings, sr.*, CASE WHEN isfinite(duration_seconds) AND duration_seconds > 0 THEN CAST(floor(duration_seconds) AS BIGINT) ELSE 0 END AS seconds FROM tr JOIN sr USING (source_key) JOIN wn USING (transcript_id))"""
NUM = f"{CUE}, n0 AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id) AS place FROM cue), nb AS (SELECT *, (place - 1) // {render.MOST_CUES} AS part FROM n0)"


def _heads(spark: SparkSession, d: str) -> DataFrame:
    t = latest_by(table(spark, d, "transcripts"), "transcript_id", "created_at", "source_key", "language", "method", "warnings")
    s = _sources(spark, d).withColumn("seconds", F.when(tm.finite(c("duration_seconds")) & (c("duration_seconds") > 0), F.floor("duration_seconds")).otherwise(0))
    return t.join(s, "source_key")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return render.numbered(cu.cues(spark, d))


_RANGE = f"({sql_clock('s // 1000', False)}) || ' - ' || ({sql_clock('e // 1000', False)})"
_HEADER = f"""'# ' || coalesce(title, source_id) || chr(10) || chr(10) || '- Source: ' || coalesce(nullif(webpage_url, ''), url) || chr(10) || '- Platform: ' || platform || chr(10) || '- Author: ' || coalesce(nullif(author, ''), 'unknown')
|| chr(10) || '- Duration: ' || ({sql_clock('seconds', False)}) || chr(10) || '- Language: ' || coalesce(nullif(language, ''), 'unknown') || chr(10) || '- Extraction: ' || method || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10)"""
_WARN = "CASE WHEN len(coalesce(warnings, [])) > 0 THEN chr(10) || chr(10) || '## Warnings' || chr(10) || chr(10) || '- ' || array_to_string(warnings, chr(10) || '- ') ELSE '' END || chr(10)"


def _md(line: str) -> str:
    return f"WITH {NUM}, {HEAD}, bd AS (SELECT transcript_id, part, max(part) OVER (PARTITION BY transcript_id) AS last, string_agg({line}, chr(10) || chr(10) ORDER BY place) AS body FROM nb GROUP BY 1, 2) SELECT transcript_id, part, CASE WHEN part = 0 THEN {_HEADER} ELSE '' END || body || CASE WHEN part = last THEN {_WARN} ELSE chr(10) END AS document FROM hd JOIN bd USING (transcript_id)"


QUERIES["SNK01"] = lambda spark, d: render.markdown(_heads(spark, d), _numbered(spark, d), True)
SQL["SNK01"] = _md(f"'**[' || {_RANGE} || ']**' || chr(10) || chr(10) || text")
QUERIES["SNK02"] = lambda spark, d: render.markdown(_heads(spark, d), _numbered(spark, d), False)
SQL["SNK02"] = _md("text")
QUERIES["SNK03"] = lambda spark, d: render.bodies(_numbered(spark, d), render.text_line(), "\n", "document")
SQL["SNK03"] = f"WITH {NUM} SELECT transcript_id, part, string_agg('[' || {_RANGE} || '] ' || text, chr(10) ORDER BY place) AS document FROM nb GROUP BY 1, 2"


def _cue_sql(sep: str) -> str:
    esc = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"CAST(place AS VARCHAR) || chr(10) || {sql_stamp('s', sep)} || ' --> ' || {sql_stamp('greatest(e, s + 1)', sep)} || chr(10) || {esc}"


QUERIES["SNK04"] = lambda spark, d: render.bodies(_numbered(spark, d), render.cue_block(","), "\n\n", "document")
SQL["SNK04"] = f"WITH {NUM} SELECT transcript_id, part, string_agg({_cue_sql(',')}, chr(10) || chr(10) ORDER BY place) AS document FROM nb GROUP BY 1, 2"
QUERIES["SNK05"] = lambda spark, d: render.webvtt(_numbered(spark, d))
SQL["SNK05"] = f"WITH {NUM} SELECT transcript_id, part, CASE WHEN part = 0 THEN 'WEBVTT' || chr(10) || chr(10) ELSE '' END || string_agg({_cue_sql('.')}, chr(10) || chr(10) ORDER BY place) AS document FROM nb GROUP BY 1, 2"
QUERIES["SNK06"] = lambda spark, d: render.segments_json(_heads(spark, d), _numbered(spark, d))
QUERIES["SNK07"] = lambda spark, d: render.metadata_json(_heads(spark, d), _numbered(spark, d))
_META = "'url', url, 'platform', platform, 'source_id', source_id, 'title', title, 'author', author, 'duration_seconds', seconds, 'webpage_url', webpage_url, 'media_type', media_type"
SQL["SNK07"] = f"""WITH {CUE}, {HEAD}, n AS (SELECT transcript_id, count(*) AS n FROM cue GROUP BY 1)
SELECT transcript_id, CAST(json_object({_META}, 'language', language, 'extraction_method', method, 'segment_count', n, 'warnings', warnings) AS VARCHAR) AS payload FROM hd JOIN n USING (transcript_id)"""
SQL["SNK06"] = f"""WITH {NUM}, {HEAD}, sg AS (SELECT transcript_id, part, list(json_object('start_seconds', s / 1000, 'end_seconds', e / 1000, 'text', text, 'confidence', confidence) ORDER BY place) AS segments FROM nb GROUP BY 1, 2)
SELECT transcript_id, part, CAST(json_object('schema_version', 1, 'metadata', json_object({_META}), 'language', language, 'extraction_method', method, 'warnings', warnings, 'segments', segments) AS VARCHAR) AS payload FROM hd JOIN sg USING (transcript_id)"""
QUERIES["SNK09"] = lambda spark, d: _sources(spark, d).select("source_key", F.concat_ws("-", portable_name(F.coalesce("source_id", F.lit("")), F.lit("untitled")), portable_name(F.coalesce("title", F.lit("")), F.lit("untitled"))).alias("folder"))
QUERIES["STR22"] = lambda spark, d: render.bodies(_numbered(spark, d), c("text"), "\n", "document")
SQL["STR22"] = f"WITH {NUM} SELECT transcript_id, part, string_agg(text, chr(10) ORDER BY place) AS document FROM nb GROUP BY 1, 2"


QUERIES["FOLD02"] = lambda spark, d: folds.fold_frames(quality.frame_captions(table(spark, d, "observations")))
QUERIES["PIP05"] = lambda spark, d: recovered(spark, d)


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """Burned-in captions of each source: every content is recognised once and joined back by its digest, frames that were
    read count against the failure gate, and captions of the sources that pass it are folded.

    Here a third of the contents has been recognised before; only the others go through the recogniser's seam.
    """
    o = table(spark, d, "observations").dropDuplicates(["observation_id"]).where("source_key is not null")
    seen = o.where("text is not null").select(F.sha2("text", 256).alias("h"), "text").distinct()
    known = seen.where(F.pmod(F.xxhash64("h"), F.lit(3)) == 0)
    fresh = seen.join(known.select("h"), "h", "left_anti")  # what a recogniser is asked for
    read = known.unionByName(fresh).withColumnRenamed("text", "reading")
    looked_up = o.withColumn("h", F.sha2("text", 256)).join(read, "h", "left").drop("text").withColumnRenamed("reading", "text")
    failing = looked_up.groupBy("source_key").agg(F.avg(c("text").isNull().cast("double")).alias("failed")).where("failed > 0.1").select("source_key")
    return folds.fold_frames(quality.frame_captions(looked_up.join(failing, "source_key", "left_anti")))


def _frames_as_log(spark: SparkSession, d: str) -> DataFrame:
    """Cues as decoded frames: each is a run of samples of a thousand a second."""
    return cu.cues(spark, d).where("e > s").select(c("transcript_id").alias("media"), F.struct("s", "e", "segment_id").alias("place"), "s", (c("e") - c("s")).alias("length_ms"))


QUERIES["FOLD03"] = lambda spark, d: folds.decoded_runs(_frames_as_log(spark, d))
SQL["FOLD03"] = f"""WITH {CUE}, l AS (SELECT transcript_id, list({{'s': s, 'e': e}} ORDER BY s, e, segment_id) AS a FROM cue WHERE e > s GROUP BY 1),
f AS (SELECT transcript_id, list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN abs(x[1].s - acc[-1].e) <= 2
  THEN list_concat(acc[1:len(acc) - 1], [{{'s': acc[-1].s, 'e': acc[-1].e + x[1].e - x[1].s}}]) ELSE list_concat(acc, x) END) AS o FROM l)
SELECT transcript_id AS media, u.s AS run_start, u.e AS run_end FROM (SELECT transcript_id, unnest(o) AS u FROM f)"""


def _progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress lines of a decoder that reaches the latest end of all cues so far, and an end mark unless the id is a multiple of 7."""
    k = cu.cues(spark, d).groupBy("transcript_id").agg(F.max("e").alias("e"))
    lines = k.select(c("transcript_id").alias("media"), F.posexplode(F.array(F.concat(F.lit("out_time_us="), (F.floor(c("e") / 2) * 1000).cast("string")), F.concat(F.lit("out_time_us="), (c("e") * 1000).cast("string")), F.when(c("transcript_id") % 7 == 0, "progress=continue").otherwise("progress=end"))).alias("place", "line"))
    return lines


@query("AG15", f"WITH {CUE} SELECT transcript_id AS media, CASE WHEN transcript_id % 7 <> 0 AND max(e) > 0 THEN max(e) END AS end_ms FROM cue GROUP BY 1")
def decoder_progress(spark: SparkSession, d: str) -> DataFrame:
    return folds.decoded_end(_progress(spark, d))


@query(
    "PIP07",
    f"""WITH {SRCS}, {TR}, sb AS (SELECT DISTINCT source_key FROM tr WHERE method LIKE '%captions%'), m AS (SELECT sr.source_key, platform = 'local' AS local, coalesce(media_type = 'audio', false) AS audio, sb.source_key IS NOT NULL AS sub, mode
  FROM sr LEFT JOIN sb ON sr.source_key = sb.source_key, unnest(['auto', 'captions', 'ocr', 'whisper', 'hybrid']) AS t(mode))
SELECT source_key, mode, CASE mode WHEN 'captions' THEN 'platform-captions' WHEN 'ocr' THEN 'ocr' WHEN 'whisper' THEN 'whisper' WHEN 'hybrid' THEN 'ocr+whisper' ELSE CASE WHEN sub THEN 'platform-captions->ocr->whisper' WHEN local AND audio THEN 'whisper' ELSE 'ocr->whisper' END END AS route,
CASE WHEN NOT local AND sub AND mode IN ('auto', 'captions') THEN 'required' ELSE 'none' END AS subtitle_download,
CASE WHEN local OR mode = 'captions' THEN 'none' WHEN mode = 'auto' AND sub THEN 'conditional' ELSE 'required' END AS media_download,
CASE WHEN local OR mode = 'captions' THEN NULL WHEN mode = 'whisper' THEN 'audio' ELSE 'analysis-video' END AS purpose,
CASE WHEN NOT local AND mode IN ('auto', 'hybrid') THEN 'audio' END AS fallback,
CASE WHEN mode = 'captions' THEN sub WHEN local AND audio AND mode IN ('ocr', 'hybrid') THEN false ELSE true END AS processable FROM m""",
)
def preflight(spark: SparkSession, d: str) -> DataFrame:
    sub = current_transcripts(spark, d).where("method like '%captions%'").select("source_key").distinct().withColumn("has", F.lit(True))
    s = _sources(spark, d).join(sub, "source_key", "left").withColumn("has_subtitle", F.coalesce("has", F.lit(False)))
    return planning.plans(s)


def _stream_input(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Frame captions as files to stream, in the folder that the cluster shares; and that folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    f = quality.frame_captions(table(spark, d, "observations")).withColumn("last", F.lit(True)).select("source_key", "frame_ordinal", "timestamp_seconds", "text", "confidence", "last").where(tm.finite(c("timestamp_seconds")))
    # a source is one file, so that its frames come in order in one micro-batch
    f.repartition(64, "source_key").write.parquet(f"{base}/in")
    return stream.read_frames(spark, f"{base}/in"), base


def folded_stream(spark: SparkSession, d: str) -> DataFrame:
    frames, base = _stream_input(spark, d)
    stream.run_available(stream.fold_stream(frames), f"{base}/out", f"{base}/state")
    return spark.read.schema(folds.SEGMENT).parquet(f"{base}/out")


def streamed_contents(spark: SparkSession, d: str) -> DataFrame:
    frames, base = _stream_input(spark, d)
    stream.run_available(stream.once_per_content(frames).select("digest"), f"{base}/out", f"{base}/state")
    return spark.read.schema("digest string").parquet(f"{base}/out")


QUERIES["ST03"] = folded_stream
QUERIES["ST04"] = streamed_contents


@query("SRC13", f"WITH {MEDIA} SELECT media, ordinal, ordinal * 2000 AS at_ms, ordinal // 32 AS batch FROM media, unnest(range(0, (duration_ms - 1) // 2000 + 1)) AS t(ordinal) WHERE duration_ms > 0")
def sampling_grid(spark: SparkSession, d: str) -> DataFrame:
    return stream.frame_grid(_media(spark, d), 2000).where("error is null").drop("error")


@query("RES04", "SELECT source_key AS key, CASE WHEN coalesce(bool_and(source_key % 3 <> 0), false) THEN 'complete' ELSE 'downloading' END AS state FROM sources WHERE source_key IS NOT NULL GROUP BY 1")
def media_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Sources as downloads that ended; the file of every third isn't what was noted."""
    s = table(spark, d, "sources").where("source_key is not null")
    e = s.select(c("source_key").alias("key"), F.lit("complete").alias("state"), c("url").alias("path"), F.lit(5).alias("size"), F.when(c("source_key") % 3 == 0, 4).otherwise(5).alias("actual_size"), c("ingested_at").alias("at"))
    return incremental.manifest(e).select("key", "state")


@query("RES08", "SELECT transcript_id AS key, CASE WHEN NOT coalesce(verification_pending, true) THEN 'keep' WHEN source_key % 2 = 0 THEN 'active' ELSE 'remove' END AS action FROM transcripts WHERE source_key IS NOT NULL")
def incomplete_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").where("source_key is not null")
    return incremental.clearable(t.select(c("transcript_id").alias("key"), (~F.coalesce("verification_pending", F.lit(True))).alias("completed"), F.lit(False).alias("is_link"), (c("source_key") % 2 == 0).alias("locked")))


@query("RES10", f"WITH {TR} SELECT transcript_id FROM tr WHERE method NOT LIKE '%captions%' AND source_key IN (SELECT source_key FROM tr WHERE method LIKE '%captions%')")
def abandoned_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    t = current_transcripts(spark, d).withColumnRenamed("source_key", "key")
    return incremental.abandoned(t.where("method not like '%captions%'"), t.where("method like '%captions%'")).select("transcript_id")
