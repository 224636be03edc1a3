"""Queries for kept work, resumption, evidence, outside programs, files and streams, with SQL twins where SQL can say it.

Where the tables hold no such data (log lines, files, kept payloads), a query makes it from them first, with faults planted
by rule; its twin says what must come out of that, from the tables alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.catalog.pipelines import _numbered, _sources
from cuelake.catalog.relational import CUE, DUR, GAP, MEDIA, QUERIES, SPV, SQL, TR, UNI, WIN, WINDOW, _bounds, _chunked, _gaps, _media, c, query, windows
from cuelake.functions import times as tm
from cuelake.functions.identity import joined_key
from cuelake.operators import cues as cu
from cuelake.operators import folds, joins
from cuelake.plans import cache, incremental, verification
from cuelake.session import keep, shared_folder
from cuelake.sinks.bundles import Bundles
from cuelake.sources import captions, logs, seams
from cuelake.sources.tables import current_transcripts, latest_by, table
from cuelake.streaming import frames as stream

SRCS = "sr AS (SELECT DISTINCT ON (source_key) * FROM sources WHERE source_key IS NOT NULL ORDER BY source_key, ingested_at DESC)"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the folder that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Kept transcripts --------------------------------------------------------------------------------------------------------

OPTIONS = cache.Options()
_MS = "CASE WHEN isfinite(duration_seconds) THEN CAST(round(duration_seconds * 1000) AS BIGINT) END"
_Q = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
KEY = f"""sha256('{{"auth_scope":"' || sha256('anonymous') || '","caption_languages":["en"],"duration_ms":' || coalesce(CAST({_MS} AS VARCHAR), 'null') || ',"language":"auto","media_type":' || {_Q('media_type')}
|| ',"mode":"auto","ocr_profile":"balanced","ocr_region":[0.0,0.0,1.0,1.0],"pipeline_revision":"r1","platform":' || {_Q('platform')} || ',"requested_url":' || {_Q('trim(url)')} || ',"schema":1,"source_id":' || {_Q('source_id')}
|| ',"webpage_url":' || {_Q('trim(webpage_url)')} || ',"whisper_model":"small"}}')"""
WHOLE = f"""{CUE}, wh AS (SELECT DISTINCT transcript_id FROM cue), tw AS (SELECT transcript_id, source_key, language, method, coalesce(verification_pending, false) AS pending FROM transcripts
QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST, source_key DESC, language DESC, method DESC, verification_pending DESC) = 1),
of AS (SELECT min(transcript_id) AS transcript_id, source_key FROM tw JOIN wh USING (transcript_id) WHERE source_key IS NOT NULL GROUP BY source_key)"""


def _one_each(spark: SparkSession, d: str) -> DataFrame:
    """Heads of one transcript with cues for each source, as a cache keeps them."""
    t = latest_by(table(spark, d, "transcripts"), "transcript_id", "created_at", "source_key", "language", "method", "verification_pending", "warnings")
    whole = cu.cues(spark, d).select("transcript_id").distinct()
    first = t.join(whole, "transcript_id").where("source_key is not null").groupBy("source_key").agg(F.min("transcript_id").alias("transcript_id")).select("transcript_id")
    s = _sources(spark, d).withColumn("duration_seconds", F.when(tm.finite(c("duration_seconds")), c("duration_seconds")))
    return t.join(first, "transcript_id").withColumn("pending", F.coalesce("verification_pending", F.lit(False))).join(s, "source_key")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return cache.encode(_one_each(spark, d), _numbered(spark, d), cache.transcript_key(OPTIONS))


@query("JSN03", f"WITH {SRCS} SELECT source_key, {KEY} AS cache_key FROM sr")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("source_key", cache.transcript_key(OPTIONS).alias("cache_key"))


_SEG = "list(json_object('start_seconds', s / 1000, 'end_seconds', e / 1000, 'text', text, 'confidence', confidence) ORDER BY place)"


@query(
    "JSN02",
    f"""WITH {WHOLE}, {SRCS}, nb AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id) AS place FROM cue),
sg AS (SELECT transcript_id, count(*) AS cues, min(s) AS first_ms, max(e) AS last_ms, sum(length(text)) AS chars FROM nb GROUP BY 1)
SELECT transcript_id, {KEY} AS key, CAST(0 AS BIGINT) AS part, cues, first_ms, last_ms, CAST(chars AS BIGINT) AS chars FROM of JOIN sg USING (transcript_id) JOIN sr USING (source_key)""",
)
def encoded(spark: SparkSession, d: str) -> DataFrame:
    """Payloads, read back as plain JSON."""
    p = _payloads(spark, d).withColumn("s", F.from_json("payload", "transcript struct<segments: array<struct<start_seconds: double, end_seconds: double, text: string>>>").getField("transcript").getField("segments"))
    ms = lambda x: F.round(x * 1000).cast("bigint")
    return p.select(
        "transcript_id", "key", "part", F.size("s").cast("bigint").alias("cues"), ms(F.array_min(F.transform("s", lambda x: x["start_seconds"]))).alias("first_ms"),
        ms(F.array_max(F.transform("s", lambda x: x["end_seconds"]))).alias("last_ms"), F.aggregate(F.transform("s", lambda x: F.length(x["text"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("chars"),
    )


def _spoilt(spark: SparkSession, d: str) -> DataFrame:
    """Kept payloads with faults by the transcript's number: cut, other schema or revision, wrong types, bad times."""
    k = c("transcript_id") % 10
    swap = lambda a, b: F.regexp_replace("payload", a, b)
    p = (
        F.when(k == 1, F.expr("left(payload, length(payload) - 9)")).when(k == 2, swap('"schema":1', '"schema":2')).when(k == 3, swap('"pipeline_revision":"r1"', '"pipeline_revision":"r0"'))
        .when(k == 4, swap('"warnings":\\[[^\\]]*\\]', '"warnings":"none"')).when(k == 5, swap('"method":"[^"]*"', '"method":"guess"')).when(k == 6, swap('^(.*?)"start_seconds":([0-9.E]+)', '$1"start_seconds":"$2"'))
        .when(k == 7, swap('^(.*?)"start_seconds":[0-9.E]+', '$1"start_seconds":-1.0')).otherwise(c("payload"))
    )
    return _payloads(spark, d).select("transcript_id", "key", p.alias("payload"))


@query(
    "JSN01",
    f"""WITH {WHOLE}, {SRCS} SELECT {KEY} AS key, method, n AS cues FROM of JOIN tw USING (transcript_id, source_key) JOIN sr USING (source_key) JOIN (SELECT transcript_id, count(*) AS n FROM cue GROUP BY 1) USING (transcript_id)
WHERE NOT pending AND transcript_id % 10 NOT BETWEEN 1 AND 7""",
)
def decoded(spark: SparkSession, d: str) -> DataFrame:
    return cache.decode(_spoilt(spark, d)).select("key", "method", F.size("segments").cast("bigint").alias("cues"))


@query(
    "JN07",
    f"""WITH {WHOLE}, {SRCS}, k AS (SELECT source_key, pending FROM of JOIN tw USING (transcript_id, source_key))
SELECT sr.source_key, k.source_key IS NOT NULL AND NOT k.pending AND sr.source_key % 4 <> 0 AND sr.source_key % 6 <> 1 AS cached FROM sr LEFT JOIN k USING (source_key)""",
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sources that find their transcript; every fourth entry is another source's, and some sources have a new address."""
    s = _sources(spark, d).withColumn("duration_seconds", F.when(tm.finite(c("duration_seconds")), c("duration_seconds")))
    foreign = _payloads(spark, d).join(_one_each(spark, d).select("transcript_id", "source_key"), "transcript_id")
    foreign = foreign.withColumn("payload", F.when(c("source_key") % 4 == 0, F.regexp_replace("payload", '"source_id":"', '"source_id":"other ')).otherwise(c("payload")))
    moved = s.withColumn("webpage_url", F.when(c("source_key") % 6 == 1, F.concat(F.coalesce("webpage_url", F.lit("")), F.lit("?moved"))).otherwise(c("webpage_url")))
    return cache.lookup(moved, cache.decode(foreign), OPTIONS).select("source_key", "cached")


@query("RES01", f"WITH {WHOLE}, {SRCS}, k AS (SELECT source_key FROM of JOIN tw USING (transcript_id, source_key) WHERE NOT pending) SELECT source_key FROM sr WHERE source_key NOT IN (SELECT source_key FROM k)")
def work_to_do(spark: SparkSession, d: str) -> DataFrame:
    """Sources without a kept transcript."""
    s = _sources(spark, d).withColumn("duration_seconds", F.when(tm.finite(c("duration_seconds")), c("duration_seconds")))
    return cache.lookup(s, cache.decode(_payloads(spark, d)), OPTIONS).where("not cached").select("source_key")


@query(
    "RES02",
    f"""WITH {WHOLE}, {SRCS}, k AS (SELECT source_key FROM of JOIN tw USING (transcript_id, source_key) WHERE NOT pending), f AS (SELECT DISTINCT source_key FROM tw WHERE method LIKE '%captions%' AND NOT pending)
SELECT source_key, CASE WHEN source_key IN (SELECT source_key FROM f WHERE source_key IS NOT NULL) THEN 'captions' WHEN source_key IN (SELECT source_key FROM k) THEN 'cache' ELSE 'work' END AS origin FROM sr""",
)
def origins(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d).withColumn("duration_seconds", F.when(tm.finite(c("duration_seconds")), c("duration_seconds")))
    t = latest_by(table(spark, d, "transcripts"), "transcript_id", "created_at", "source_key", "language", "method", "verification_pending")
    fresh = t.where("method like '%captions%' and not coalesce(verification_pending, false) and source_key is not null")
    kept = cache.lookup(s, cache.decode(_payloads(spark, d)), OPTIONS).where("cached")
    return cache.chosen(s, fresh, kept)


@query("SNK10", f"WITH {WHOLE}, {SRCS} SELECT {KEY} AS key FROM of JOIN tw USING (transcript_id, source_key) JOIN sr USING (source_key) WHERE NOT pending")
def written_cache(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds after a write: pending transcripts are refused, and a second write of the same keys adds none."""
    store = incremental.Store(spark, _folder(spark, "transcripts"), "r1")
    heads = _one_each(spark, d).select("transcript_id", "pending", cache.identity_digest().alias("identity"))
    results = _payloads(spark, d).join(heads, "transcript_id").select("key", "identity", "payload", "pending")
    store.put(results)
    store.put(results)
    return store.rows().select("key")


@query("RES03", f"WITH {WHOLE}, {SRCS} SELECT pending, count(*) AS refused_or_missing FROM of JOIN tw USING (transcript_id, source_key) JOIN sr USING (source_key) WHERE pending GROUP BY 1")
def pending_is_never_kept(spark: SparkSession, d: str) -> DataFrame:
    """Work that is still to do after everything was put: the pending transcripts."""
    store = incremental.Store(spark, _folder(spark, "transcripts"), "r1")
    heads = _one_each(spark, d).select("transcript_id", "pending", cache.identity_digest().alias("identity"))
    results = _payloads(spark, d).join(heads, "transcript_id").select("key", "identity", "payload", "pending")
    store.put(results)
    return store.pending_work(results).groupBy("pending").agg(F.count(F.lit(1)).alias("refused_or_missing"))


# Resumption -------------------------------------------------------------------------------------------------------------------

OBS1 = "ob AS (SELECT DISTINCT ON (observation_id) * FROM observations WHERE source_key IS NOT NULL AND frame_ordinal IS NOT NULL)"


@query(
    "RES05",
    f"""WITH {OBS1} SELECT source_key, CAST(frame_ordinal // 32 AS BIGINT) AS batch, count(*) AS frames, source_key % 2 = 0 AND source_key % 4 <> 0 AS reused FROM ob GROUP BY ALL""",
)
def frame_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Batches of frames after an interrupted run that came to the sources with even keys; every fourth source's frames
    were cut anew since, so what was kept of it isn't of the same frames."""
    o = table(spark, d, "observations").dropDuplicates(["observation_id"]).where("source_key is not null and frame_ordinal is not null")
    digest = lambda salt: F.sha2(F.concat(F.coalesce("text", F.lit("")), salt), 256).alias("digest")
    before = incremental.frame_batches(o.select("source_key", "frame_ordinal", digest(F.when(c("source_key") % 4 == 0, "old").otherwise(""))), F.lit("accurate/0.25"))
    now = incremental.frame_batches(o.select("source_key", "frame_ordinal", digest(F.lit(""))), F.lit("accurate/0.25"))
    store = incremental.Store(spark, _folder(spark, "frames"), "r1")
    store.put(before.where("source_key % 2 = 0").select("key", "identity", F.lit("[]").alias("payload"), F.lit(False).alias("pending")))
    missing = store.pending_work(now).select("key", F.lit(True).alias("missing"))
    return now.join(missing, "key", "left").select("source_key", "batch", "frames", c("missing").isNull().alias("reused"))


@query("RES06", f"WITH {WIN} SELECT media, chunk, ws, we, chunk % 4 = 1 OR chunk % 4 = 2 AS reusable FROM win")
def reusable_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose result a store holds: two in four; a third was kept for other bounds. Every other one is silent."""
    w = windows(spark, d).where("chunk is not null")
    keyed = lambda end: (joined_key(F.lit("recipe"), c("media"), c("chunk")).alias("key"), F.concat_ws("-", c("ws").cast("string"), end.cast("string")).alias("identity"))
    kept = w.where("chunk % 4 > 0").select(*keyed(F.when(c("chunk") % 4 == 3, c("we") + 1).otherwise(c("we"))), F.when(c("chunk") % 4 == 1, "[]").otherwise('["x"]').alias("payload"), F.lit(False).alias("pending"))
    store = incremental.Store(spark, _folder(spark, "chunks"), "r1")
    store.put(kept)
    now = w.select("media", "chunk", "ws", "we", *keyed(c("we")))
    done = store.finished(now).select("key", F.lit(True).alias("done"))
    return now.join(done, "key", "left").select("media", "chunk", "ws", "we", c("done").isNotNull().alias("reusable"))


@query("FLT09", f"WITH {WIN} SELECT media, chunk, chunk % 8 IN (0, 1) AS valid FROM win")
def valid_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Kept chunks with faults by number: schema, revision, key, index, bounds, order; an empty one is valid."""
    k, length = c("chunk") % 8, c("we") - c("ws")
    cue = lambda s, e: F.struct(s.cast("bigint").alias("start_ms"), e.cast("bigint").alias("end_ms"), F.lit("x").alias("text"))
    good, later = cue(F.lit(0), length), cue(length, length)
    cues = F.when(k == 1, F.filter(F.array(good), lambda x: F.lit(False))).when(k == 6, F.array(cue(F.lit(0), length + 1))).when(k == 7, F.array(cue(length, length), cue(F.lit(0), F.lit(0)))).otherwise(F.array(good, later))
    body = F.struct(
        F.when(k == 2, 2).otherwise(1).alias("schema"), F.when(k == 3, "r0").otherwise("r1").alias("revision"), F.when(k == 4, "k").otherwise(c("key")).alias("key"),
        F.when(k == 5, c("chunk") + 1).otherwise(c("chunk")).cast("int").alias("index"), cues.alias("segments"),
    )
    w = windows(spark, d).where("chunk is not null").withColumn("key", joined_key(F.lit("recipe"), c("media"), c("chunk"))).withColumn("payload", F.to_json(body))
    return w.select("media", "chunk", incremental.valid_checkpoint(c("payload"), c("key"), c("chunk").cast("int"), length).alias("valid"))


@query(
    "PIP06",
    f"""WITH {CUE}, {TR}, {WIN}, ch AS (SELECT win.media, chunk, segment_id, ordinal, text, win.ws, win.we, greatest(cue.s - win.ws, 0) + chunk % 3 * 100 AS ls, cue.e - win.ws + chunk % 3 * 100 AS le
  FROM cue JOIN tr USING (transcript_id) JOIN win ON win.media = tr.source_key AND cue.s < win.we AND cue.e > win.ws),
rb AS (SELECT media, chunk, segment_id, text, ws + least(ls, we - ws) AS s, ws + least(le, we - ws) AS e FROM ch WHERE ls < we - ws),
k AS (SELECT media, chunk, segment_id, s, e FROM rb a WHERE NOT EXISTS (SELECT 1 FROM rb p WHERE p.media = a.media AND p.text = a.text AND p.chunk = a.chunk - 1 AND
CASE WHEN least(a.e - a.s, p.e - p.s) <= 0 THEN a.s = p.s AND a.e = p.e ELSE least(a.e, p.e) - greatest(a.s, p.s) >= 0.8 * least(a.e - a.s, p.e - p.s)
AND abs(a.s + a.e - p.s - p.e) / 2.0 <= greatest(200.0, 0.2 * least(a.e - a.s, p.e - p.s)) END)),
ru AS (SELECT media, count(*) FILTER (WHERE media % 2 = 0 AND chunk % 3 = 0) AS reused FROM win GROUP BY 1)
SELECT media, count(*) AS cues, CAST(sum(e - s) AS BIGINT) AS spoken_ms, 'l' || min(chunk) % 3 AS language, any_value(reused) AS reused FROM k JOIN ru USING (media) GROUP BY media""",
)
def chunked_transcription(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a store holds are reused, the rest recognised and kept; results are put on the medium's clock, copies at
    chunk borders go, and the first chunk with speech gives the language. The recogniser hears the cues, a little late."""
    w = windows(spark, d).where("chunk is not null")
    heard = _chunked(spark, d).groupBy("media", "chunk").agg(F.array_sort(F.collect_list(F.struct("s", "e", "segment_id", "ordinal", "text"))).alias("cues"))
    keyed = w.select("media", "chunk", "ws", "we", joined_key(F.lit("recipe"), c("media"), c("chunk")).alias("key"), F.concat_ws("-", c("ws").cast("string"), c("we").cast("string")).alias("identity"))
    kind = "struct<language: string, cues: array<struct<s: bigint, e: bigint, segment_id: bigint, ordinal: int, text: string>>>"

    def recognise(work: DataFrame) -> DataFrame:
        r = work.join(heard.hint("merge"), ["media", "chunk"], "left")
        body = F.struct(F.concat(F.lit("l"), (c("chunk") % 3).cast("string")).alias("language"), F.coalesce("cues", F.array().cast("array<struct<s: bigint, e: bigint, segment_id: bigint, ordinal: int, text: string>>")).alias("cues"))
        return r.select("key", "identity", F.to_json(body).alias("payload"), F.lit(False).alias("pending"))

    store = incremental.Store(spark, _folder(spark, "speech"), "r1")
    store.put(recognise(keyed.where("media % 2 = 0 and chunk % 3 = 0")))
    reused = store.finished(keyed).groupBy("media").agg(F.count(F.lit(1)).alias("reused"))
    reused = incremental.snapshot(reused, _folder(spark, "reused"))
    done = incremental.run_incrementally(store, keyed, recognise).select("media", "chunk", "ws", "we", F.from_json("payload", kind).alias("r"))
    from cuelake.operators import chunks

    rows = done.select("media", "chunk", "ws", "we", "r.language", F.explode("r.cues").alias("x")).select("media", "chunk", "ws", "we", "language", "x.segment_id", "x.s", "x.e", "x.text")
    kept = joins.without_boundary_copies(chunks.rebase(rows), "media", *WINDOW)
    g = kept.groupBy("media").agg(F.count(F.lit(1)).alias("cues"), F.sum(c("e") - c("s")).alias("spoken_ms"), F.min_by("language", "chunk").alias("language"))
    return g.join(reused, "media", "left").select("media", "cues", "spoken_ms", "language", F.coalesce("reused", F.lit(0)).alias("reused"))


@query("RES07", f"WITH {MEDIA} SELECT true AS warned, count(*) AS results FROM media")
def degraded_store(spark: SparkSession, d: str) -> DataFrame:
    """A store whose folder can't be used keeps nothing and stops nothing."""
    store, warning = incremental.open_store(spark, "nosuchscheme://folder/store", "r1")
    work = _media(spark, d).select(joined_key(c("media")).alias("key"), F.lit("i").alias("identity"))
    done = incremental.run_incrementally(store, work, lambda w: w.select("key", "identity", F.lit("{}").alias("payload"), F.lit(False).alias("pending")))
    return done.agg(F.lit(warning is not None).alias("warned"), F.count(F.lit(1)).alias("results"))


@query("RES09", f"WITH {MEDIA} SELECT media % 2 = 0 AS even, count(*) AS results FROM media GROUP BY 1")
def ephemeral_store(spark: SparkSession, d: str) -> DataFrame:
    """The same interface without a folder: what one run put is there for that run."""
    store, _ = incremental.open_store(spark, None, "r1")
    work = _media(spark, d).select(joined_key(c("media")).alias("key"), F.lit("i").alias("identity"), (c("media") % 2 == 0).alias("even"))
    compute = lambda w: w.select("key", "identity", F.lit("{}").alias("payload"), F.lit(False).alias("pending"))
    incremental.run_incrementally(store, work.where("even"), compute)
    return incremental.run_incrementally(store, work, compute).groupBy("even").agg(F.count(F.lit(1)).alias("results"))


@query(
    "AG09",
    """SELECT method, count(*) FILTER (WHERE coalesce(verification_pending, true) AND source_key % 2 <> 0) AS removed, count(*) FILTER (WHERE coalesce(verification_pending, true) AND source_key % 2 = 0) AS active,
count(*) FILTER (WHERE NOT coalesce(verification_pending, true)) AS kept FROM transcripts WHERE source_key IS NOT NULL GROUP BY 1""",
)
def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "transcripts").where("source_key is not null").select(c("transcript_id").alias("key"), "method", (~F.coalesce("verification_pending", F.lit(True))).alias("completed"), F.lit(False).alias("is_link"), (c("source_key") % 2 == 0).alias("locked"))
    return incremental.cleanup_counts(incremental.clearable(t, "method"), "method")


# Evidence ---------------------------------------------------------------------------------------------------------------------

#: Logs are made for transcripts with long gaps: silences in all gaps (but the first of every third transcript), frames of
#: a thousand samples a second over the whole medium (with a hole in the first gap of every eleventh), and faults: every
#: seventh doesn't end, every fifth has an unreadable silence line.
FACTS = f"{CUE}, {UNI}, {DUR}, {GAP}, g1 AS (SELECT transcript_id, min(gs) AS first FROM gap GROUP BY 1)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    g = keep(_gaps(spark, d)).withColumnRenamed("transcript_id", "media")
    first = g.groupBy("media").agg(F.min("gap_start_ms").alias("first"))
    ends = _bounds(spark, d).where("limit_ms is not null").select(c("key").alias("media"), "limit_ms").join(first, "media")
    sec = lambda x: F.format_string("%.3f", x / 1000.0)
    info = lambda s, e: F.concat(F.lit("[Parsed_ashowinfo_0 @ 0x1] n:0 pts:0 pts_time:"), sec(s), F.lit(" rate:1000 channels:1 nb_samples:"), (e - s).cast("string"))
    hole = c("first") + 20_000
    runs = F.when(c("media") % 11 == 0, F.array(info(F.lit(0), hole), info(hole + 3, c("limit_ms")))).otherwise(F.array(info(F.lit(0), c("limit_ms"))))
    frames = ends.select("media", F.posexplode(runs).alias("n", "line")).select("media", (c("n") - 10).cast("bigint").alias("at"), F.lit(0).alias("k"), "line")
    quiet = g.join(first, "media").where("not (media % 3 = 0 and gap_start_ms = first)")
    event = F.array(F.concat(F.lit("[silencedetect @ 0x2] silence_start: "), sec(c("gap_start_ms"))), F.concat(F.lit("[silencedetect @ 0x2] silence_end: "), sec(c("gap_end_ms")), F.lit(" | silence_duration: 1")))
    silence = quiet.select("media", "gap_start_ms", "gap_end_ms", F.posexplode(event).alias("k", "line")).select("media", F.when(c("k") == 0, c("gap_start_ms")).otherwise(c("gap_end_ms")).alias("at"), (F.lit(1) - c("k")).alias("k"), "line")
    fault = ends.where("media % 5 = 0").select("media", F.lit(10**14).alias("at"), F.lit(0).alias("k"), F.lit("[silencedetect @ 0x2] silence_start: soon").alias("line"))
    noise = ends.select("media", F.lit(-50).cast("bigint").alias("at"), F.lit(0).alias("k"), F.lit("Stream #0:0: Audio: silence_start of nothing").alias("line"))
    return keep(frames.unionByName(silence).unionByName(fault).unionByName(noise).select("media", F.struct("at", "k").alias("place"), "line"))


def _progress(spark: SparkSession, d: str) -> DataFrame:
    e = _bounds(spark, d).where("limit_ms is not null").select(c("key").alias("media"), "limit_ms")
    lines = F.array(F.concat(F.lit("out_time_us="), (F.floor(c("limit_ms") / 2) * 1000).cast("string")), F.concat(F.lit("out_time_us="), (c("limit_ms") * 1000).cast("string")), F.when(c("media") % 7 == 0, "progress=continue").otherwise("progress=end"))
    return e.select("media", F.posexplode(lines).alias("place", "line"))


def _silences(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
    ends = _bounds(spark, d).where("limit_ms is not null").select(c("key").alias("media"), c("limit_ms").alias("end_ms"))
    return folds.silences(logs.silence_lines(log).join(ends, "media"))


@query("WN08", f"WITH {FACTS} SELECT transcript_id AS media, gs AS s, ge AS e FROM gap JOIN g1 USING (transcript_id) WHERE transcript_id % 5 <> 0 AND NOT (transcript_id % 3 = 0 AND gs = first)")
def paired_silences(spark: SparkSession, d: str) -> DataFrame:
    return _silences(spark, d, _log(spark, d))


@query("AUD01", f"WITH {FACTS} SELECT transcript_id AS media, 0 AS run_start, first + 20000 AS run_end FROM g1 WHERE transcript_id % 11 = 0 UNION ALL SELECT transcript_id, CASE WHEN transcript_id % 11 = 0 THEN first + 20003 ELSE 0 END, d FROM g1 JOIN dur USING (transcript_id)")
def heard_runs(spark: SparkSession, d: str) -> DataFrame:
    """What a probe's log says was really decoded; the probe itself is a seam that returns such lines."""
    return folds.decoded_runs(logs.frame_lines(_log(spark, d)), per_ms=logs.PER_MS)


ACTIVITY = "CASE WHEN transcript_id % 7 = 0 OR transcript_id % 11 = 0 THEN 'unknown' WHEN transcript_id % 5 = 0 OR transcript_id % 3 = 0 THEN 'active' ELSE 'silent' END"


def _activity(spark: SparkSession, d: str) -> DataFrame:
    g, log = keep(_gaps(spark, d)).withColumnRenamed("transcript_id", "media"), _log(spark, d)
    return folds.audio_activity(g, folds.decoded_end(_progress(spark, d)), keep(folds.decoded_runs(logs.frame_lines(log), per_ms=logs.PER_MS)), keep(_silences(spark, d, log)))


@query("PIP09", f"WITH {FACTS} SELECT DISTINCT transcript_id AS media, {ACTIVITY} AS activity FROM gap")
def audio_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity in the long gaps of each medium, from its log: how far it was decoded, without holes, and where it is silent."""
    return _activity(spark, d)


@query("FLT07", f"WITH {FACTS}, lg AS (SELECT transcript_id, max(gs) AS gs, max(ge) AS ge FROM gap JOIN g1 USING (transcript_id) WHERE NOT (transcript_id % 3 = 0 AND gs = first) GROUP BY 1) SELECT transcript_id AS media, CASE WHEN ge >= d - 500 THEN least(d, gs + 250) ELSE d END AS clip_ms FROM dur LEFT JOIN lg USING (transcript_id) WHERE d IS NOT NULL")
def trimmed_ends(spark: SparkSession, d: str) -> DataFrame:
    return logs.clip_ends(_log(spark, d), _bounds(spark, d).where("limit_ms is not null").select(c("key").alias("media"), c("limit_ms").alias("duration_ms")))


VERIFIED = f"""WITH {FACTS}, {SPV}, near AS (SELECT DISTINCT sp.segment_id, sp.transcript_id FROM sp JOIN gap ON gap.transcript_id = sp.transcript_id AND ((sp.s < ge AND sp.e > gs) OR (sp.s = sp.e AND gs <= sp.s AND sp.s < ge))),
n AS (SELECT transcript_id, count(*) AS gaps FROM gap GROUP BY 1), m AS (SELECT transcript_id, count(*) AS k FROM near GROUP BY 1),
v AS (SELECT tr.transcript_id, tr.method, coalesce(gaps, 0) AS gaps, CASE WHEN tr.transcript_id % 13 = 0 THEN 0 ELSE coalesce(k, 0) END AS supplements,
  CASE WHEN gaps IS NULL OR {ACTIVITY.replace('transcript_id', 'tr.transcript_id')} = 'silent' THEN 'complete' WHEN tr.transcript_id % 13 = 0 THEN 'pending' WHEN coalesce(k, 0) > 0 THEN 'supplemented' ELSE 'reviewed' END AS state
  FROM tr LEFT JOIN n USING (transcript_id) LEFT JOIN m USING (transcript_id))"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    """Recognition of every thirteenth transcript fails."""
    g, t = keep(_gaps(spark, d)), current_transcripts(spark, d)
    speech, _ = cu.speech_and_visible(cu.cues(spark, d))
    n = joins.touching(speech, g, "transcript_id").groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))
    heard = t.select("transcript_id").join(n, "transcript_id", "left").select("transcript_id", F.when(c("transcript_id") % 13 != 0, F.coalesce("n", F.lit(0))).alias("supplements"))
    return verification.verified(t.select("transcript_id", "method"), g, _activity(spark, d).withColumnRenamed("media", "transcript_id"), heard)


@query("PIP02", f"{VERIFIED} SELECT transcript_id, gaps, supplements, state, CASE WHEN state <> 'supplemented' THEN method WHEN method = 'platform-captions' THEN 'platform-captions-whisper' WHEN method = 'local-captions' THEN 'local-captions-whisper' ELSE 'ocr-whisper' END AS method FROM v")
def verified_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("transcript_id", "gaps", "supplements", "state", "method")


@query("PIP03", f"{VERIFIED} SELECT transcript_id, CASE WHEN gaps > 0 AND transcript_id % 9 = 4 THEN 'pending' ELSE state END AS state, (gaps > 0 AND transcript_id % 9 = 4) OR state = 'pending' AS pending FROM v")
def caption_verification(spark: SparkSession, d: str) -> DataFrame:
    """The sound of every ninth transcript can't be fetched."""
    fetched = current_transcripts(spark, d).select("transcript_id", (c("transcript_id") % 9 != 4).alias("fetched"))
    return verification.with_fetch(_verified(spark, d), fetched)


@query(
    "PIP04",
    f"""WITH {TR}, {SRCS}, b AS (SELECT source_key, bool_or(method LIKE '%captions%') AS captions, bool_or(contains(method, 'ocr')) AS ocr, bool_or(contains(method, 'whisper')) AS w FROM tr GROUP BY 1),
q AS (SELECT sr.source_key, mode, coalesce(media_type = 'audio', false) AS a, coalesce(captions, false) AND mode IN ('auto', 'captions') AS c, CASE WHEN ocr THEN 'usable' WHEN w THEN 'failed' ELSE 'unusable' END AS o
  FROM sr LEFT JOIN b USING (source_key), unnest(['auto', 'captions', 'ocr', 'whisper', 'hybrid']) AS t(mode)),
r AS (SELECT *, CASE WHEN c THEN NULL WHEN mode = 'captions' THEN 'no usable captions' WHEN a AND mode IN ('ocr', 'hybrid') THEN 'sound alone has no text to read' WHEN mode = 'ocr' AND o = 'failed' THEN 'reading failed'
  WHEN mode = 'ocr' AND o = 'unusable' THEN 'no usable text on screen' END AS error FROM q)
SELECT source_key, mode, CASE WHEN error IS NULL THEN CASE WHEN c THEN 'captions' WHEN mode = 'whisper' OR a THEN 'whisper' WHEN o = 'usable' THEN CASE mode WHEN 'hybrid' THEN 'ocr-whisper' ELSE 'ocr' END ELSE 'whisper' END END AS method,
CASE WHEN error IS NULL AND NOT c AND mode <> 'whisper' AND NOT a AND o <> 'usable' THEN CASE o WHEN 'failed' THEN 'reading failed, speech was used' ELSE 'text on screen was unusable, speech was used' END END AS warning, error FROM r""",
)
def acquisition(spark: SparkSession, d: str) -> DataFrame:
    t = current_transcripts(spark, d).where("source_key is not null")
    b = t.groupBy("source_key").agg(F.bool_or(c("method").like("%captions%")).alias("captions"), F.bool_or(c("method").contains("ocr")).alias("o"), F.bool_or(c("method").contains("whisper")).alias("w"))
    ocr = F.when(c("o"), "usable").when(c("w"), "failed").otherwise("unusable")
    s = _sources(spark, d).join(b, "source_key", "left").withColumn("mode", F.explode(F.array(*map(F.lit, ["auto", "captions", "ocr", "whisper", "hybrid"]))))
    return verification.acquired(s.select("source_key", "mode", (c("media_type") == "audio").alias("audio_only"), "captions", ocr.alias("ocr")))


@query("FLT08", "SELECT transcript_id, transcript_id % 4 IN (0, 1, 2) AS fallback FROM transcripts")
def error_class(spark: SparkSession, d: str) -> DataFrame:
    k = c("transcript_id") % 4
    message = F.when(k == 0, "RuntimeError: CUDA   out of\nmemory").when(k == 1, "Library libcublas.so.12 is not found").when(k == 2, "compute type FLOAT16 isn't supported").otherwise("the file has no audio stream")
    return table(spark, d, "transcripts").select("transcript_id", logs.device_error(message).alias("fallback"))


@query("AG10", f"WITH {SRCS}, {TR}, k AS (SELECT DISTINCT source_key FROM tr WHERE method LIKE '%captions%') SELECT source_key, coalesce(isfinite(duration_seconds) AND duration_seconds > 0, false) AND k.source_key IS NOT NULL AS ready, concat_ws(',', CASE WHEN k.source_key IS NULL THEN 'captions' END, CASE WHEN NOT coalesce(isfinite(duration_seconds) AND duration_seconds > 0, false) THEN 'duration' END) AS failing FROM sr LEFT JOIN k USING (source_key)")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    """Checks of each source: captions and a duration are required, a title isn't."""
    k = current_transcripts(spark, d).where("method like '%captions%'").select("source_key").distinct().withColumn("k", F.lit(True))
    one = lambda name, required, ok: F.struct(F.lit(name).alias("name"), F.lit(required).alias("required"), ok.alias("ok"))
    known = tm.finite(c("duration_seconds")) & (c("duration_seconds") > 0)
    s = _sources(spark, d).join(k, "source_key", "left").select("source_key", F.explode(F.array(one("captions", True, c("k")), one("duration", True, known), one("title", False, c("title").isNotNull()))).alias("x"))
    return verification.ready(s.select("source_key", "x.*"), "source_key")


@query(
    "JN08",
    f"""WITH {OBS1}, l AS (SELECT source_key, CAST(frame_ordinal // 32 AS BIGINT) AS batch, count(DISTINCT frame_ordinal) AS frames, count(*) AS found FROM ob GROUP BY ALL)
SELECT source_key, batch, frames, CASE WHEN frames = found THEN frames END AS paired FROM l""",
)
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a batch with what was read in them, place by place; a batch with another number of readings has no pairs."""
    o = table(spark, d, "observations").dropDuplicates(["observation_id"]).where("source_key is not null and frame_ordinal is not null").withColumn("batch", F.floor(c("frame_ordinal") / 32))
    g = o.groupBy("source_key", "batch").agg(F.array_sort(F.collect_set("frame_ordinal")).alias("f"), F.array_sort(F.collect_list(F.struct("frame_ordinal", "observation_id"))).alias("r"))
    pairs = verification.paired(c("f"), c("r"))
    right = F.forall(pairs, lambda p: p["left"] == p["right"]["frame_ordinal"])
    return g.select("source_key", "batch", F.size("f").cast("bigint").alias("frames"), F.when(right, F.size(pairs).cast("bigint")).alias("paired"))


# Outside programs -------------------------------------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#:]*)', 1)), '\\.$', '')"


def resolve(url: str) -> str:
    """The host of a web address."""
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.scheme.lower() not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not a web address:\n{parts.scheme}")
    return parts.hostname.rstrip(".")


@query(
    "PIP08",
    f"""WITH i AS (SELECT trim(coalesce(url, '')) AS url, min(source_key) AS ordinal FROM sources GROUP BY 1) SELECT ordinal, url, nullif({_HOST}, '') AS result,
CASE WHEN url = '' THEN 'an empty input' WHEN {_HOST} = '' THEN 'not a web address: ' || lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) END AS error FROM i""",
)
def queue(spark: SparkSession, d: str) -> DataFrame:
    r = seams.queued(table(spark, d, "sources").select(c("source_key").alias("ordinal"), "url"), "url", resolve, at_once=4)
    return r.select("ordinal", "url", "result", F.trim("error").alias("error"))


@query("AG11", f"WITH i AS (SELECT DISTINCT platform, trim(url) AS url FROM sources WHERE trim(url) <> '') SELECT platform, bool_and({_HOST} <> '') AS success, count(*) AS results FROM i GROUP BY 1")
def batch_success(spark: SparkSession, d: str) -> DataFrame:
    """A platform's batch succeeds if every input of it did."""
    i = table(spark, d, "sources").select("platform", F.trim("url").alias("url")).where("url <> ''").distinct()
    return seams.apply_isolated(i, "url", resolve, ()).groupBy("platform").agg(F.bool_and(c("error").isNull()).alias("success"), F.count(F.lit(1)).alias("results"))


def fetched_info(url: str) -> str:
    """A downloader stands behind this in production; here it knows addresses by their text."""
    return json.dumps({"id": url.rsplit("/", 1)[-1] or None, "title": " ", "uploader": "", "channel": resolve(url), "duration": "12.5", "webpage_url": ""})


@query("SRC10", f"WITH i AS (SELECT min(source_key) AS k, trim(url) AS url FROM sources WHERE trim(url) <> '' GROUP BY url), j AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS id FROM i) SELECT k, trim(id) AS source_id, trim(id) AS title, {_HOST} AS author, 12.5 AS duration_seconds, url AS webpage_url FROM j WHERE {_HOST} <> '' AND trim(id) <> ''")
def fetched_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata through the fetcher's seam: failing inputs are left out here, their errors stay with the caller."""
    i = table(spark, d, "sources").withColumn("url", F.trim("url")).where("url <> ''").groupBy("url").agg(F.min("source_key").alias("k"))
    got = seams.apply_isolated(i.select("k", "url"), "url", fetched_info, ()).where("error is null")
    return captions.metadata(got, "k", "result", "url")


def flaky(value: str) -> str:
    """Fails as many times as its first number says, with an error that may pass; 9 fails for good."""
    wanted, calls = int(value[0]), 0

    def once() -> int:
        nonlocal calls
        calls += 1
        if wanted == 9:
            raise ValueError("gone for good")
        if calls <= wanted:
            raise seams.Transient("busy")
        return calls

    return str(seams.with_retries(once, (0.0, 0.0, 0.0)))


@query("SRC11", f"WITH {SRCS}, k AS (SELECT source_key, source_key % 5 AS n FROM sr) SELECT source_key, CASE WHEN n <= 3 THEN CAST(n + 1 AS VARCHAR) END AS result, CASE WHEN n = 4 THEN 'gone for good' END AS error FROM k")
def retries(spark: SparkSession, d: str) -> DataFrame:
    k = _sources(spark, d).select("source_key", F.when(c("source_key") % 5 == 4, "9").otherwise((c("source_key") % 5).cast("string")).alias("v"))
    return seams.apply_isolated(k, "v", flaky, ()).select("source_key", "result", "error")


@query("SRC12", f"WITH {SRCS} SELECT source_key AS media, CASE WHEN source_key % 3 = 0 THEN 'b.m4a' ELSE 'a.webm' END AS path, CAST(CASE WHEN source_key % 3 = 0 THEN 300 ELSE 200 END AS BIGINT) AS size FROM sr WHERE source_key % 5 <> 0")
def downloaded_file(spark: SparkSession, d: str) -> DataFrame:
    """The file of a download: the largest finished one; every fifth download has only parts."""
    one = lambda p, n: F.struct(F.lit(p).alias("path"), n.cast("bigint").alias("size"))
    k = c("source_key")
    done = F.when(k % 5 == 0, F.array(one("a.webm.part", F.lit(900)))).otherwise(F.array(one("a.webm", F.lit(200)), one("b.m4a", F.when(k % 3 == 0, 300).otherwise(200)), one("c.webm.part", F.lit(900))))
    f = _sources(spark, d).select(k.alias("media"), F.explode(done).alias("f")).select("media", "f.*")
    return seams.finished_files(f)


@query("SRC16", f"WITH {SRCS} SELECT source_key, CASE source_key % 4 WHEN 0 THEN 'anonymous' WHEN 1 THEN 'cookie-file:' || sha256(source_id) END AS scope, source_key % 4 = 3 AS refused FROM sr WHERE source_id IS NOT NULL")
def authentication(spark: SparkSession, d: str) -> DataFrame:
    """Cookies of a browser or of a file: both are refused, and a browser's can't be part of a key."""

    def checked(value: str) -> str:
        browser, _, file = value.partition("|")
        return seams.Authentication(browser or None, file or None).scope() or ""

    k = c("source_key") % 4
    v = F.concat(F.when(k >= 2, "firefox").otherwise(""), F.lit("|"), F.when(k.isin(1, 3), c("source_id")).otherwise(""))
    r = seams.apply_isolated(_sources(spark, d).where("source_id is not null").select("source_key", v.alias("v")), "v", checked, ())
    return r.select("source_key", F.nullif("result", F.lit("")).alias("scope"), c("error").isNotNull().alias("refused"))


# Files ------------------------------------------------------------------------------------------------------------------------


def _bundle(spark: SparkSession, files: DataFrame, folder: str) -> None:
    spark.dataSource.register(Bundles)
    files.select("path", "content").write.format("bundles").option("path", folder).mode("append").save()


_NAME = lambda: F.regexp_extract("path", r"([^/]+)$", 1)


@query("SNK08", f"WITH {SRCS} SELECT 's' || source_key || '.txt' AS name, 'local-' || sha256('# ' || coalesce(title, '')) AS content_id FROM sr")
def bundles_survive(spark: SparkSession, d: str) -> DataFrame:
    """Files after a good write and a failed one over it: all of the old, none of the new."""
    folder = _folder(spark, "bundle")
    s = _sources(spark, d).select(F.concat(F.lit("s"), c("source_key").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("# "), F.coalesce("title", F.lit(""))).alias("content"))
    _bundle(spark, s, folder)
    try:
        _bundle(spark, s.withColumn("content", F.lit("new")).unionByName(spark.createDataFrame([("../out.txt", "x")], "path string, content string")), folder)
    except Exception as x:
        if "leads out of the folder" not in str(x):
            raise
    return captions.content_ids(spark, folder).select(_NAME().alias("name"), "content_id")


@query("SRC05", f"WITH {SRCS} SELECT 's' || source_key || '.txt' AS name, 'local-' || sha256('# ' || coalesce(title, '')) AS content_id, CAST(strlen('# ' || coalesce(title, '')) AS BIGINT) AS size FROM sr")
def content_identity(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "contents")
    _bundle(spark, _sources(spark, d).select(F.concat(F.lit("s"), c("source_key").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("# "), F.coalesce("title", F.lit(""))).alias("content")), folder)
    return captions.content_ids(spark, folder).select(_NAME().alias("name"), "content_id", "size")


@query("AG08", f"WITH {SRCS}, f AS (SELECT coalesce(nullif(trim(platform), ''), 'none') AS k, strlen('# ' || coalesce(title, '')) AS n FROM sr) SELECT coalesce(k, 'total') AS class, count(*) AS files, CAST(sum(n) AS BIGINT) AS size FROM f GROUP BY ROLLUP (k)")
def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "usage")
    s = _sources(spark, d).withColumn("k", F.coalesce(F.nullif(F.trim("platform"), F.lit("")), F.lit("none")))
    _bundle(spark, s.select(F.concat("k", F.lit("/s"), c("source_key").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("# "), F.coalesce("title", F.lit(""))).alias("content")), folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return incremental.usage_by_class(files)


@query(
    "SRC02",
    f"""WITH {SRCS} SELECT 'm' || source_key AS stem, 'm' || source_key || CASE WHEN source_key % 3 = 0 AND source_key % 2 = 0 THEN '.vtt' ELSE '.srt' END AS name, CAST(1 AS BIGINT) AS cues, source_key % 3 = 0 AND source_key % 2 <> 0 AS warned
FROM sr WHERE (source_key % 3 = 0 AND source_key % 2 = 0) OR source_key % 5 = 0""",
)
def sidecar_choice(spark: SparkSession, d: str) -> DataFrame:
    """Files beside media: WebVTT for every third, without any cue for odd ones, SubRip for every fifth."""
    folder = _folder(spark, "sidecars")
    k = _sources(spark, d).select("source_key")
    stem = F.concat(F.lit("m"), c("source_key").cast("string"))
    vtt = k.where("source_key % 3 = 0").select(F.concat(stem, F.lit(".vtt")).alias("path"), F.when(c("source_key") % 2 == 0, "WEBVTT\n\n00:01.000 --> 00:02.000\nhello\n").otherwise("WEBVTT\n\nNOTE nothing\n").alias("content"))
    srt = k.where("source_key % 5 = 0").select(F.concat(stem, F.lit(".srt")).alias("path"), F.lit("1\n00:00:01,000 --> 00:00:02,000\nhello\n").alias("content"))
    media = k.select(F.concat(stem, F.lit(".mp4")).alias("path"), F.lit("00:01.000 --> 00:02.000\nno captions").alias("content"))
    _bundle(spark, vtt.unionByName(srt).unionByName(media), folder)
    s = captions.sidecars(captions.caption_files(spark, folder))
    return s.select("stem", _NAME().alias("name"), "cues", c("warning").isNotNull().alias("warned"))


@query("SRC13_split", f"WITH {MEDIA} SELECT media, ordinal, ordinal * 500 AS at_ms, sha256(unhex('FFD8' || lpad(CAST(media AS VARCHAR), 12, '0') || '0' || ordinal || 'FFD9')) AS digest FROM media, unnest(range(0, media % 4 + 1)) AS t(ordinal)")
def split_streams(spark: SparkSession, d: str) -> DataFrame:
    """Images of recorded byte streams; bytes between images are no part of them."""
    image = lambda i: F.concat(F.lit("00FF"), F.lit("FFD8"), F.lpad(c("media").cast("string"), 12, "0"), F.lit("0"), i.cast("string"), F.lit("FFD9"))
    m = _media(spark, d).select("media", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (c("media") % 4).cast("int")), image), "")).alias("content"))
    return stream.frames_of_streams(m, 500).where("error is null").select("media", "ordinal", "at_ms", "digest")


# Streams ----------------------------------------------------------------------------------------------------------------------

PER_SOURCE = "SELECT source_key, min(frame_ordinal) AS first, max(frame_ordinal) AS last, count(DISTINCT frame_ordinal) AS frames FROM observations WHERE source_key IS NOT NULL AND frame_ordinal IS NOT NULL GROUP BY 1"


def _frame_files(spark: SparkSession, d: str, folder: str) -> None:
    """Frames as files to stream: some two hundred, whatever their order."""
    o = table(spark, d, "observations").where("source_key is not null and frame_ordinal is not null")
    o.select("source_key", "frame_ordinal").distinct().repartition(200, "source_key", "frame_ordinal").write.parquet(folder)


def _streamed(spark: SparkSession, d: str, batch_files: int, failing: int | None = None) -> tuple[DataFrame, str]:
    folder = _folder(spark, "stream")
    _frame_files(spark, d, f"{folder}/in")
    frames = lambda: stream.read_frames(spark, f"{folder}/in", "source_key bigint, frame_ordinal int", batch_files)
    with stream.single_flight(folder):
        if failing is not None:
            try:
                stream.write_batches(frames(), ["source_key", "frame_ordinal"], f"{folder}/out", f"{folder}/state", failing)
            except Exception as x:
                if "planned failure" not in str(x):
                    raise
        stream.write_batches(frames(), ["source_key", "frame_ordinal"], f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out"), folder


def _per_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_key").agg(F.min("frame_ordinal").alias("first"), F.max("frame_ordinal").alias("last"), F.countDistinct("frame_ordinal").alias("frames"))


@query("ST01", PER_SOURCE)
def bounded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Frames streamed in micro-batches of at most 32 files."""
    rows, _ = _streamed(spark, d, 32)
    return _per_source(rows)


@query("ST02", PER_SOURCE)
def batch_independence(spark: SparkSession, d: str) -> DataFrame:
    """The same in batches of fifty files: ordinals are the frames' own."""
    rows, _ = _streamed(spark, d, 50)
    return _per_source(rows)


@query("ST05", PER_SOURCE)
def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that failed in its third batch and was started again: every frame is there once."""
    rows, _ = _streamed(spark, d, 50, failing=2)
    return _per_source(rows)


@query("ST06", "SELECT count(DISTINCT (source_key, frame_ordinal)) AS frames, true AS refused FROM observations WHERE source_key IS NOT NULL AND frame_ordinal IS NOT NULL")
def single_writer(spark: SparkSession, d: str) -> DataFrame:
    """A second run of a task that is at work is refused, and the task goes on."""
    rows, folder = _streamed(spark, d, 100)
    refused = False
    with stream.single_flight(folder):
        try:
            with stream.single_flight(folder):
                pass
        except stream.Busy:
            refused = True
    return rows.agg(F.count(F.lit(1)).alias("frames"), F.lit(refused).alias("refused"))


@query("ST07", "SELECT count(DISTINCT (source_key, frame_ordinal)) AS frames FROM observations WHERE source_key IS NOT NULL AND frame_ordinal IS NOT NULL")
def reported_progress(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the progress events of a stream report in all."""
    seen, stop = stream.progress_log(spark)
    _streamed(spark, d, 100)
    return spark.createDataFrame([(sum(n for _, n in stop(seen)),)], "frames bigint")


@query("ST08", "SELECT count(DISTINCT (source_key, frame_ordinal)) AS frames FROM observations WHERE source_key IS NOT NULL AND frame_ordinal IS NOT NULL")
def stopped_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream that was stopped on its way, its batch at hand awaited, and then run to its end."""
    folder = _folder(spark, "stopped")
    _frame_files(spark, d, f"{folder}/in")
    frames = stream.read_frames(spark, f"{folder}/in", "source_key bigint, frame_ordinal int", 50)
    q = stream.start_batches(frames, ["source_key", "frame_ordinal"], f"{folder}/out", f"{folder}/state")
    stream.stop_and_wait(q)
    stream.write_batches(frames, ["source_key", "frame_ordinal"], f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").agg(F.count(F.lit(1)).alias("frames"))


@query(
    "SNK11",
    f"""WITH {TR}, {SRCS}, n AS (SELECT source_key, min(transcript_id) AS t, arg_min(method, transcript_id) AS m FROM tr GROUP BY 1)
SELECT source_key AS ordinal, '{{"url":' || {_Q('url')} || ',"success":' || CASE WHEN t IS NULL THEN 'false,"method":null,"output":null,"error":"no transcript"' ELSE 'true,"method":' || {_Q('m')} || ',"output":"s' || source_key || '","error":null' END || '}}' AS result FROM sr LEFT JOIN n USING (source_key)""",
)
def cli_results(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object per input, with the input's place: what was made, where it is, or why not."""
    n = current_transcripts(spark, d).groupBy("source_key").agg(F.min("transcript_id").alias("t"), F.min_by("method", "transcript_id").alias("m"))
    j = _sources(spark, d).join(n, "source_key", "left")
    ok = c("t").isNotNull()
    body = F.struct("url", ok.alias("success"), c("m").alias("method"), F.when(ok, F.concat(F.lit("s"), c("source_key").cast("string"))).alias("output"), F.when(~ok, "no transcript").alias("error"))
    return j.select(c("source_key").alias("ordinal"), F.to_json(body, {"ignoreNullFields": "false"}).alias("result"))

