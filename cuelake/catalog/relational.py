"""Queries for joins, aggregates, ordered sequences and filters, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.catalog.scalars import W, sql_fold, sql_key, sql_ws
from cuelake.functions import times as tm
from cuelake.functions.language import PRIORITY
from cuelake.functions.text import fold_caption
from cuelake.operators import chunks, joins, quality, sequences, tracks
from cuelake.operators import cues as cu
from cuelake.operators.intervals import gaps, interval_union, periods, to_ms
from cuelake.plans import hybrid
from cuelake.plans.timeline_gaps import gap_bounds
from cuelake.sources.tables import current_transcripts, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NONBLANK = W[:-1].replace("[", "[^", 1)
CUE = rf"""cue AS (SELECT DISTINCT segment_id, transcript_id, ordinal, CAST(round(start_seconds * 1000) AS BIGINT) AS s, CAST(round(end_seconds * 1000) AS BIGINT) AS e,
  {sql_ws('text')} AS text, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM segments
  WHERE regexp_matches(text, '{NONBLANK}') AND isfinite(start_seconds) AND isfinite(end_seconds) AND segment_id IS NOT NULL
  AND round(start_seconds * 1000) >= 0 AND round(end_seconds * 1000) >= round(start_seconds * 1000))"""
TR = "tr AS (SELECT transcript_id, source_key, language, method FROM transcripts QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST, source_key DESC, language DESC, method DESC) = 1)"
DUR = f"""{TR}, src AS (SELECT source_key, max(CASE WHEN isfinite(duration_seconds) AND duration_seconds > 0 THEN CAST(round(duration_seconds * 1000) AS BIGINT) END) AS d FROM sources GROUP BY 1),
dur AS (SELECT transcript_id, d FROM tr LEFT JOIN src USING (source_key))"""
UNI = """run AS (SELECT transcript_id, s, e, max(e) OVER (PARTITION BY transcript_id ORDER BY s, e, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cue WHERE e > s),
isl AS (SELECT transcript_id, s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY s, e, reach ROWS UNBOUNDED PRECEDING) AS i FROM run),
per AS (SELECT transcript_id, i, min(s) AS s, max(e) AS e FROM isl GROUP BY 1, 2)"""
LIMIT = "CASE WHEN d >= 90000 THEN greatest(60000.0, least(300000.0, d / 10.0)) END"
GAP = f"""mark AS (SELECT per.transcript_id, per.s, least(per.e, d) AS e FROM per JOIN dur USING (transcript_id) WHERE d >= 90000 AND per.s < d
  UNION ALL SELECT transcript_id, 0, 0 FROM dur WHERE d >= 90000 UNION ALL SELECT transcript_id, d, d FROM dur WHERE d >= 90000),
gap AS (SELECT m.transcript_id, reach AS gs, s AS ge FROM (SELECT *, max(e) OVER (PARTITION BY transcript_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mark) m
  JOIN dur USING (transcript_id) WHERE reach IS NOT NULL AND s - reach >= {LIMIT})"""
COV = "cov AS (SELECT transcript_id, CAST(sum(greatest(least(per.e, coalesce(d, per.e)) - per.s, 0)) AS BIGINT) AS covered FROM per LEFT JOIN dur USING (transcript_id) GROUP BY 1)"


def _union(spark: SparkSession, d: str) -> DataFrame:
    return interval_union(cu.cues(spark, d), "transcript_id", "s", "e")


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return gap_bounds(current_transcripts(spark, d), table(spark, d, "sources"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    b = _bounds(spark, d).where("limit_ms >= 90000")
    return gaps(_union(spark, d).join(b.select("key"), "key", "left_semi"), b).withColumnRenamed("key", "transcript_id")


@query("WN01", f"WITH {CUE}, {UNI} SELECT transcript_id, s AS start_ms, e AS end_ms FROM per")
def merged(spark: SparkSession, d: str) -> DataFrame:
    return periods(_union(spark, d)).withColumnRenamed("key", "transcript_id")


def _covered(spark: SparkSession, d: str) -> DataFrame:
    u = _union(spark, d).join(_bounds(spark, d), "key", "left")
    part = F.expr(
        "aggregate(zip_with(starts, ends, (s, e) -> greatest(least(e, coalesce(limit_ms, e)) - greatest(s, coalesce(carry, s)), 0L)), 0L, (a, x) -> a + x)"
    )
    return u.groupBy("key").agg(F.sum(part).alias("covered_ms"), F.max("limit_ms").alias("duration_ms"))


@query("AG01", f"WITH {CUE}, {UNI}, {DUR}, {COV} SELECT transcript_id, covered AS covered_ms FROM cov")
def union_length(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).select(c("key").alias("transcript_id"), "covered_ms")


@query("AG02", f"WITH {CUE}, {UNI}, {DUR}, {COV} SELECT cov.transcript_id, covered AS covered_ms FROM cov JOIN dur USING (transcript_id) WHERE d IS NOT NULL AND covered > 0")
def covered_duration(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).where("duration_ms is not null and covered_ms > 0").select(c("key").alias("transcript_id"), "covered_ms")


@query("WN02", f"WITH {CUE}, {UNI}, {DUR}, {GAP} SELECT transcript_id, gs AS gap_start_ms, ge AS gap_end_ms FROM gap")
def long_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d)


@query(
    "AG03",
    f"""WITH {CUE}, {UNI}, {DUR}, {GAP}, {COV}, n AS (SELECT transcript_id, count(*) AS n FROM gap GROUP BY 1)
SELECT cov.transcript_id, d AS duration_ms, covered AS covered_ms, CASE WHEN d > 0 THEN round(covered / d, 6) END AS ratio, coalesce(n, 0) AS gaps,
CASE WHEN d IS NULL THEN 'unverified' WHEN coalesce(n, 0) > 0 THEN 'needs-review' ELSE 'unverified' END AS status FROM cov LEFT JOIN dur USING (transcript_id) LEFT JOIN n USING (transcript_id)""",
)
def completeness(spark: SparkSession, d: str) -> DataFrame:
    n = _gaps(spark, d).groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))
    r = _covered(spark, d).withColumnRenamed("key", "transcript_id").join(n, "transcript_id", "left")
    ratio = F.round(F.try_divide("covered_ms", "duration_ms"), 6)
    status = F.when(c("duration_ms").isNotNull() & (F.coalesce("n", F.lit(0)) > 0), "needs-review").otherwise("unverified")
    return r.select("transcript_id", "duration_ms", "covered_ms", ratio.alias("ratio"), F.coalesce("n", F.lit(0)).alias("gaps"), status.alias("status"))


_T = lambda ms: f"lpad(CAST(({ms}) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({ms}) // 60000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((({ms}) // 1000) % 60 AS VARCHAR), 2, '0') || CASE WHEN ({ms}) % 1000 = 0 THEN '' ELSE '.' || lpad(CAST(({ms}) % 1000 AS VARCHAR), 3, '0') END"  # noqa: E731, E501


@query(
    "AG12",
    f"""WITH {CUE}, {UNI}, {DUR}, {GAP}, r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY gs) AS i, count(*) OVER (PARTITION BY transcript_id) AS n FROM gap)
SELECT transcript_id, 'Review: ' || any_value(n) || ' long ' || CASE WHEN any_value(n) = 1 THEN 'gap' ELSE 'gaps' END || ' (' || string_agg(CASE WHEN i <= 5 THEN {_T('gs')} || '–' || {_T('ge')} END, ', ' ORDER BY i)
|| CASE WHEN any_value(n) > 5 THEN ', and ' || (any_value(n) - 5) || ' more' ELSE '' END || ')' AS warning FROM r GROUP BY 1""",
)
def gap_warnings(spark: SparkSession, d: str) -> DataFrame:
    """One line per transcript with its first five gaps; only five per transcript reach the aggregate's list."""
    g = _gaps(spark, d)
    n = g.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"))
    first = g.withColumn("i", F.row_number().over(Window.partitionBy("transcript_id").orderBy("gap_start_ms"))).where("i <= 5")
    stamp = lambda x: tm.warning_time(c(x) / 1000.0)
    shown = first.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(stamp("gap_start_ms"), F.lit("–"), stamp("gap_end_ms")).alias("t")))).alias("l"))
    text = F.concat(
        F.lit("Review: "), c("n").cast("string"), F.when(c("n") == 1, " long gap (").otherwise(" long gaps ("), F.array_join(F.transform("l", lambda x: x["t"]), ", "),
        F.when(c("n") > 5, F.concat(F.lit(", and "), (c("n") - 5).cast("string"), F.lit(" more"))).otherwise(""), F.lit(")"),
    )
    return shown.join(n, "transcript_id").select("transcript_id", text.alias("warning"))


SPV = """sp AS (SELECT segment_id, transcript_id, ordinal, greatest(s - 3000, 0) AS s, e + 3000 AS e, text FROM cue WHERE ordinal % 3 <> 0),
vi AS (SELECT segment_id, transcript_id, ordinal, s, e, text FROM cue WHERE ordinal % 3 = 0)"""


@query(
    "JN01",
    f"""WITH {CUE}, {SPV} SELECT sp.segment_id, vi.segment_id AS visible_id, greatest(sp.s, vi.s) AS os, least(sp.e, vi.e) AS oe
FROM sp JOIN vi ON sp.transcript_id = vi.transcript_id AND greatest(sp.s, vi.s) < least(sp.e, vi.e)""",
)
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    speech, visible = cu.speech_and_visible(cu.cues(spark, d))
    return joins.overlaps(speech, visible, "transcript_id").select("segment_id", c("r_segment_id").alias("visible_id"), "os", "oe")


@query(
    "JN02",
    f"""WITH {CUE}, {SPV}, {UNI}, {DUR}, {GAP} SELECT DISTINCT sp.segment_id, sp.transcript_id FROM sp JOIN gap ON gap.transcript_id = sp.transcript_id
AND ((sp.s < ge AND sp.e > gs) OR (sp.s = sp.e AND gs <= sp.s AND sp.s < ge))""",
)
def speech_in_gaps(spark: SparkSession, d: str) -> DataFrame:
    speech, _ = cu.speech_and_visible(cu.cues(spark, d))
    return joins.touching(speech, _gaps(spark, d), "transcript_id").select("segment_id", "transcript_id")


MEDIA = """media AS (SELECT source_key AS media, max(CAST(round(duration_seconds * 1000) AS BIGINT)) AS duration_ms FROM sources WHERE isfinite(duration_seconds) AND duration_seconds > 0 AND source_key IS NOT NULL GROUP BY 1)"""
WIN = f"""{MEDIA}, win AS (SELECT media, chunk, chunk * 25000 AS ws, least(duration_ms, chunk * 25000 + 30000) AS we FROM media, unnest(range(0, CAST(greatest(ceil((duration_ms - 30000) / 25000.0), 0) AS BIGINT) + 1)) AS t(chunk))"""


#: Milliseconds of a window and of what two neighbours share.
WINDOW = (30_000, 5_000)


def _media(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sources").where(tm.finite(c("duration_seconds")) & (c("duration_seconds") > 0) & c("source_key").isNotNull())
    return m.groupBy(c("source_key").alias("media")).agg(F.max(to_ms(c("duration_seconds"))).alias("duration_ms"))


@query("WN06", f"WITH {WIN} SELECT media, chunk, ws, we FROM win")
def windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_windows(_media(spark, d), *WINDOW).where("error is null").drop("error")


CHUNKED = """ch AS (SELECT win.media, chunk, segment_id, ordinal, text, win.ws, win.we, greatest(cue.s - win.ws, 0) + chunk % 3 * 100 AS ls, cue.e - win.ws + chunk % 3 * 100 AS le
FROM cue JOIN tr USING (transcript_id) JOIN win ON win.media = tr.source_key AND cue.s < win.we AND cue.e > win.ws)"""


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    """What a recogniser would return: the cues of each window on its own clock, later windows a little late."""
    of = current_transcripts(spark, d).select("transcript_id", c("source_key").alias("media")).join(_media(spark, d), "media")
    met = chunks.in_windows(cu.cues(spark, d).join(of, "transcript_id"), *WINDOW)
    late = c("chunk") % 3 * 100
    return met.select("media", "chunk", "segment_id", "ordinal", "text", "ws", "we", (F.greatest(c("s") - c("ws"), F.lit(0)) + late).alias("s"), (c("e") - c("ws") + late).alias("e"))


@query("FLT04", f"WITH {CUE}, {TR}, {WIN}, {CHUNKED} SELECT media, chunk, segment_id, ws + least(ls, we - ws) AS s, ws + least(le, we - ws) AS e FROM ch WHERE ls < we - ws")
def rebased(spark: SparkSession, d: str) -> DataFrame:
    return chunks.rebase(_chunked(spark, d)).select("media", "chunk", "segment_id", "s", "e")


@query(
    "JN03",
    f"""WITH {CUE}, {TR}, {WIN}, {CHUNKED}, rb AS (SELECT media, chunk, segment_id, text, ws + least(ls, we - ws) AS s, ws + least(le, we - ws) AS e FROM ch WHERE ls < we - ws)
SELECT media, chunk, segment_id, s, e FROM rb a WHERE NOT EXISTS (SELECT 1 FROM rb p WHERE p.media = a.media AND p.text = a.text AND p.chunk = a.chunk - 1 AND
CASE WHEN least(a.e - a.s, p.e - p.s) <= 0 THEN a.s = p.s AND a.e = p.e ELSE least(a.e, p.e) - greatest(a.s, p.s) >= 0.8 * least(a.e - a.s, p.e - p.s)
AND abs(a.s + a.e - p.s - p.e) / 2.0 <= greatest(200.0, 0.2 * least(a.e - a.s, p.e - p.s)) END)""",
)
def boundary_copies(spark: SparkSession, d: str) -> DataFrame:
    return joins.without_boundary_copies(chunks.rebase(_chunked(spark, d)), "media", *WINDOW).select("media", "chunk", "segment_id", "s", "e")


@query(
    "JN04",
    f"""WITH {CUE}, {UNI}, rep AS (SELECT DISTINCT transcript_id, CAST(round(start_seconds * 1000) AS BIGINT) AS gs, CAST(round(end_seconds * 1000) AS BIGINT) AS ge FROM coverage_gaps
WHERE isfinite(start_seconds) AND isfinite(end_seconds) AND start_seconds >= 0 AND end_seconds > start_seconds)
SELECT DISTINCT per.transcript_id, per.s AS gap_start_ms, per.e AS gap_end_ms FROM per JOIN rep ON per.transcript_id = rep.transcript_id AND gs <= per.s + 250 AND ge >= per.e - 250 AND greatest(gs, per.s) < least(ge, per.e)""",
)
def contained_spans(spark: SparkSession, d: str) -> DataFrame:
    g = merged(spark, d).withColumnsRenamed({"start_ms": "gap_start_ms", "end_ms": "gap_end_ms"})
    r = table(spark, d, "coverage_gaps").select("transcript_id", to_ms(c("start_seconds")).alias("s"), to_ms(c("end_seconds")).alias("e")).where("s >= 0 and e > s").distinct()
    return joins.contained(g, r, "transcript_id")


ASKED = " UNION ALL ".join(f"SELECT {i} AS place, '{p}' AS wanted" for i, p in enumerate(PRIORITY["youtube"]))
TRK = """trk AS (SELECT source_key, transcript_id AS position, language, CASE WHEN method LIKE 'platform%' THEN 'manual' ELSE 'automatic' END AS kind FROM tr WHERE source_key IS NOT NULL AND regexp_matches(language, '[^ ]'))"""
_K = sql_key("t.language")
_P = sql_key("p.wanted")
MATCH = f"CASE WHEN {_K} = {_P} THEN true WHEN {_P} = 'zh-hans' THEN {_K} IN ('zh','zh-cn','zh-sg','zh-chs') WHEN {_P} = 'zh-hant' THEN {_K} IN ('zh','zh-tw','zh-hk','zh-mo','zh-cht') ELSE split_part({_K}, '-', 1) = split_part({_P}, '-', 1) END"


def _tracks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = current_transcripts(spark, d).where("source_key is not null")
    t = t.select("source_key", c("transcript_id").alias("position"), "language", F.when(c("method").like("platform%"), "manual").otherwise("automatic").alias("kind"))
    return t, spark.createDataFrame(list(enumerate(PRIORITY["youtube"])), "place int, wanted string")


PREF = f"""{TR}, {TRK}, ask AS ({ASKED}), m AS (SELECT t.*, p.place, CASE WHEN {_K} <> {_P} THEN 1 ELSE 0 END AS loose FROM trk t LEFT JOIN ask p ON {MATCH}),
pf AS (SELECT source_key, position, language, kind, coalesce(min(place), 11) AS pref, coalesce(arg_min(loose, place), 0) AS loose FROM m GROUP BY ALL)"""


@query("JN05", f"WITH {PREF} SELECT source_key, position, pref FROM pf")
def preference_join(spark: SparkSession, d: str) -> DataFrame:
    return tracks.track_ranks(*_tracks(spark, d)).select("source_key", "position", "pref")


RANK = f"""{PREF}, one AS (SELECT *, {sql_key('language')} AS k FROM pf QUALIFY row_number() OVER (PARTITION BY source_key, {sql_key('language')}, kind ORDER BY pref, loose, (kind = 'automatic')::INT, {sql_key('language')}, language, position) = 1),
rk AS (SELECT source_key, row_number() OVER (PARTITION BY source_key ORDER BY pref, loose, (kind = 'automatic')::INT, k, language, position) AS rank, language, kind FROM one)"""
QUERIES["WN03"] = lambda spark, d: tracks.ranked_tracks(*_tracks(spark, d))
SQL["WN03"] = f"WITH {RANK} SELECT source_key, rank, language, kind FROM rk"
QUERIES["WN04"] = lambda spark, d: tracks.selected_track(*_tracks(spark, d))
SQL["WN04"] = f"""WITH {TR}, {TRK}, ask AS ({ASKED}), m AS (SELECT t.*, CASE WHEN {_K} <> {_P} THEN 1 ELSE 0 END * 12 + p.place AS score FROM trk t LEFT JOIN ask p ON {MATCH}),
g AS (SELECT source_key, position, language, kind, coalesce(min(score), 36) AS score FROM m GROUP BY ALL)
SELECT source_key, language, kind FROM g QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY (kind = 'automatic')::INT, score, position) = 1"""


@query("LIM01", f"WITH {RANK} SELECT source_key, arg_min(language, rank) FILTER (WHERE kind = 'automatic') AS first_ok, count(*) AS tried FROM rk WHERE rank <= 5 GROUP BY 1")
def first_success(spark: SparkSession, d: str) -> DataFrame:
    """The first of at most five candidates that succeeds (here: the automatic ones do)."""
    r = tracks.ranked_tracks(*_tracks(spark, d), most=5)
    return r.groupBy("source_key").agg(F.min_by("language", F.when(c("kind") == "automatic", c("rank"))).alias("first_ok"), F.count(F.lit(1)).alias("tried"))


QUERIES["LIM02"] = lambda spark, d: _gaps(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("transcript_id").orderBy("gap_start_ms"))).where("i <= 5").select("transcript_id", "i", "gap_start_ms")
SQL["LIM02"] = f"WITH {CUE}, {UNI}, {DUR}, {GAP} SELECT transcript_id, i, gs AS gap_start_ms FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY gs) AS i FROM gap) WHERE i <= 5"


@query(
    "AG13",
    f"""WITH {RANK} SELECT source_key, string_agg(kind || ' ''' || left(language, 40) || ''' failed', '; ' ORDER BY rank) FILTER (WHERE rank <= 5) ||
CASE WHEN count(*) > 5 THEN '; ' || (count(*) - 5) || ' more not tried' ELSE '' END AS summary FROM rk GROUP BY 1""",
)
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    r = tracks.ranked_tracks(*_tracks(spark, d))
    label = F.concat("kind", F.lit(" '"), F.left("language", F.lit(40)), F.lit("' failed"))
    g = r.groupBy("source_key").agg(F.array_sort(F.collect_list(F.when(c("rank") <= 5, F.struct("rank", label.alias("t"))))).alias("l"), F.count(F.lit(1)).alias("n"))
    rest = F.when(c("n") > 5, F.concat(F.lit("; "), (c("n") - 5).cast("string"), F.lit(" more not tried"))).otherwise("")
    return g.select("source_key", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "; "), rest).alias("summary"))


FOLDED = f"nc AS (SELECT transcript_id, {sql_fold('text')} AS norm FROM cue)"
QUALITY = f"""{FOLDED}, st AS (SELECT transcript_id, count(*) AS n, count(DISTINCT norm) AS kinds, CAST(sum(length(norm)) AS BIGINT) AS chars, min(norm) AS lo, max(norm) AS hi, max(length(norm)) AS long FROM nc GROUP BY 1),
lb AS (SELECT *, len(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: left(lo, i) = left(hi, i))) AS p FROM st)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    norm = cu.cues(spark, d).select("transcript_id", fold_caption(c("text")).alias("norm"))
    s = norm.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm").alias("kinds"), F.sum(F.length("norm")).alias("chars"))
    return s.join(quality.repeated_label(norm, "transcript_id"), "transcript_id")


QUERIES["AG05"] = lambda spark, d: quality.repeated_label(cu.cues(spark, d).select("transcript_id", fold_caption(c("text")).alias("norm")), "transcript_id")
SQL["AG05"] = f"WITH {CUE}, {QUALITY} SELECT transcript_id, n >= 5 AND p >= 6 AND p >= 0.7 * long AND long - p <= 6 AS label FROM lb"
QUERIES["AG14"] = lambda spark, d: _stats(spark, d).select("transcript_id", F.round(c("kinds") / c("n"), 6).alias("ratio"))
SQL["AG14"] = f"WITH {CUE}, {QUALITY} SELECT transcript_id, round(kinds / n, 6) AS ratio FROM st"


@query(
    "AG04",
    f"""WITH {CUE}, {UNI}, {DUR}, {COV}, {QUALITY} SELECT lb.transcript_id, CASE WHEN coalesce(d, 0) > 0 AND chars * 1000 > 30 * d THEN false WHEN n >= 5 AND p >= 6 AND p >= 0.7 * long AND long - p <= 6 THEN false
WHEN coalesce(d, 0) <= 10000 THEN chars >= 4 WHEN d <= 30000 THEN n >= 2 AND kinds >= 2 AND chars >= 12 AND coalesce(covered, 0) >= 0.2 * d
ELSE n >= 5 AND chars >= greatest(60, round_even(d / 60000.0 * 15, 0)) AND kinds >= 0.4 * n AND coalesce(covered, 0) >= 0.35 * d END AS usable
FROM lb LEFT JOIN cov USING (transcript_id) LEFT JOIN dur USING (transcript_id)""",
)
def usability(spark: SparkSession, d: str) -> DataFrame:
    b = _bounds(spark, d).select(c("key").alias("transcript_id"), c("limit_ms").alias("duration_ms"))
    v = _covered(spark, d).select(c("key").alias("transcript_id"), "covered_ms")
    s = _stats(spark, d).join(v, "transcript_id", "left").join(b, "transcript_id", "left").fillna(0, ["covered_ms"])
    return s.select("transcript_id", quality.usable().alias("usable"))


OBS1 = "ob AS (SELECT DISTINCT ON (observation_id) * FROM observations)"
LINE = f"coalesce(regexp_matches(text, '{NONBLANK}') AND confidence >= 0.3 AND NOT isnan(confidence) AND height >= 0.018 AND y <= 0.76 AND x <= 0.7 AND x + width >= 0.3 AND length({sql_fold('text')}) >= 2, false)"
QUERIES["FLT01"] = lambda spark, d: table(spark, d, "observations").dropDuplicates(["observation_id"]).where(quality.caption_line()).select("observation_id", "source_key")
SQL["FLT01"] = f"WITH {OBS1} SELECT observation_id, source_key FROM ob WHERE {LINE}"
QUERIES["FLT02"] = lambda spark, d: table(spark, d, "observations").where(tm.finite(c("height")) & (c("height") >= 0.012)).select("observation_id").distinct()
SQL["FLT02"] = "SELECT DISTINCT observation_id FROM observations WHERE isfinite(height) AND height >= 0.012"


@query(
    "AG06",
    f"""WITH {OBS1} SELECT source_key, frame_ordinal, coalesce(string_agg({sql_ws('text')}, ' ' ORDER BY -y, x, observation_id) FILTER (WHERE {LINE}), '') AS text,
round(coalesce(avg(confidence) FILTER (WHERE {LINE}), 0), 6) AS confidence FROM ob GROUP BY 1, 2""",
)
def captions_of_frames(spark: SparkSession, d: str) -> DataFrame:
    return quality.frame_captions(table(spark, d, "observations")).select("source_key", "frame_ordinal", "text", F.round("confidence", 6).alias("confidence"))


@query("AG07", "SELECT source_key, round(avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END), 6) AS failed, CASE WHEN avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) > 0.1 THEN 'fail' WHEN avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM observations GROUP BY 1")
def failure_ratio(spark: SparkSession, d: str) -> DataFrame:
    f = F.avg(c("text").isNull().cast("double"))
    return table(spark, d, "observations").groupBy("source_key").agg(F.round(f, 6).alias("failed"), F.when(f > 0.1, "fail").when(f > 0, "warn").otherwise("ok").alias("verdict"))


@query("ARR02", f"WITH {CUE} SELECT transcript_id, arg_min(text, ordinal::BIGINT * 1000000000 + segment_id) AS first_text FROM cue GROUP BY 1")
def first_text(spark: SparkSession, d: str) -> DataFrame:
    return cu.cues(spark, d).groupBy("transcript_id").agg(F.min_by("text", F.struct("ordinal", "segment_id")).alias("first_text"))


@query("WN05", f"WITH {CUE} SELECT transcript_id, bool_or(coalesce(s < p, false)) AS out_of_order FROM (SELECT *, max(s) OVER (PARTITION BY transcript_id ORDER BY ordinal, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cue) GROUP BY 1")
def monotonicity(spark: SparkSession, d: str) -> DataFrame:
    """Some cue starts before one of lower order: true where the running maximum is ever undercut."""
    r = sequences.running(cu.cues(spark, d).withColumn("b", F.floor(c("ordinal") / 4096)), ["transcript_id"], "b", ["ordinal", "segment_id"], c("s"), "max", "p")
    return r.groupBy("transcript_id").agg(F.bool_or(F.coalesce(c("s") < c("p"), F.lit(False))).alias("out_of_order"))


@query(
    "WN07",
    f"""WITH {CUE}, nn AS (SELECT *, {sql_fold('text')} AS norm FROM cue) SELECT segment_id, transcript_id FROM (SELECT *, lag(norm) OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id) AS p FROM nn) WHERE norm <> coalesce(p, '')""",
)
def no_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Cues that read differently from the one before, in order of time; sequences are cut into blocks of time."""
    k = cu.cues(spark, d).withColumn("norm", fold_caption(c("text"))).withColumn("b", F.floor(c("s") / 600_000))
    w = Window.partitionBy("transcript_id", "b").orderBy("s", "e", "ordinal", "segment_id")
    last = k.groupBy("transcript_id", "b").agg(F.max_by("norm", F.struct("s", "e", "ordinal", "segment_id")).alias("last"))
    handed = last.select("transcript_id", "b", F.lag("last").over(Window.partitionBy("transcript_id").orderBy("b")).alias("handed"))
    r = k.withColumn("p", F.lag("norm").over(w)).withColumn("i", F.row_number().over(w)).join(handed, ["transcript_id", "b"])
    before = F.when(c("i") == 1, c("handed")).otherwise(c("p"))
    return r.where(c("norm") != F.coalesce(before, F.lit(""))).select("segment_id", "transcript_id")


@query("FLT03", f"""SELECT segment_id, row_number() OVER (PARTITION BY transcript_id ORDER BY greatest(start_seconds, 0), segment_id, loaded_at) AS place, round(greatest(start_seconds, 0), 6) AS s, round(greatest(greatest(start_seconds, 0), end_seconds), 6) AS e
FROM segments WHERE regexp_matches(text, '{NONBLANK}') AND isfinite(start_seconds) AND isfinite(end_seconds)""")
def speech_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "segments").select("segment_id", "transcript_id", F.struct("segment_id", "loaded_at").alias("index"), c("start_seconds").alias("start"), c("end_seconds").alias("end"), "text")
    return chunks.normal_speech(raw, "transcript_id").select("segment_id", "place", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"))


@query("FLT05", "SELECT DISTINCT transcript_id, CAST(round(start_seconds * 1000) AS BIGINT) AS s, CAST(round(end_seconds * 1000) AS BIGINT) AS e FROM coverage_gaps WHERE isfinite(start_seconds) AND isfinite(end_seconds) AND start_seconds >= 0 AND start_seconds < end_seconds")
def valid_evidence(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "coverage_gaps").where(tm.finite(c("start_seconds")) & tm.finite(c("end_seconds")) & (c("start_seconds") >= 0) & (c("start_seconds") < c("end_seconds")))
    return g.select("transcript_id", to_ms(c("start_seconds")).alias("s"), to_ms(c("end_seconds")).alias("e")).distinct()


@query("ORD01", f"WITH {CUE} SELECT transcript_id, segment_id, row_number() OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id) AS place FROM cue")
def stable_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in order of time; counted per block of time and offset by what earlier blocks hold."""
    k = cu.cues(spark, d).withColumn("b", F.floor(c("s") / 600_000))
    r = sequences.running(k, ["transcript_id"], "b", ["s", "e", "ordinal", "segment_id"], F.lit(1), "sum", "p")
    return r.select("transcript_id", "segment_id", (c("p") + 1).alias("place"))


@query("ORD02", "SELECT source_key, frame_ordinal, observation_id, row_number() OVER (PARTITION BY source_key, frame_ordinal ORDER BY y DESC, x, observation_id, loaded_at) AS place FROM observations WHERE isfinite(y) AND isfinite(x)")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "observations").where(tm.finite(c("y")) & tm.finite(c("x")))
    return o.select("source_key", "frame_ordinal", "observation_id", F.row_number().over(Window.partitionBy("source_key", "frame_ordinal").orderBy(F.desc("y"), "x", "observation_id", "loaded_at")).alias("place"))


@query("SET01", f"WITH {CUE}, {SPV} SELECT segment_id, 'speech' AS branch FROM sp UNION ALL SELECT segment_id, 'visible' FROM vi")
def both_branches(spark: SparkSession, d: str) -> DataFrame:
    s, v = cu.speech_and_visible(cu.cues(spark, d))
    return s.select("segment_id", F.lit("speech").alias("branch")).unionByName(v.select("segment_id", F.lit("visible").alias("branch")))


@query("SET02", "SELECT DISTINCT sha256(text) AS digest FROM observations WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM segments WHERE text IS NOT NULL)")
def pending_digests(spark: SparkSession, d: str) -> DataFrame:
    of = lambda t: table(spark, d, t).where("text is not null").select(F.sha2("text", 256).alias("digest")).distinct()
    return of("observations").join(of("segments"), "digest", "left_anti")


@query("SET03", "SELECT author, min(source_key) AS first_seen FROM sources WHERE author IS NOT NULL GROUP BY 1")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("author is not null").groupBy("author").agg(F.min("source_key").alias("first_seen"))


@query("SET04", "SELECT transcript_id, list_has_any(warnings, ['long gaps need review', 'low confidence speech']) AS flagged FROM transcripts WHERE warnings IS NOT NULL")
def intersects(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.lit("long gaps need review"), F.lit("low confidence speech"))
    return table(spark, d, "transcripts").where("warnings is not null").select("transcript_id", F.arrays_overlap("warnings", wanted).alias("flagged"))


@query("JN06", "WITH f AS (SELECT sha256(text) AS h, min(observation_id) AS first_id FROM observations WHERE text IS NOT NULL GROUP BY 1) SELECT DISTINCT observation_id, first_id FROM observations JOIN f ON sha256(text) = h")
def digest_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with the first of equal content: content is recognised once and joined back by digest."""
    o = table(spark, d, "observations").where("text is not null").select("observation_id", F.sha2("text", 256).alias("h")).distinct()
    return o.join(o.groupBy("h").agg(F.min("observation_id").alias("first_id")), "h").select("observation_id", "first_id")


QUERIES["FOLD01"] = lambda spark, d: cu.merge_rolling(cu.cues(spark, d))
SQL["FOLD01"] = f"""WITH {CUE}, l AS (SELECT transcript_id, list({{'s': s, 'e': e, 'text': text}} ORDER BY s, e, ordinal, segment_id, text) AS a FROM cue GROUP BY 1),
f AS (SELECT transcript_id, list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN x[1].s <= acc[-1].e + 500 AND (starts_with(x[1].text, acc[-1].text) OR starts_with(acc[-1].text, x[1].text))
  THEN list_concat(acc[1:len(acc) - 1], [{{'s': acc[-1].s, 'e': greatest(acc[-1].e, x[1].e), 'text': CASE WHEN length(x[1].text) > length(acc[-1].text) THEN x[1].text ELSE acc[-1].text END}}]) ELSE list_concat(acc, x) END) AS o FROM l)
SELECT transcript_id, u.s AS s, u.e AS e, u.text AS text FROM (SELECT transcript_id, unnest(o) AS u FROM f)"""


@query(
    "PIP01",
    f"""WITH {CUE}, {SPV}, ov AS (SELECT sp.segment_id, vi.segment_id AS v, sp.e - sp.s AS len, sp.text AS st, vi.text AS vt, greatest(sp.s, vi.s) AS os, least(sp.e, vi.e) AS oe, vi.ordinal AS vo FROM sp JOIN vi
  ON sp.transcript_id = vi.transcript_id AND greatest(sp.s, vi.s) < least(sp.e, vi.e)),
x AS (SELECT *, max(oe) OVER (PARTITION BY segment_id ORDER BY os, oe, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag({sql_fold('vt')}) OVER (PARTITION BY segment_id ORDER BY os, oe, v) AS p FROM ov),
g AS (SELECT segment_id, any_value(len) AS len, any_value(st) AS st, sum(greatest(oe - greatest(os, coalesce(reach, os)), 0)) AS covered, string_agg({sql_fold('vt')}, '' ORDER BY os, oe, v) FILTER (WHERE {sql_fold('vt')} <> coalesce(p, '')) AS seen FROM x GROUP BY 1),
dropped AS (SELECT segment_id FROM g WHERE covered >= 0.8 * len AND {sql_fold('st')} = coalesce(seen, ''))
SELECT transcript_id, segment_id, s, e, 'speech' AS branch FROM sp WHERE segment_id NOT IN (SELECT segment_id FROM dropped) UNION ALL SELECT transcript_id, segment_id, s, e, 'visible' FROM vi""",
)
def merge_hybrid(spark: SparkSession, d: str) -> DataFrame:
    speech, visible = cu.speech_and_visible(cu.cues(spark, d))
    return hybrid.merge(speech, visible, "transcript_id").select("transcript_id", "segment_id", "s", "e", "branch")


QUERIES["PIP10"] = lambda spark, d: current_transcripts(spark, d).select("transcript_id", hybrid.upgraded_method(c("method")).alias("upgraded"))
SQL["PIP10"] = f"WITH {TR} SELECT transcript_id, CASE method WHEN 'platform-captions' THEN 'platform-captions-whisper' WHEN 'local-captions' THEN 'local-captions-whisper' ELSE 'ocr-whisper' END AS upgraded FROM tr"
QUERIES["WN01_islands"] = lambda spark, d: sequences.islands(cu.cues(spark, d), "transcript_id", 500).select("transcript_id", "segment_id", "island")
SQL["WN01_islands"] = f"""WITH {CUE}, r AS (SELECT *, max(e) OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cue)
SELECT transcript_id, segment_id, CAST(sum(CASE WHEN reach IS NULL OR s > reach + 500 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY s, e, ordinal, segment_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM r"""
