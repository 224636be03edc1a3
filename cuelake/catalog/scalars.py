"""Queries for the scalar functions, each over a whole table, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions import identity as ident
from cuelake.functions import language as lang
from cuelake.functions import text as tx
from cuelake.functions import times as tm
from cuelake.functions import udfs
from cuelake.operators.sequences import previous, running
from cuelake.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space and what isn't a letter or number, in the oracle's pattern syntax.
W = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"


def sql_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}', ' ', 'g'))"


def sql_fold(x: str) -> str:
    return rf"regexp_replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def sql_key(x: str) -> str:
    return f"lower(replace(trim({x}), '_', '-'))"


def sql_finite(x: str) -> str:
    return f"coalesce(isfinite({x}), false)"


def sql_clock(whole: str, hours: bool = True) -> str:
    h, m, s = f"({whole}) // 3600", f"(({whole}) // 60) % 60", f"({whole}) % 60"
    two = lambda v: f"lpad(CAST({v} AS VARCHAR), CAST(greatest(2, length(CAST({v} AS VARCHAR))) AS INTEGER), '0')"
    ms = f"{two(m)} || ':' || {two(s)}"
    return f"{two(h)} || ':' || {ms}" if hours else f"CASE WHEN {h} > 0 THEN {two(h)} || ':' || {ms} ELSE {ms} END"


def sql_stamp(ms: str, sep: str) -> str:
    return f"{sql_clock(f'({ms}) // 1000')} || '{sep}' || lpad(CAST(({ms}) % 1000 AS VARCHAR), 3, '0')"


def scalar(name: str, source: str, key: str, columns: dict[str, tuple[Column | Callable[[], Column], str]], where: str | None = None) -> None:
    """Register a query that evaluates ``columns`` on every row of ``source``; each has its Spark and SQL form."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        rows = table(spark, directory, source)
        rows = rows.where(where) if where else rows
        return rows.select(key, *[c().alias(n) for n, (c, _) in columns.items()])

    QUERIES[name] = run
    SQL[name] = f"SELECT {key}, " + ", ".join(f"{q} AS {n}" for n, (_, q) in columns.items()) + f" FROM {source}" + (f" WHERE {where.replace('NOT isnan(', 'isfinite(')}" if where else "")


c = F.col
SEG, OBS, SRC, TRS, DOC = ("segments", "segment_id"), ("observations", "observation_id"), ("sources", "source_key"), ("transcripts", "transcript_id"), ("documents", "doc_id")
TIMED = "start_seconds IS NOT NULL AND NOT isnan(start_seconds) AND start_seconds >= 0 AND start_seconds < 1e9"

scalar("STR01", *SEG, {"collapsed": (lambda: tx.collapse_ws(c("text")), sql_ws("text"))})
scalar("STR02", *SEG, {"folded": (lambda: tx.fold_caption(c("text")), sql_fold("text"))})
QUERIES["STR03"] = lambda spark, d: table(spark, d, "documents").select("doc_id", tx.clean_cue(c("text")).alias("cleaned"))
SQL["STR03"] = rf"""
WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x:
    trim(regexp_replace(translate(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\{{\\[^}}]+\}}', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(8206) || chr(8207), ''), '{W}', ' ', 'g'))), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), ' '), '') END AS cleaned FROM l"""
scalar("STR04", *SEG, {"escaped": (lambda: tx.escape_markup(c("text")), "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")})
scalar("STR09", *DOC, {"message": (lambda: tx.bounded(c("text")), f"CASE WHEN length({sql_ws('text')}) > 180 THEN left({sql_ws('text')}, 177) || '...' ELSE {sql_ws('text')} END")})
scalar("STR10", *TRS, {"label": (lambda: F.concat(c("method"), F.lit(" '"), F.left("language", F.lit(40)), F.lit("'")), "method || ' ''' || left(language, 40) || ''''")})
scalar("STR11", *TRS, {"lang_key": (lambda: lang.language_key(c("language")), sql_key("language"))})


def _sql_match(requested: str) -> str:
    k = sql_key("language")
    if requested == "zh-hans":
        return f"{k} = 'zh-hans' OR {k} IN ('zh', 'zh-cn', 'zh-sg', 'zh-chs')"
    if requested == "zh-hant":
        return f"{k} = 'zh-hant' OR {k} IN ('zh', 'zh-tw', 'zh-hk', 'zh-mo', 'zh-cht')"
    return f"split_part({k}, '-', 1) = '{requested}'"


scalar("STR12", *TRS, {f"is_{r.replace('-', '_')}": (lambda r=r: lang.language_matches(c("language"), F.lit(r)), _sql_match(r)) for r in ("zh-hans", "zh-hant", "en", "pt")})
_KEY0 = sql_key("coalesce(language, '')")
scalar(
    "STR13", *TRS,
    {"base": (lambda: lang.base_language(c("language")), f"CASE WHEN {_KEY0} IN ('', 'auto') THEN 'auto' ELSE split_part({_KEY0}, '-', 1) END"),
     "engine_base": (lambda: lang.base_language(c("language"), None), f"CASE WHEN {_KEY0} IN ('', 'auto') THEN NULL ELSE split_part({_KEY0}, '-', 1) END")},
)
_CODE = "replace(trim(coalesce(language, '')), '_', '-')"
_TAGS = (
    f"CASE WHEN lower({_CODE}) IN ('', 'auto') THEN '' "
    + " ".join(f"WHEN lower({_CODE}) = '{k}' THEN '{','.join(v)}'" for k, v in lang.ALIASES.items())
    + " "
    + " ".join(f"WHEN lower({_CODE}) = '{k}' THEN '{v}'" for k, v in lang.REGIONAL.items())
    + f" WHEN length({_CODE}) = 2 THEN lower({_CODE}) ELSE {_CODE} END"
)
scalar("STR14", *TRS, {"tags": (lambda: F.array_join(lang.recogniser_tags(c("language")), ","), _TAGS)})
_READ = ", ".join(f"'{x}'" for x in lang.READABLE)
scalar("STR15", *TRS, {"covered": (lambda: lang.readable(c("language")), f"{_KEY0} IN ('', 'auto') OR split_part({_KEY0}, '-', 1) IN ({_READ})")})


def _sql_script(t: str) -> str:
    s, z = (f"(length({t}) - length(translate({t}, '{x}', '')))" for x in (lang.SIMPLIFIED, lang.TRADITIONAL))
    return f"CASE WHEN NOT regexp_matches({t}, '[\\x{{3400}}-\\x{{9fff}}]') THEN 'und' WHEN {z} > {s} THEN 'zh-Hant' WHEN {s} > {z} THEN 'zh-Hans' ELSE 'zh' END"


scalar("STR16", *SEG, {"script": (lambda: lang.detected_script(F.lit("auto"), c("text")), _sql_script("coalesce(text, '')"))})
_CTX = "concat_ws(' ', coalesce(title, ''), coalesce(author, ''))"
scalar(
    "STR17", *SRC,
    {"reading_order": (lambda: lang.reading_order(c("title"), c("author"), c("platform")),
     f"CASE WHEN {_sql_script(_CTX)} = 'zh-Hant' THEN 'zh-Hant,zh-Hans,en-US,es-ES' WHEN {_sql_script(_CTX)} = 'zh-Hans' OR coalesce(platform = 'bilibili', false) THEN 'zh-Hans,zh-Hant,en-US,es-ES' "
     f"WHEN {_sql_script(_CTX)} <> 'und' THEN 'zh-Hant,zh-Hans,en-US,es-ES' ELSE 'en-US,zh-Hant,zh-Hans,es-ES' END")},
)
scalar("STR18", *TRS, {"resolved": (lambda: lang.resolved_language(c("language"), c("method")), "CASE WHEN lower(trim(language)) = 'auto' THEN method ELSE language END")})
scalar("STR19", *TRS, {"warnings_once": (lambda: F.array_join(F.array_sort(F.array_distinct("warnings")), "|"), "array_to_string(list_sort(list_distinct(warnings)), '|')")}, where="warnings IS NOT NULL AND cardinality(warnings) > 0")
SQL["STR19"] = SQL["STR19"].replace("cardinality(warnings)", "len(warnings)")
scalar("STR20", *SRC, {"input": (lambda: tx.normal_url(F.concat(F.lit("  "), c("url"), F.lit(" "))), "CASE WHEN regexp_matches(url, '^(?i:https?|file):') THEN trim(url) ELSE '  ' || url || ' ' END")})
scalar("STR21", *DOC, {"error": (lambda: tx.one_line_error(c("text")), f"coalesce(nullif({sql_ws('text')}, ''), 'Error')")})

_S, _E = "CAST(round(TRY_CAST(start_seconds AS DECIMAL(30,12)) * 1000, 0) AS BIGINT)", "CAST(round(TRY_CAST(end_seconds AS DECIMAL(30,12)) * 1000, 0) AS BIGINT)"
_EVEN = "TRY_CAST(round_even(start_seconds * 1000, 0) AS BIGINT)"
scalar(
    "TIM01", *SEG,
    {"parsed_ms": (lambda: F.round(tm.parse_timestamp(tm.subtitle_time(tm.half_up_ms(c("start_seconds")), ".")) * 1000).cast("bigint"), _S),
     "short_ms": (lambda: F.round(tm.parse_timestamp(F.concat(F.lpad((tm.half_up_ms(c("start_seconds")) % 60).cast("string"), 2, "0"), F.lit(":07,5"))) * 1000).cast("bigint"), f"({_S} % 60) * 60000 + 7500")},
    where=TIMED,
)
scalar("TIM02", *SEG, {"shown": (lambda: tm.display_time(c("start_seconds")), sql_clock("TRY_CAST(floor(start_seconds) AS BIGINT)", False))}, where=TIMED)
scalar("TIM03", *SEG, {"srt": (lambda: tm.subtitle_time(tm.half_up_ms(c("start_seconds"))), sql_stamp(_S, ",")), "vtt": (lambda: tm.subtitle_time(tm.half_up_ms(c("start_seconds")), "."), sql_stamp(_S, "."))}, where=TIMED)
_ENDS = TIMED + " AND end_seconds IS NOT NULL AND NOT isnan(end_seconds) AND end_seconds >= start_seconds AND end_seconds < 1e9"
scalar("TIM04", *SEG, {"start_ms": (lambda: tm.half_up_ms(c("start_seconds")), _S), "end_ms": (lambda: tm.cue_end_ms(c("start_seconds"), c("end_seconds")), f"greatest({_S} + 1, {_E})")}, where=_ENDS)
scalar("TIM05", *SEG, {"warned": (lambda: tm.warning_time(c("start_seconds")), f"CASE WHEN {_EVEN} % 1000 = 0 THEN {sql_clock(f'{_EVEN} // 1000')} ELSE {sql_stamp(_EVEN, '.')} END")}, where=TIMED)
scalar("TIM06", *SEG, {"spoken": (lambda: tm.speech_time(c("start_seconds")), sql_stamp(_EVEN, "."))}, where=TIMED)
_SEC = "CAST(round_even(duration_seconds, 0) AS BIGINT)"
_HMS = f"CASE WHEN {_SEC} >= 3600 THEN CAST({_SEC} // 3600 AS VARCHAR) || ':' || lpad(CAST(({_SEC} // 60) % 60 AS VARCHAR), 2, '0') ELSE CAST(({_SEC} // 60) % 60 AS VARCHAR) END || ':' || lpad(CAST({_SEC} % 60 AS VARCHAR), 2, '0')"
scalar("TIM07", *SRC, {"length": (lambda: tm.short_duration(c("duration_seconds")), _HMS)}, where="duration_seconds IS NOT NULL AND NOT isnan(duration_seconds) AND duration_seconds >= 0 AND duration_seconds < 1e9")
_N = "(n_chars * n_chars)"
scalar(
    "TIM08", *DOC,
    {"size": (lambda: tm.human_bytes(c("n_chars") * c("n_chars")),
     f"CASE WHEN {_N} >= 1073741824 THEN format('{{:.1f}} GiB', round_even({_N} / 1073741824.0, 1)) WHEN {_N} >= 1048576 THEN format('{{:.1f}} MiB', round_even({_N} / 1048576.0, 1)) WHEN {_N} >= 1024 THEN format('{{:.1f}} KiB', round_even({_N} / 1024.0, 1)) ELSE CAST({_N} AS VARCHAR) || ' B' END")},
    where="n_chars IS NOT NULL",
)
QUERIES["TIM09"] = lambda spark, d: frame_durations(table(spark, d, "observations"))
SQL["TIM09"] = """SELECT source_key, coalesce(min(CASE WHEN step > 0 THEN step END), 1000) AS frame_ms FROM (
SELECT source_key, CAST(round(timestamp_seconds * 1000) AS BIGINT) - lag(CAST(round(timestamp_seconds * 1000) AS BIGINT)) OVER (PARTITION BY source_key ORDER BY timestamp_seconds, observation_id) AS step
FROM observations WHERE timestamp_seconds IS NOT NULL AND isfinite(timestamp_seconds) AND source_key IS NOT NULL) GROUP BY 1"""
_PROFILE = "CASE observation_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' WHEN 2 THEN 'accurate' ELSE 'other' END"
scalar("TIM10", *OBS, {"every": (lambda: tm.sampling_interval(F.expr(_PROFILE)), "CASE observation_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 END")})
SQL["TIM10"] = SQL["TIM10"].replace("END AS every", "END::DOUBLE AS every")
_XY = ("x", "y", "width", "height")
_OK = " AND ".join(sql_finite(v) for v in _XY) + " AND x >= 0 AND y >= 0 AND width > 0 AND height > 0 AND x < 1 AND y < 1 AND x + width <= 1 + 1e-9 AND y + height <= 1 + 1e-9"
scalar("MTH01", *OBS, {"valid": (lambda: tm.region_ok(*map(c, _XY)), f"coalesce({_OK}, false)"), "clipped": (lambda: F.round(F.least(c("width"), 1 - c("x")), 6), "round(least(width, 1 - x), 6)")})
_QUAD = lambda: tm.quad_box(F.array(F.array(c("x") * 1000, (1 - c("y")) * 500), F.array((c("x") + c("width")) * 1000, (1 - c("y")) * 500), F.array((c("x") + c("width")) * 1000, (1 - c("y") - c("height")) * 500), F.array(c("x") * 1000, (1 - c("y") - c("height")) * 500)), F.lit(1000.0), F.lit(500.0))  # noqa: E731, E501
_X1, _Y1 = "least(1.0, greatest(0.0, x + width))", "least(1.0, greatest(0.0, y + height))"
_X0, _Y0 = "least(1.0, greatest(0.0, x))", "least(1.0, greatest(0.0, y))"
scalar(
    "MTH02", *OBS,
    {k: (lambda k=k: F.round(_QUAD()[k], 6), f"CASE WHEN width > 0 AND height > 0 THEN round({q}, 6) END") for k, q in (("x", _X0), ("y", _Y0), ("width", f"{_X1} - {_X0}"), ("height", f"{_Y1} - {_Y0}"))},
    where="x BETWEEN 0 AND 0.99 AND y BETWEEN 0 AND 0.99 AND width IS NOT NULL AND height IS NOT NULL AND NOT isnan(width) AND NOT isnan(height)",
)
scalar("MTH03", *SEG, {"clamped": (lambda: tm.clamp_confidence(c("confidence")), f"CASE WHEN {sql_finite('confidence')} THEN least(1.0, greatest(0.0, confidence)) END")})
scalar("MTH04", *SEG, {"start_ok": (lambda: tm.finite(c("start_seconds")), sql_finite("start_seconds")), "end_positive": (lambda: tm.finite(c("end_seconds")) & (c("end_seconds") > 0), f"{sql_finite('end_seconds')} AND end_seconds > 0")})
SQL["MTH04"] = SQL["MTH04"].replace("isfinite(end_seconds), false) AND end_seconds > 0", "isfinite(end_seconds), false) AND coalesce(end_seconds > 0, false)")
QUERIES["MTH04"] = lambda spark, d: table(spark, d, "segments").select("segment_id", tm.finite(c("start_seconds")).alias("start_ok"), (tm.finite(c("end_seconds")) & F.coalesce(c("end_seconds") > 0, F.lit(False))).alias("end_positive"))
scalar("MTH05", *OBS, {"fraction": (lambda: F.round(tm.progress_fraction(c("timestamp_seconds"), F.lit(100.0)), 6), "round(least(0.99, timestamp_seconds / 100.0), 6)")}, where="timestamp_seconds IS NOT NULL")
scalar("SRC14", *SRC, {"every": (lambda: F.round(tm.legacy_interval(c("duration_seconds"), 240), 4), f"CASE WHEN {sql_finite('duration_seconds')} AND duration_seconds > 0 THEN round(greatest(1.0, duration_seconds / 240), 4) ELSE 1.0 END")})

scalar("JSN04", *SRC, {"chunk_key": (lambda: ident.joined_key(F.lit("r1"), c("source_id"), F.lit("300/2"), F.round(c("duration_seconds") * 1000).cast("bigint")), "sha256('r1|' || coalesce(source_id, '') || '|300/2|' || coalesce(CAST(CAST(round(duration_seconds * 1000) AS BIGINT) AS VARCHAR), ''))")}, where="duration_seconds IS NULL OR (NOT isnan(duration_seconds) AND abs(duration_seconds) < 1e12)")
scalar("JSN05", *OBS, {"ordinal": (lambda: c("frame_ordinal"), "frame_ordinal"), "digest": (lambda: F.sha2(F.coalesce(c("text"), F.lit("")), 256), "sha256(coalesce(text, ''))")})
scalar("JSN06", *TRS, {"fingerprint": (lambda: ident.joined_key(F.lit("engine-1"), c("method"), F.lit("model-2")), "sha256('engine-1|' || coalesce(method, '') || '|model-2')")})
scalar("JSN07", *SRC, {"scope": (lambda: ident.cache_scope(F.when(c("platform") == "youtube", c("source_id")), F.when(c("platform") == "local", F.lit("browser"))), "CASE WHEN platform = 'local' THEN NULL WHEN platform = 'youtube' AND source_id IS NOT NULL THEN 'cookie-file:' || sha256(source_id) ELSE 'anonymous' END")})
scalar("ARR01", *OBS, {"batch": (lambda: F.floor(c("frame_ordinal") / 32), "CAST(floor(frame_ordinal / 32.0) AS BIGINT)")})
scalar("FLT06", *SRC, {"is_key": (lambda: F.regexp_replace("source_id", "^local-", "").rlike("^[0-9a-f]{64}$"), "regexp_full_match(regexp_replace(source_id, '^local-', ''), '[0-9a-f]{64}')")})
scalar("SRC03", *SRC, {"route": (lambda: local_route(c("url")), "CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'local' WHEN regexp_matches(url, '^(?i:file)://(localhost)?/[^?#]*$') THEN 'local' WHEN regexp_matches(url, '^(?i:file):') THEN 'invalid' ELSE 'remote' END")})


def local_route(url: Column) -> Column:
    """Where an input leads: a plain path or a clean file URL is local, other file URLs are invalid, the rest is remote."""
    return (
        F.when(~url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "local").when(url.rlike(r"^(?i:file)://(localhost)?/[^?#]*$"), "local").when(url.rlike("^(?i:file):"), "invalid").otherwise("remote")
    )


def frame_durations(frames: DataFrame) -> DataFrame:
    """(source_key, frame_ms): the smallest positive step between the frames of a source, 1000 where there is none.

    The least step between distinct times is that between neighbours; a time's neighbour is the greatest before it.
    """
    t = frames.where(tm.finite(c("timestamp_seconds")) & c("source_key").isNotNull()).select("source_key", F.round(c("timestamp_seconds") * 1000).cast("bigint").alias("ms")).distinct()
    before = running(t.withColumn("b", F.floor(c("ms") / 3_600_000)), ["source_key"], "b", ["ms"], c("ms"), "max", "before")
    return before.withColumn("step", c("ms") - c("before")).groupBy("source_key").agg(F.coalesce(F.min(F.when(c("step") > 0, c("step"))), F.lit(1000)).alias("frame_ms"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Observations with the text of the reading before, per source, over the borders of blocks of frames."""
    o = table(spark, d, "observations").where("text is not null and source_key is not null and frame_ordinal is not null")
    rows = o.select("observation_id", "source_key", "frame_ordinal", "loaded_at", "text").withColumn("b", F.expr("frame_ordinal div 4096"))
    return previous(rows, ["source_key"], "b", ["frame_ordinal", "observation_id", "loaded_at"], {"before": "text"}).where("before is not null")


QUERIES["STR05"] = lambda spark, d: _neighbours(spark, d).select("observation_id", udfs.captions_alike(c("before"), c("text")).alias("alike"))
_PAIR = """SELECT observation_id, text, lag(text) OVER (PARTITION BY source_key ORDER BY frame_ordinal, observation_id, loaded_at) AS before
FROM observations WHERE text IS NOT NULL AND source_key IS NOT NULL AND frame_ordinal IS NOT NULL"""
_LCP = "left(before, len(list_filter(range(1, least(length(before), length(text)) + 1), lambda i: left(before, i) = left(text, i))))"
QUERIES["STR06"] = lambda spark, d: _neighbours(spark, d).select("observation_id", tx.common_prefix(c("before"), c("text")).alias("prefix"))
SQL["STR06"] = f"SELECT observation_id, {_LCP} AS prefix FROM ({_PAIR}) WHERE before IS NOT NULL"
QUERIES["STR07"] = lambda spark, d: _neighbours(spark, d).select("observation_id", tx.agreed_start(c("before"), c("text")).alias("core"))
SQL["STR07"] = f"""
WITH p AS (SELECT observation_id, before, text, {_LCP} AS lcp FROM ({_PAIR}) WHERE before IS NOT NULL),
q AS (SELECT *, rtrim(lcp) AS core, trim(substr(before, length(lcp) + 1)) AS l, trim(substr(text, length(lcp) + 1)) AS r, least(length({sql_fold("before")}), length({sql_fold("text")})) AS n FROM p)
SELECT observation_id, CASE WHEN core <> '' AND l <> '' AND r <> '' AND l <> r AND length(l) <= 2 AND length(r) <= 2 AND n >= 4 AND length({sql_fold("core")}) >= 0.8 * n THEN core ELSE '' END AS core FROM q"""
QUERIES["STR08"] = lambda spark, d: table(spark, d, "sources").select("source_key", udfs.portable_name(c("title"), c("source_id")).alias("name"))
