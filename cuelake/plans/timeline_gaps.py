"""Continuous periods and long gaps of transcripts, and how far the gaps were reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import is_blank
from cuelake.operators.intervals import coverage_of, from_zero, gaps, interval_union, to_ms
from cuelake.sources.tables import current_transcripts, distinct_by, table


def cue_union(segments: DataFrame) -> DataFrame:
    """The union of the cues of each transcript: blank texts and unusable times don't count, starts are clipped to 0.

    Clipping at the media's end commutes with the union and is left to ``gaps``. A cue delivered twice changes no union.
    """
    cues = segments.where(~is_blank(F.col("text"))).select(
        "transcript_id", from_zero(to_ms(F.col("start_seconds"))).alias("s"), to_ms(F.col("end_seconds")).alias("e")
    )
    return interval_union(cues, "transcript_id", "s", "e")


def gap_bounds(transcripts: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, limit_ms, threshold_ms) per transcript; limit null without a usable duration."""
    d = distinct_by(sources, "source_key", "duration_seconds").select("source_key", to_ms(F.col("duration_seconds")).alias("limit_ms"))
    b = transcripts.join(d, "source_key", "left").withColumn("limit_ms", F.when(F.col("limit_ms") > 0, F.col("limit_ms")))
    least = F.greatest(F.lit(60_000.0), F.least(F.lit(300_000.0), F.col("limit_ms") / 10))
    return b.select(F.col("transcript_id").alias("key"), "limit_ms", F.when(F.col("limit_ms").isNotNull(), least).otherwise(60_000.0).alias("threshold_ms"))


def transcript_gaps(segments: DataFrame, transcripts: DataFrame, sources: DataFrame, reports: DataFrame) -> DataFrame:
    """(transcript_id, gap_start_ms, gap_end_ms, reported).

    Transcripts with a duration below 90 s have none. A transcript without any usable cue and with a duration is one gap.
    Reports with a null, non-finite or reversed time cover nothing.
    """
    bounds = gap_bounds(transcripts, sources)
    found = gaps(cue_union(segments), bounds.where("limit_ms is null or limit_ms >= 90000"))
    short = bounds.where("limit_ms < 90000").select("key")
    found = found.join(bounds.select("key"), "key", "left_semi").join(short, "key", "left_anti")
    covers = reports.select(
        F.col("transcript_id").alias("key"), from_zero(to_ms(F.col("start_seconds"))).alias("s"), to_ms(F.col("end_seconds")).alias("e")
    )
    covers = covers.where("key is not null and s is not null and e > s")
    judged = coverage_of(found, covers)
    label = F.when(F.col("covered_ms") >= F.col("gap_end_ms") - F.col("gap_start_ms"), "full").when(F.col("covered_ms") > 0, "partial").otherwise("none")
    return judged.select(F.col("key").alias("transcript_id"), "gap_start_ms", "gap_end_ms", label.alias("reported"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every gap of every transcript, over whole tables."""
    return transcript_gaps(
        table(spark, directory, "segments"), current_transcripts(spark, directory), table(spark, directory, "sources"), table(spark, directory, "coverage_gaps")
    )


P4_FOUND_SQL = """
WITH tr AS (SELECT transcript_id, source_key FROM transcripts QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC, source_key DESC) = 1),
src AS (SELECT source_key, max(CASE WHEN isfinite(duration_seconds) AND duration_seconds > 0 THEN CAST(round(duration_seconds * 1000) AS BIGINT) END) AS d FROM sources GROUP BY 1),
b AS (SELECT tr.transcript_id, d, CASE WHEN d IS NULL THEN 60000.0 ELSE greatest(60000.0, least(300000.0, d / 10.0)) END AS thr
      FROM tr LEFT JOIN src USING (source_key) WHERE d IS NULL OR d >= 90000),
cue AS (SELECT DISTINCT s.transcript_id, greatest(CAST(round(start_seconds * 1000) AS BIGINT), 0) AS s,
               least(CAST(round(end_seconds * 1000) AS BIGINT), coalesce(d, 9000000000000000)) AS e, d
        FROM segments s JOIN b USING (transcript_id)
        WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL AND isfinite(start_seconds) AND isfinite(end_seconds)
          AND regexp_matches(text, '[^\\x09-\\x0d\\x1c-\\x20\\x{85}\\p{Z}]')),
ok AS (SELECT transcript_id, s, e FROM cue WHERE e > s),
mark AS (SELECT transcript_id, s, e FROM ok
         UNION ALL SELECT transcript_id, 0, 0 FROM b WHERE d IS NOT NULL
         UNION ALL SELECT transcript_id, d, d FROM b WHERE d IS NOT NULL),
run AS (SELECT transcript_id, s, max(e) OVER (PARTITION BY transcript_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mark),
gap AS (SELECT run.transcript_id, reach AS gs, s AS ge FROM run JOIN b USING (transcript_id) WHERE reach IS NOT NULL AND s - reach >= thr),
rep AS (SELECT transcript_id, greatest(CAST(round(start_seconds * 1000) AS BIGINT), 0) AS s, CAST(round(end_seconds * 1000) AS BIGINT) AS e FROM coverage_gaps
        WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL AND isfinite(start_seconds) AND isfinite(end_seconds)),
cut AS (SELECT g.transcript_id, gs, ge, greatest(s, gs) AS s, least(e, ge) AS e FROM gap g JOIN rep r ON r.transcript_id = g.transcript_id AND r.s < g.ge AND r.e > g.gs AND r.e > r.s),
rr AS (SELECT *, coalesce(max(e) OVER (PARTITION BY transcript_id, gs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), gs) AS reach FROM cut),
cov AS (SELECT transcript_id, gs, sum(greatest(e - greatest(s, reach), 0)) AS c FROM rr GROUP BY 1, 2)
SELECT g.transcript_id, g.gs AS gap_start_ms, g.ge AS gap_end_ms, CASE WHEN coalesce(c, 0) >= g.ge - g.gs THEN 'full' WHEN coalesce(c, 0) > 0 THEN 'partial' ELSE 'none' END AS reported
FROM gap g LEFT JOIN cov ON cov.transcript_id = g.transcript_id AND cov.gs = g.gs
"""
