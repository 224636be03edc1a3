"""Which caption track to take, and in what order to try the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.language import language_key, language_matches


def track_ranks(tracks: DataFrame, preferences: DataFrame) -> DataFrame:
    """(source_key, position, language, kind, pref, exact): the first matching preference of each track.

    ``preferences`` (place, wanted) is an ordered list of a few languages; it is sent to every task as a column of rows, so
    its size must be checked by the caller. Tracks that match none get the place after the last.
    """
    n = preferences.count()
    if n > 1000:
        raise ValueError("preferences are a short list")
    t = tracks.where("language is not null and language rlike '[^ ]'")
    matched = t.join(F.broadcast(preferences), language_matches(t.language, preferences.wanted), "left")
    return matched.groupBy("source_key", "position", "language", "kind").agg(
        F.coalesce(F.min("place"), F.lit(n)).alias("pref"),
        F.coalesce(F.min(F.when(F.col("wanted").isNotNull(), F.struct("place", (language_key(F.col("language")) != language_key(F.col("wanted"))).cast("int").alias("loose")))).getField("loose"), F.lit(0)).alias("loose"),
    )


def ranked_tracks(tracks: DataFrame, preferences: DataFrame, most: int | None = None) -> DataFrame:
    """(source_key, rank, language, kind): tracks by closeness, manual before automatic, each language and kind once."""
    r = track_ranks(tracks, preferences)
    key = language_key(F.col("language"))
    order = [F.col("pref"), F.col("loose"), (F.col("kind") == "automatic").cast("int"), key, F.col("language"), F.col("position")]
    once = r.withColumn("k", key).withColumn("first", F.row_number().over(Window.partitionBy("source_key", "k", "kind").orderBy(*order))).where("first = 1")
    out = once.withColumn("rank", F.row_number().over(Window.partitionBy("source_key").orderBy(*order)))
    return (out.where(F.col("rank") <= most) if most else out).select("source_key", "rank", "language", "kind")


def selected_track(tracks: DataFrame, preferences: DataFrame) -> DataFrame:
    """(source_key, language, kind): the track to take first.

    The best manual track by preference (exact matches of any preference before loose ones), else the best automatic one;
    without any match the first listed.
    """
    n = preferences.count()
    t = tracks.where("language is not null and language rlike '[^ ]'")
    m = t.join(F.broadcast(preferences), language_matches(t.language, preferences.wanted), "left")
    loose = (language_key(F.col("language")) != language_key(F.col("wanted"))).cast("int")
    g = m.groupBy("source_key", "position", "language", "kind").agg(F.coalesce(F.min(loose * (n + 1) + F.col("place")), F.lit(3 * (n + 1))).alias("score"))
    order = [(F.col("kind") == "automatic").cast("int"), F.col("score"), F.col("position")]
    return g.withColumn("n", F.row_number().over(Window.partitionBy("source_key").orderBy(*order))).where("n = 1").select("source_key", "language", "kind")
