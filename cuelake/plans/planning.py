"""Preflight plans as a decision over (platform, media_type, has_subtitle, mode)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modes and routes.
MODES = ["auto", "captions", "ocr", "whisper", "hybrid"]
CHAIN, NO_CAPTIONS, CAPTIONS, OCR, WHISPER, BOTH = "platform-captions->ocr->whisper", "ocr->whisper", "platform-captions", "ocr", "whisper", "ocr+whisper"


def plans(sources: DataFrame) -> DataFrame:
    """One row per source and mode with route, downloads, purpose, fallback and whether it can be processed at all.

    Local media are never downloaded; their sound alone can't be read. Fallbacks always differ from the purpose.
    """
    m = sources.withColumn("mode", F.explode(F.array(*map(F.lit, MODES))))
    mode, sub = F.col("mode"), F.col("has_subtitle")
    local, audio = F.col("platform") == "local", F.coalesce(F.col("media_type") == "audio", F.lit(False))
    plain = lambda: F.when(mode == "captions", CAPTIONS).when(mode == "ocr", OCR).when(mode == "whisper", WHISPER).when(mode == "hybrid", BOTH)
    route = F.when(mode != "auto", plain()).when(sub, CHAIN).when(local & audio, WHISPER).otherwise(NO_CAPTIONS)
    purpose = F.when(local | (mode == "captions"), F.lit(None)).when(mode == "whisper", "audio").otherwise("analysis-video")
    return m.select(
        "source_key", "mode", route.alias("route"),
        F.when(~local & sub & mode.isin("auto", "captions"), "required").otherwise("none").alias("subtitle_download"),
        F.when(local | (mode == "captions"), "none").when((mode == "auto") & sub, "conditional").otherwise("required").alias("media_download"),
        purpose.alias("purpose"), F.when(~local & mode.isin("auto", "hybrid"), "audio").alias("fallback"),
        F.when(mode == "captions", sub).when(local & audio & mode.isin("ocr", "hybrid"), False).otherwise(True).alias("processable"),
    )


def transcript_by_priority(candidates: DataFrame) -> DataFrame:
    """(source_key, method, reason): the first usable branch of each source: captions, then read, then heard.

    ``candidates``: (source_key, branch, usable, forced). A forced branch never gives way to another.
    """
    order = F.when(F.col("branch") == "captions", 0).when(F.col("branch") == "ocr", 1).otherwise(2)
    c = candidates.withColumn("o", order)
    g = c.groupBy("source_key").agg(F.min(F.when(F.col("usable") & F.coalesce(F.col("forced").isNull() | (F.col("forced") == F.col("branch")), F.lit(True)), F.struct("o", "branch"))).alias("best"), F.count(F.lit(1)).alias("tried"))
    return g.select("source_key", F.col("best.branch").alias("method"), F.when(F.col("best").isNull(), "no usable text").when(F.col("best.o") > 0, "fell back").alias("reason"))


def capacity(memory_gib: Column, windows: Column, cpus: Column) -> Column:
    """Inputs that a host takes at once."""
    slots = F.when(memory_gib < 12, 1).when(memory_gib < 24, 2).when(memory_gib < 40, 3).otherwise(4)
    return F.when(windows, F.least(slots, F.greatest(F.lit(1), F.least(F.lit(4), F.floor(cpus / 4))))).otherwise(slots)


def model_for(memory_gib: Column) -> Column:
    return F.when(memory_gib < 8, "base").when(memory_gib < 16, "small").otherwise("large-v3-turbo")
