"""What a decoder's log lines say: decoded frames and silences. Rows are (media, place, line); places order a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How the lines of the two filters begin, and what they name.
FRAMES = r"^\[(?:Parsed_)?ashowinfo(?:_\d+)? @ [^\]]+\]\s"
SILENCE = r"^\[(?:Parsed_)?silencedetect(?:_\d+)? @ [^\]]+\]\s"
_EVENT = r"\bsilence_(start|end):\s*([^\s|]+)"
#: Units of time of a frame within a millisecond: microseconds, so that lengths of samples don't drift by rounding.
PER_MS = 1000


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("line", rf"\b{name}:\s*([^\s]+)", 1), F.lit(""))


def frame_lines(lines: DataFrame) -> DataFrame:
    """(media, place, s, length_ms) in microseconds; a frame line that lacks a field or has no samples has nulls, which
    makes its medium's evidence invalid."""
    start, rate, samples = _field("pts_time").try_cast("double"), _field("rate").try_cast("bigint"), _field("nb_samples").try_cast("bigint")
    finite = start.isNotNull() & ~F.isnan(start) & (F.abs(start) < 1e12)
    length = F.when((rate > 0) & (samples > 0), F.round(samples * (1000.0 * PER_MS) / rate).cast("bigint"))
    return lines.where(F.col("line").rlike(FRAMES)).select("media", "place", F.when(finite, F.round(start * (1000 * PER_MS)).cast("bigint")).alias("s"), length.alias("length_ms"))


def silence_lines(lines: DataFrame) -> DataFrame:
    """(media, place, kind, at_ms): events in order; kind is 'start', 'end', or 'bad' for a line or time that can't be read."""
    of = lines.where(F.col("line").rlike(SILENCE) & F.col("line").contains("silence_"))
    both = F.arrays_zip(F.regexp_extract_all("line", F.lit(_EVENT), 1).alias("kind"), F.regexp_extract_all("line", F.lit(_EVENT), 2).alias("at"))
    e = of.select("media", "place", F.posexplode_outer(both).alias("n", "x"))
    at = F.col("x.at").try_cast("double")
    ok = F.col("x").isNotNull() & at.isNotNull() & ~F.isnan(at) & (F.abs(at) < 1e12)
    return e.select("media", F.struct("place", F.coalesce("n", F.lit(0)).alias("n")).alias("place"), F.when(ok, F.col("x.kind")).otherwise("bad").alias("kind"), F.when(ok, F.round(at * 1000).cast("bigint")).alias("at_ms"))


def clip_ends(lines: DataFrame, media: DataFrame) -> DataFrame:
    """(media, clip_ms): where recognition may stop: a quarter second into a silence of two seconds or more that reaches to
    within half a second of the end; else the duration. ``media``: (media, duration_ms)."""
    e = silence_lines(lines).where("kind <> 'bad'")
    last = e.groupBy("media").agg(F.max_by(F.struct("kind", "at_ms"), "place").alias("last"), F.max_by("at_ms", F.when(F.col("kind") == "start", F.col("place"))).alias("began"))
    m = media.join(last, "media", "left")
    d = F.col("duration_ms")
    ends = F.when(F.col("last.kind") == "start", d).otherwise(F.col("last.at_ms"))
    quiet = (ends >= d - 500) & (F.least(ends, d) - F.col("began") >= 2000)
    return m.select("media", F.when(F.coalesce(quiet, F.lit(False)), F.least(d, F.col("began") + 250)).otherwise(d).alias("clip_ms"))


# What messages of a missing or unusable accelerator say.
DEVICE_ERRORS = ["cuda", "cudnn", "cublas", "cudart", "nvrtc", "nvidia", "float16", "gpu", "out of memory"]


def device_error(message: Column) -> Column:
    """A message of a missing or unusable accelerator: another device may do the work."""
    folded = F.lower(F.regexp_replace(message, r"\s+", " "))
    out = F.lit(False)
    for part in DEVICE_ERRORS:
        out |= folded.contains(part)
    return F.coalesce(out, F.lit(False))
