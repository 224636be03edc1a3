"""Times, sizes and boxes. Three roundings are kept apart: truncation, half up, and half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite; never null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def parse_timestamp(stamp: Column) -> Column:
    """``[H:]MM:SS[.,]fff`` as seconds; null where it doesn't match."""
    pattern = r"^(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[.,](\d{1,3})$"
    part = lambda i: F.regexp_extract(stamp, pattern, i)
    seconds = F.coalesce(F.try_to_number(part(1), F.lit("999")), F.lit(0)) * 3600 + part(2).try_cast("int") * 60 + F.concat(part(3), F.lit("."), part(4)).try_cast("double")
    return F.when(stamp.rlike(pattern), seconds.cast("double"))


def _two(x: Column) -> Column:
    return F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))


def _clock(whole: Column) -> tuple[Column, Column, Column]:
    return F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60


def display_time(seconds: Column) -> Column:
    """Whole seconds (truncated, not below 0) as ``MM:SS``, with hours where there are any."""
    h, m, s = _clock(F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint")))
    return F.when(h > 0, F.concat_ws(":", _two(h), _two(m), _two(s))).otherwise(F.concat_ws(":", _two(m), _two(s)))


def subtitle_time(ms: Column, separator: str = ",") -> Column:
    """``HH:MM:SS,mmm`` from whole milliseconds."""
    h, m, s = _clock(F.floor(ms / 1000))
    return F.concat(F.concat_ws(":", _two(h), _two(m), _two(s)), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def half_up_ms(seconds: Column) -> Column:
    """Milliseconds of the shortest decimal form of a double, half up."""
    return F.round(seconds.cast("decimal(30,12)") * 1000, 0).cast("bigint")


def cue_end_ms(start: Column, end: Column) -> Column:
    """A cue lasts a millisecond at least."""
    return F.greatest(half_up_ms(start) + 1, half_up_ms(end))


def even_ms(seconds: Column) -> Column:
    """Milliseconds, half to even."""
    return F.bround(seconds * 1000, 0).cast("bigint")


def warning_time(seconds: Column) -> Column:
    """``HH:MM:SS``, with milliseconds only where there are any."""
    ms = even_ms(seconds)
    return F.when(ms % 1000 == 0, F.left(subtitle_time(ms, "."), F.length(subtitle_time(ms, ".")) - 4)).otherwise(subtitle_time(ms, "."))


def speech_time(seconds: Column) -> Column:
    """``HH:MM:SS.mmm`` always."""
    return subtitle_time(even_ms(seconds), ".")


def short_duration(seconds: Column) -> Column:
    """``M:SS`` or ``H:MM:SS``, rounded half to even."""
    h, m, s = _clock(F.bround(seconds, 0).cast("bigint"))
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s))).otherwise(F.concat_ws(":", m.cast("string"), _two(s)))


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in the largest fitting unit up to TiB; bytes themselves without decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def sampling_interval(profile: Column) -> Column:
    """Seconds between sampled frames; null for an unknown profile."""
    return F.when(profile == "fast", 1.0).when(profile == "balanced", 0.5).when(profile == "accurate", 0.25)


def legacy_interval(duration: Column, most: int) -> Column:
    """Seconds between frames where at most ``most`` may be taken; 1 where the duration is unknown."""
    return F.when(finite(duration) & (duration > 0), F.greatest(F.lit(1.0), duration / most)).otherwise(1.0)


def region_ok(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A sampling region inside the unit frame; an overshoot of 1e-9 is tolerated and clipped later."""
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x < 1) & (y < 1) & (x + w <= 1 + 1e-9) & (y + h <= 1 + 1e-9)
    return F.coalesce(finite(x) & finite(y) & finite(w) & finite(h) & inside, F.lit(False))


def quad_box(corners: Column, width: Column, height: Column) -> Column:
    """Bottom-left box, in shares of the frame, of four corners in pixels from the top left; null where it is empty."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    xs, ys = F.transform(corners, lambda p: clamp(p[0] / width)), F.transform(corners, lambda p: clamp(p[1] / height))
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), (1 - y1).alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))


def clamp_confidence(x: Column) -> Column:
    """Into [0, 1]; null where it isn't finite."""
    return F.when(finite(x), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def progress_fraction(done: Column, expected: Column) -> Column:
    """At most 0.99; null where nothing is known to be expected."""
    return F.when(finite(expected) & (expected > 0), F.least(F.lit(0.99), done / expected))
