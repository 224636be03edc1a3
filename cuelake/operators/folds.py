"""Folds that depend on order: frame readings into captions, decoded frames into runs, decoder logs.

What a fold decides at a row depends on all rows since its last sure cut. Sequences are cut where the rows alone show that
a fold starts anew; the stretches between cuts are folded side by side, each as a stream of sorted rows.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import fold_caption
from cuelake.functions.udfs import RATIO, likeness
from cuelake.operators.sequences import running, scanned
from cuelake.session import keep

SEGMENT = "source_key bigint, start_ms bigint, end_ms bigint, text string, confidence double"
#: From which confidence on a reading is sure, the ratio that two sure readings need, and how many frames may be blank.
SURE, SURE_RATIO, BLANK_FRAMES = 0.5, 0.88, 1.5
#: Milliseconds of a sequence that one task orders.
BLOCK_MS = 3_600_000


class Caption(NamedTuple):
    """A caption on screen: when it came, when it was last seen, and its best reading."""

    start: int
    seen: int
    text: str
    norm: str
    confidence: float

    def ends(self, frame_ms: int, following: int | None = None) -> int:
        """A frame after it was last seen but not into the next caption; at least a frame after its start."""
        last = self.seen + frame_ms
        return max(self.start + frame_ms, last if following is None else min(last, following))


def folded(text: str) -> str:
    """Letters and numbers of a text, case folded."""
    return "".join(filter(str.isalnum, text.casefold()))


def common_start(a: str, b: str) -> str:
    """What two doubtful readings have in common if both go on for one or two different characters, else empty."""
    prefix = os.path.commonprefix((a, b))
    ends = {x[len(prefix) :].strip() for x in (a, b)}
    least = min(len(folded(a)), len(folded(b)))
    core = prefix.rstrip()
    short = len(ends) == 2 and all(0 < len(x) <= 2 for x in ends)
    return core if short and least >= 4 and len(folded(core)) >= 0.8 * least else ""


def continued(caption: Caption, frame: Caption) -> Caption | None:
    """The caption with one more frame that shows it, or None where the frame shows another."""
    surer, doubt = max(caption.confidence, frame.confidence), min(caption.confidence, frame.confidence)
    least = RATIO if doubt <= SURE else max(RATIO, SURE_RATIO)
    if likeness(caption.norm, frame.norm, least) < least:
        return None
    core = common_start(caption.text, frame.text) if surer <= SURE else ""
    if core:
        return Caption(caption.start, frame.seen, core, folded(core), surer)
    better = frame if frame.confidence > caption.confidence or len(frame.norm) > len(caption.norm) else caption
    return Caption(caption.start, frame.seen, better.text, better.norm, better.confidence)


def captions(frames: Iterable[Caption]) -> Iterator[Caption]:
    """Captions of the frames of one stretch, all of which show text."""
    shown = None
    for frame in frames:
        longer = continued(shown, frame) if shown else None
        if shown and not longer:
            yield shown
        shown = longer or frame
    if shown:
        yield shown


def fold_frames(frames: DataFrame, frame_ms: int = 500, block_ms: int = BLOCK_MS) -> DataFrame:
    """(source_key, start_ms, end_ms, text, confidence): captions of frames (source_key, frame_ordinal, timestamp_seconds, text,
    confidence) as segments.

    A blank frame that comes more than ``BLANK_FRAMES`` after the last text ends any caption, whatever it was: there
    sequences are cut, and every stretch is folded by itself as a stream of sorted rows, so that memory holds one caption.
    A stretch without such a blank is one task. Frames with a null time are left out; ties go by frame and text.
    """
    f = frames.where("source_key is not null and timestamp_seconds is not null and not isnan(timestamp_seconds) and timestamp_seconds >= 0")
    text = F.coalesce("text", F.lit(""))
    f = f.select(
        "source_key", F.round(F.col("timestamp_seconds") * 1000).cast("bigint").alias("s"), F.coalesce("frame_ordinal", F.lit(0)).alias("ordinal"), text.alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    ).withColumn("_b", F.floor(F.col("s") / block_ms))
    order = ["s", "ordinal", "text", "confidence"]
    last_text = {"text_at": (F.when(F.col("text") != "", F.col("s")), "max")}
    before = scanned(f, ["source_key"], "_b", order, last_text, {"before": "text", "before_s": "s"}).where("text <> ''")
    cut = F.coalesce((F.col("before") == "") & (F.col("before_s") - F.col("text_at") > int(frame_ms * BLANK_FRAMES)), F.lit(False)).cast("bigint")
    stretched = running(before.withColumn("_cut", cut), ["source_key"], "_b", order, F.col("_cut"), "sum", "_n").withColumn("stretch", F.col("_n") + F.col("_cut"))
    rows = stretched.select("source_key", "stretch", "s", "ordinal", "text", fold_caption(F.col("text")).alias("norm"), "confidence")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def all_rows() -> Iterator[tuple[tuple[int, int], Caption]]:
            for b in batches:
                for key, stretch, s, t, norm, confidence in zip(b["source_key"], b["stretch"], b["s"], b["text"], b["norm"], b["confidence"]):
                    yield (int(key), int(stretch)), Caption(int(s), int(s), t, norm, float(confidence))

        out: list[tuple] = []
        for key, caption in _by_stretch(all_rows()):
            out.append((*key, caption.start, caption.seen, caption.text, caption.confidence))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    columns = ["source_key", "stretch", "start_ms", "seen", "text", "confidence"]
    ordered = rows.repartition("source_key", "stretch").sortWithinPartitions("source_key", "stretch", "s", "ordinal", "text", "confidence")
    found = ordered.mapInPandas(fold, "source_key bigint, stretch bigint, start_ms bigint, seen bigint, text string, confidence double")
    # an end is cut by the next start in the stretch; the next stretch starts later than any tolerance
    following = F.lead("start_ms").over(Window.partitionBy("source_key", "stretch").orderBy("start_ms", "seen"))
    end = F.greatest(F.col("start_ms") + frame_ms, F.least(F.col("seen") + frame_ms, following))
    return found.select("source_key", "start_ms", end.alias("end_ms"), "text", "confidence")


def _by_stretch(rows: Iterator[tuple[tuple[int, int], Caption]]) -> Iterator[tuple[tuple[int, int], Caption]]:
    """Captions of consecutive stretches of sorted frames, with the stretch's key."""
    from itertools import groupby

    for key, stretch in groupby(rows, lambda r: r[0]):
        for caption in captions(r[1] for r in stretch):
            yield key, caption


def decoded_runs(frames: DataFrame, tolerance_ms: int = 2, block_ms: int = BLOCK_MS, per_ms: int = 1) -> DataFrame:
    """(media, run_start, run_end): runs of decoded samples (media, place, s, length_ms); media with invalid evidence (no
    length, a start before -250 ms, or starts that go back) have none. Times of frames are in ``per_ms`` parts of a
    millisecond, those of runs in milliseconds.

    A run goes on while a frame starts where the lengths since the run's start say, up to a tolerance, so small holes add
    up and end it. How far a start is ahead of all lengths before it changes at holes only: those few frames decide where
    runs begin, and the lengths in between come from a running sum.
    """
    f = frames.withColumn("_b", F.floor(F.coalesce("s", F.lit(0)) / (block_ms * per_ms)))
    order = ["s", "place"]
    early = F.col("s") + F.col("length_ms") <= 0  # before the medium begins
    sums = {"before": (F.when(early, 0).otherwise(F.col("length_ms")), "sum")}
    placed = scanned(f, ["media"], "_b", order, sums, {"place_before": "place", "s_before": "s", "length_before": "length_ms"})
    wrong = (F.col("length_ms") <= 0) | (F.col("s") < -250 * per_ms) | F.coalesce(F.col("place_before") > F.col("place"), F.lit(False)) | F.col("s").isNull() | F.col("length_ms").isNull()
    media = f.groupBy("media").agg(F.sum(F.when(early, 0).otherwise(F.col("length_ms"))).alias("total"))
    heard = placed.withColumn("wrong", F.coalesce(wrong, F.lit(True))).withColumn("ahead", F.col("s") - F.col("before"))
    # the row before was as far ahead, unless there is a hole between
    straight = F.coalesce((F.col("s_before") + F.col("length_before") > 0) & (F.col("s_before") + F.col("length_before") == F.col("s")), F.lit(False))
    told = keep(heard.where(F.col("wrong") | ~straight & ~early).select("media", "s", "place", "before", "ahead", "wrong"))
    holes = told.join(told.where("wrong").select("media").distinct(), "media", "left_anti")

    def openings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        medium, anchor = None, 0
        for b in batches:
            opens = []
            for m, ahead in zip(b["media"], b["ahead"]):
                new = m != medium or abs(ahead - anchor) > tolerance_ms * per_ms
                if new:
                    medium, anchor = m, ahead
                opens.append(new)
            yield b.loc[opens, ["media", "s", "before"]]

    opened = holes.repartition("media").sortWithinPartitions("media", "s", "place").select("media", "s", "before", "ahead").mapInPandas(openings, "media bigint, s bigint, before bigint")
    after = F.lead("before").over(Window.partitionBy("media").orderBy("before", "s"))
    ends = opened.withColumn("after", after).join(media, "media")
    in_ms = lambda x: x if per_ms == 1 else F.round(x / per_ms).cast("bigint")
    return ends.select("media", in_ms(F.greatest("s", F.lit(0))).alias("run_start"), in_ms(F.col("s") + F.coalesce("after", "total") - F.col("before")).alias("run_end"))


def decoded_end(lines: DataFrame) -> DataFrame:
    """(media, end_ms): how far a decoder came by its progress lines (media, place, line); null if it didn't end, went
    backwards or said nothing."""
    us = F.regexp_extract("line", r"^out_time_us=(-?\d+)\s*$", 1).try_cast("bigint")
    t = lines.withColumn("us", us).withColumn("bad", F.col("line").startswith("out_time_us=") & us.isNull())
    before = F.max("us").over(Window.partitionBy("media").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("back", F.coalesce((F.col("us") < before) | (F.col("us") < 0), F.lit(False)))
    state = F.max_by(F.regexp_extract("line", r"^progress=(\S+)", 1), F.when(F.col("line").startswith("progress="), F.col("place")))
    g = t.groupBy("media").agg(F.max("us").alias("us"), state.alias("state"), F.bool_or(F.col("bad") | F.col("back")).alias("broken"))
    return g.select("media", F.when((F.col("state") == "end") & ~F.col("broken") & (F.col("us") > 0), F.col("us") / 1000).cast("bigint").alias("end_ms"))


def silences(events: DataFrame) -> DataFrame:
    """(media, s, e): silence from start and end events (media, place, kind, at_ms, end_ms); media with malformed events, i.e.
    ends without starts, starts twice, or times that go back, have none. An open silence lasts to the decoded end."""
    w = Window.partitionBy("media").orderBy("place")
    e = events.withColumn("k0", F.lag("kind").over(w)).withColumn("t0", F.lag("at_ms").over(w)).withColumn("k1", F.lead("kind").over(w)).withColumn("t1", F.lead("at_ms").over(w))
    wrong = (F.col("kind") == "bad") | ((F.col("kind") == "end") & ~F.col("k0").eqNullSafe("start")) | ((F.col("kind") == "start") & F.col("k0").eqNullSafe("start")) | F.coalesce(F.col("at_ms") < F.col("t0"), F.lit(False)) | (F.col("at_ms") > F.col("end_ms") + 250) | (F.col("at_ms") < -250)
    broken = e.groupBy("media").agg(F.bool_or(wrong).alias("broken")).where("not broken").select("media")
    clip = lambda x: F.least(F.col("end_ms"), F.greatest(F.lit(0), x))
    quiet = e.where("kind = 'start'").select("media", clip(F.col("at_ms")).alias("s"), F.when(F.col("k1") == "end", clip(F.col("t1"))).otherwise(F.col("end_ms")).alias("e"))
    return quiet.join(broken, "media", "left_semi")


def audio_activity(gaps: DataFrame, ends: DataFrame, runs: DataFrame, quiet: DataFrame) -> DataFrame:
    """(media, activity): 'silent', 'active' or 'unknown' over the gaps (media, gap_start_ms, gap_end_ms) of each medium.

    Unknown where the decoder didn't come as far as a gap or no single run covers it; silent where every gap lies in one
    silence; a null (no evidence) is never the same as none.
    """
    from cuelake.operators.joins import contained

    g = gaps.select("media", "gap_start_ms", "gap_end_ms")
    far = g.join(ends, "media", "left").withColumn("reached", F.coalesce(F.col("end_ms") + 250 >= F.col("gap_end_ms"), F.lit(False)))
    heard = contained(g, runs.select("media", F.col("run_start").alias("s"), F.col("run_end").alias("e")), "media").withColumn("heard", F.lit(True))
    still = contained(g, quiet, "media").withColumn("still", F.lit(True))
    key = ["media", "gap_start_ms", "gap_end_ms"]
    j = far.join(heard, key, "left").join(still, key, "left")
    return j.groupBy("media").agg(
        F.when(~F.bool_and(F.col("reached") & F.coalesce("heard", F.lit(False))), "unknown").when(F.bool_and(F.coalesce("still", F.lit(False))), "silent").otherwise("active").alias("activity")
    )
