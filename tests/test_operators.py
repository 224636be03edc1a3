import dataclasses
import json
import random
import socket
import time
import types

import pytest
from pyspark.sql import functions as F

from cuelake.functions import language as lang
from cuelake.functions import text as tx
from cuelake.functions import times as tm
from cuelake import session
from cuelake.functions import udfs
from cuelake.operators import chunks, cues, folds, intervals, joins, sequences
from cuelake.plans import cache, hybrid, planning
from cuelake.plans.incremental import EphemeralStore, Store, open_store, run_incrementally
from cuelake.sinks import render
from cuelake.sinks.bundles import Bundles, BundleWriter
from cuelake.sources import captions, logs, seams
from cuelake.streaming import frames as stream


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("text", "clean"), [("<b>Hi</b> &amp; bye\nHi & bye\n{\\an8}Next", "Hi & bye Next"), ("a\r\n\r\na", "a"), ("", ""), (None, None), ("&amp;lt;", "&lt;")])
def test_clean_cue(spark, text, clean):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.clean_cue(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize(("stamp", "seconds"), [("01:02,500", 62.5), ("1:00:00.5", 3600.5), ("100:00:01.25", 360001.25), ("x", None), ("1:2.3", None)])
def test_parse_timestamp(spark, stamp, seconds):
    assert one(spark, tm.parse_timestamp(F.col("s")), s=stamp) == seconds


@pytest.mark.parametrize(("seconds", "ms"), [(1.0005, 1001), (360003.99951, 360004000), (0.0, 0), (2.675, 2675)])
def test_half_up_milliseconds(spark, seconds, ms):
    assert one(spark, tm.half_up_ms(F.col("s")), s=seconds) == ms


def test_display_times(spark):
    assert one(spark, tm.display_time(F.col("s")), s=-3.0) == "00:00"
    assert one(spark, tm.display_time(F.col("s")), s=3661.9) == "01:01:01"
    assert one(spark, tm.subtitle_time(F.col("s")), s=360_000_000) == "100:00:00,000"
    assert one(spark, tm.warning_time(F.col("s")), s=400.125) == "00:06:40.125"
    assert one(spark, tm.short_duration(F.col("s")), s=61.5) == "1:02"


@pytest.mark.parametrize(("candidate", "wanted", "ok"), [("zh_TW", "zh-Hant", True), ("zh-TW", "zh-Hans", False), ("EN-us", "en", True), ("zh", "zh-Hans", True), ("yue", "zh-Hant", False)])
def test_language_matches(spark, candidate, wanted, ok):
    assert one(spark, lang.language_matches(F.col("a"), F.col("b")), a=candidate, b=wanted) is ok


@pytest.mark.parametrize(("name", "safe"), [("CON", "_CON"), ("nul.txt", "_nul.txt"), ("LPT9.", "_LPT9"), ("..", "untitled"), ("a/b:c", "a-b-c"), ("Ｘ" * 200, "X" * 100), (None, "untitled")])
def test_portable_names(spark, name, safe):
    df = spark.createDataFrame([(name, None)], "a string, b string")
    assert df.select(udfs.portable_name(F.col("a"), F.col("b"))).first()[0] == safe


def test_portable_fallback_may_be_a_device(spark):
    assert one(spark, udfs.portable_name(F.col("a"), F.col("b")), a="...", b="AUX") == "_AUX"


@pytest.mark.parametrize(("a", "b", "same"), [("Hello, world", "hello world!", True), ("", "x", False), ("今天我们学习", "今天我们学刁", False), ("the quick brown fox", "the quick brown f0x", True), ("one two", "ten nine", False)])
def test_alike(spark, a, b, same):
    assert one(spark, udfs.captions_alike(F.col("a"), F.col("b")), a=a, b=b) is same


@pytest.mark.parametrize(("a", "b", "prefix"), [("abc", "abd", "ab"), ("", "x", ""), ("same", "same", "same"), ("\U0001f600x", "\U0001f600y", "\U0001f600"), ("a" * 70_000 + "b", "a" * 70_000 + "c", "a" * 70_000)])
def test_common_prefixes(spark, a, b, prefix):
    assert one(spark, tx.common_prefix(F.col("a"), F.col("b")), a=a, b=b) == prefix


def test_scan_captions(spark):
    vtt = "﻿WEBVTT\r\n\r\nNOTE x\r\n\r\n1\r\n00:01.250 --> 00:03.500 align:start\r\n<i>First</i> line\r\n \t\r\n00:05.000 --> 00:04.000\r\nbackwards\r\n\r\n01:02:03,5 --> 01:02:03,5\r\nA &lt; B\r\nA &lt; B"
    got = captions.scan_captions(spark.createDataFrame([(1, vtt), (2, ""), (3, None)], "id int, body string"), "id", "body").orderBy("place").collect()
    assert [(r.id, r.s, r.e, r.text) for r in got] == [(1, 1250, 3500, "First line"), (1, 3723500, 3723500, "A < B")]


def cue_rows(seed, n=120):
    r = random.Random(seed)
    texts = ["so", "so we", "so we go", "on", "on and on", "stop"]
    rows = [(i, r.randint(1, 3), i, s := r.randint(0, 60_000), s + r.choice([0, 300, 900, 4000]), r.choice(texts), None) for i in range(n)]
    return rows


CUE = "segment_id bigint, transcript_id bigint, ordinal int, s bigint, e bigint, text string, confidence double"


def test_rolling_merge_matches_a_plain_fold(spark):
    rows = cue_rows(3)
    expected = []
    for t in {r[1] for r in rows}:
        merged = []
        for _, _, _, s, e, x, _ in sorted((r for r in rows if r[1] == t), key=lambda r: (r[3], r[4], r[2])):
            p = merged[-1] if merged else None
            if p and s <= p[1] + 500 and (x.startswith(p[2]) or p[2].startswith(x)):
                merged[-1] = (p[0], max(p[1], e), max(p[2], x, key=len))
            else:
                merged.append((s, e, x))
        expected += [(t, *m) for m in merged]
    got = [tuple(r) for r in cues.merge_rolling(spark.createDataFrame(rows, CUE)).collect()]
    assert sorted(got) == sorted(expected)


def test_running_over_blocks_matches_brute_force(spark):
    rows = cue_rows(5)
    df = spark.createDataFrame(rows, CUE).withColumn("b", F.floor(F.col("s") / 5000))
    got = {r.segment_id: r.m for r in sequences.running(df, ["transcript_id"], "b", ["s", "e", "ordinal"], F.col("e"), "max", "m").collect()}
    for r in rows:
        before = [q[4] for q in rows if q[1] == r[1] and (q[3], q[4], q[2]) < (r[3], r[4], r[2])]
        assert got[r[0]] == (max(before) if before else None)


def test_overlaps_match_brute_force(spark):
    a, b = cue_rows(8), cue_rows(9)
    met = joins.overlaps(spark.createDataFrame(a, CUE), spark.createDataFrame(b, CUE), "transcript_id", 2000)
    got = sorted((r.segment_id, r.r_segment_id) for r in met.collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and max(x[3], y[3]) < min(x[4], y[4]))


def test_chunk_windows(spark):
    m = spark.createDataFrame([(1, 7000), (2, 3000), (3, 0), (4, None), (5, 9 * 10**15)], "media bigint, duration_ms bigint")
    got = [tuple(r) for r in chunks.chunk_windows(m, 3000, 1000).orderBy("media", "chunk").collect()]
    assert got == [(1, 0, 0, 3000, None), (1, 1, 2000, 5000, None), (1, 2, 4000, 7000, None), (2, 0, 0, 3000, None), (5, None, None, None, "too many windows")]
    grid = stream.frame_grid(m.where("media > 1"), 1000).orderBy("media", "ordinal").collect()
    assert [(r.media, r.ordinal, r.at_ms, r.error) for r in grid] == [(2, 0, 0, None), (2, 1, 1000, None), (2, 2, 2000, None), (5, None, None, "too many frames")]


def test_hybrid_keeps_speech_of_other_words(spark):
    say = spark.createDataFrame([(1, 1, 0, 0, 10_000, "no way", None), (2, 1, 1, 20_000, 24_000, "yes", None), (3, 1, 2, 50_000, 50_000, "hm", None)], CUE)
    see = spark.createDataFrame([(11, 1, 0, 0, 5_000, "No", None), (12, 1, 1, 5_000, 9_000, "way!", None), (13, 1, 2, 20_000, 24_000, "not yes", None)], CUE)
    got = {(r.segment_id, r.branch) for r in hybrid.merge(say, see, "transcript_id").collect()}
    assert got == {(2, "speech"), (3, "speech"), (11, "visible"), (12, "visible"), (13, "visible")}


def test_decoded_runs_break_on_accumulated_holes(spark):
    rows = [(1, i, i * 101, 100) for i in range(8)] + [(2, 0, 0, 100), (2, 1, 100, 100), (3, 0, 0, 0)]
    got = sorted(tuple(r) for r in folds.decoded_runs(spark.createDataFrame(rows, "media int, place int, s bigint, length_ms bigint")).collect())
    assert got == [(1, 0, 300), (1, 303, 603), (1, 606, 806), (2, 0, 200)]


def test_decoded_end(spark):
    rows = [(1, 0, "out_time_us=5000"), (1, 1, "progress=end"), (2, 0, "out_time_us=5000"), (2, 1, "out_time_us=4000"), (2, 2, "progress=end"), (3, 0, "out_time_us=9000"), (3, 1, "progress=continue"), (4, 0, "out_time_us=x"), (4, 1, "progress=end")]
    got = {r.media: r.end_ms for r in folds.decoded_end(spark.createDataFrame(rows, "media int, place int, line string")).collect()}
    assert got == {1: 5, 2: None, 3: None, 4: None}


def test_silences_and_activity(spark):
    e = [(1, 0, "start", 0, 9000), (1, 1, "end", 4000, 9000), (1, 2, "start", 5000, 9000), (2, 0, "end", 5, 9000), (3, 0, "start", 1, 9000), (3, 1, "start", 2, 9000)]
    quiet = folds.silences(spark.createDataFrame(e, "media int, place int, kind string, at_ms bigint, end_ms bigint"))
    assert sorted(tuple(r) for r in quiet.collect()) == [(1, 0, 4000), (1, 5000, 9000)]
    gaps = spark.createDataFrame([(1, 100, 3900), (1, 5000, 9000), (4, 0, 500), (5, 0, 500)], "media int, gap_start_ms bigint, gap_end_ms bigint")
    ends = spark.createDataFrame([(1, 9000), (4, 9000), (5, None)], "media int, end_ms bigint")
    runs = spark.createDataFrame([(1, 0, 9000), (4, 0, 9000), (5, 0, 9000)], "media int, run_start bigint, run_end bigint")
    assert {r.media: r.activity for r in folds.audio_activity(gaps, ends, runs, quiet).collect()} == {1: "silent", 4: "active", 5: "unknown"}


FRAMES = [(0.0, "So it is raining", 0.9), (0.5, "So it ls raining", 0.6), (1.0, "", 0.0), (1.5, "So it is raining", 0.7), (2.0, "Then we left", 0.8), (4.5, "", 0.0), (5.0, "", 0.0), (6.0, "Bye now", 0.9)]


def test_frames_fold_like_their_stream(spark, tmp_path):
    rows = [(k, i, t, x, c, i == len(FRAMES) - 1) for k in (1, 2) for i, (t, x, c) in enumerate(FRAMES)]
    df = spark.createDataFrame(rows, stream.FRAME)
    batch = sorted(tuple(r) for r in folds.fold_frames(df).collect())
    assert batch == [(k, *s) for k in (1, 2) for s in ((0, 2000, "So it is raining", 0.9), (2000, 2500, "Then we left", 0.8), (6000, 6500, "Bye now", 0.9))]
    for n, part in enumerate((df.where("frame_ordinal < 3"), df.where("frame_ordinal between 3 and 5"), df.where("frame_ordinal > 5"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_available(stream.fold_stream(stream.read_frames(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
        assert n < 3
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == batch


def test_stream_keeps_each_content_once_and_repeats_nothing(spark, tmp_path):
    rows = [(1, i, i * 0.5, "ab"[i % 2], 0.9, False) for i in range(6)]
    spark.createDataFrame(rows, stream.FRAME).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = stream.once_per_content(stream.read_frames(spark, f"{tmp_path}/in"))
        stream.write_batches(q, ["digest"], f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_store_resumes_and_refuses_pending(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", "r1")
    work = spark.range(4).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("i").alias("identity"), "id")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return missing.select("key", "identity", F.concat(F.lit("p"), "id").alias("payload"), (F.col("id") == 3).alias("pending"))

    assert run_incrementally(store, work, compute).count() == 3
    assert run_incrementally(store, work, compute).count() == 3
    assert calls == [4, 1]
    assert Store(spark, f"{tmp_path}/store", "r2").rows().count() == 0
    assert store.usage().first().results == 3


def test_bundles_are_all_or_nothing(spark, tmp_path):
    spark.dataSource.register(Bundles)
    df = spark.createDataFrame([("a/x.txt", "one"), ("a/y.txt", "two\r\n")], "path string, content string")
    df.write.format("bundles").mode("append").option("path", str(tmp_path)).save()
    assert (tmp_path / "a/y.txt").read_bytes() == b"two\r\n"
    w = BundleWriter(str(tmp_path))
    row = types.SimpleNamespace
    with pytest.raises(ValueError, match="out of the folder"):
        w.write(iter([row(path="a/x.txt", content="new"), row(path="../evil", content="")]))
    staged = w.write(iter([row(path="a/x.txt", content="newer")]))
    w.abort([staged, None])
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["x.txt", "y.txt"]
    assert (tmp_path / "a/x.txt").read_text() == "one"


def test_export_and_scan_round_trip(spark):
    rows = [(1, 1, 0, 0, 0, "<b>& --> ok", None), (2, 1, 1, 60_000, 60_001, "zwei 🙂", 0.5), (3, 1, 2, 360_001_235, 360_004_000, "end", None)]
    numbered = render.numbered(spark.createDataFrame(rows, CUE))
    doc = render.bodies(numbered, render.cue_block(","), "\n\n", "body")
    got = [(r.s, r.e, r.text) for r in captions.scan_captions(doc, "transcript_id", "body").orderBy("place").collect()]
    assert got == [(0, 1, "<b>& --> ok"), (60_000, 60_001, "zwei 🙂"), (360_001_235, 360_004_000, "end")]


def test_long_transcripts_come_in_parts(spark):
    numbered = render.numbered(spark.createDataFrame(cue_rows(1), CUE).withColumn("transcript_id", F.lit(1).cast("bigint")), most_cues=50)
    assert sorted(r["count"] for r in numbered.groupBy("part").count().collect()) == [20, 50, 50]


def test_plans_for_local_sound(spark):
    s = spark.createDataFrame([(1, "local", "audio", False), (2, "youtube", "video", True)], "source_key bigint, platform string, media_type string, has_subtitle boolean")
    got = {(r.source_key, r.mode): r for r in planning.plans(s).collect()}
    assert got[(1, "auto")].route == "whisper"
    assert not got[(1, "ocr")].processable
    assert not got[(1, "captions")].processable
    assert (got[(2, "auto")].media_download, got[(2, "auto")].purpose, got[(2, "auto")].fallback) == ("conditional", "analysis-video", "audio")
    assert all(r.purpose is None or r.purpose != r.fallback for r in got.values())


def test_retries_only_what_is_transient():
    waits, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise seams.Transient("412")
        return "ok"

    assert seams.with_retries(flaky, sleep=waits.append) == "ok"
    assert waits == [0.5, 1.5]
    with pytest.raises(KeyError):
        seams.with_retries(lambda: {}["x"], sleep=waits.append)


def test_isolated_errors_are_rows(spark):
    got = {r.v: (r.result, r.error) for r in seams.apply_isolated(spark.createDataFrame([("1",), ("x",)], "v string"), "v", lambda v: str(int(v) + 1)).collect()}
    assert got["1"] == ("2", None)
    assert got["x"][0] is None
    assert "invalid literal" in got["x"][1]


def test_largest_finished_file():
    assert seams.largest_finished({"a.mp4": 5, "b.mp4": 9, "c.mp4.part": 99}) == "b.mp4"
    assert seams.largest_finished({"c.part": 1}) is None


def test_authentication_is_one_of_two():
    with pytest.raises(ValueError, match="not both"):
        seams.Authentication("firefox", "c.txt")


def test_storage_trouble_stops_no_work(spark, tmp_path):
    bad = tmp_path / "file"
    bad.write_text("no folder")
    store, warning = open_store(spark, str(bad), "r1")
    assert isinstance(store, EphemeralStore)
    assert "can't be kept" in warning
    work = spark.range(2).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("i").alias("identity"))
    assert run_incrementally(store, work, lambda m: m.select("key", "identity", F.lit("p").alias("payload"), F.lit(False).alias("pending"))).count() == 2
    assert open_store(spark, None, "r1")[1] is None


def test_progress_is_reported(spark, tmp_path):
    seen, stop = stream.progress_log(spark)
    spark.createDataFrame([(1, i, i * 0.5, "a", 0.9, False) for i in range(3)], stream.FRAME).write.parquet(f"{tmp_path}/in")
    stream.run_available(stream.read_frames(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(50):
        if sum(n for _, n in seen) >= 3:
            break
        time.sleep(0.1)
    assert sum(n for _, n in stop(seen)) >= 3


def test_entities_are_decoded_once(spark):
    df = spark.createDataFrame([("Caf&eacute; it&rsquo;s&nbsp;on &amp;lt; &#x41;&#66; &copy 5",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.clean_cue(F.col("t"))).collect()] == ["Café it’s on &lt; AB © 5", "plain", None]


def test_long_blocks_before_a_timing_are_scanned(spark):
    body = "\n".join(f"line {i}" for i in range(100_000)) + "\n00:01.000 --> 00:02.000\ntext"
    got = captions.scan_captions(spark.createDataFrame([(1, body)], "id int, body string"), "id", "body").collect()
    assert [(r.s, r.e, r.text) for r in got] == [(1000, 2000, "text")]


def test_neighbours_reach_over_blocks(spark):
    rows = spark.createDataFrame([(1, i, i) for i in (0, 1, 4095, 4096, 4097, 20_000)], "k int, o int, v int").withColumn("b", F.expr("o div 4096"))
    got = {r.o: r.before for r in sequences.previous(rows, ["k"], "b", ["o"], {"before": "v"}).collect()}
    assert got == {0: None, 1: 0, 4095: 1, 4096: 4095, 4097: 4096, 20_000: 4097}


def test_outsized_intervals_meet_in_joins(spark):
    r = random.Random(1)

    def rows(n):
        out = []
        for i in range(n):
            s = r.randint(0, 10**7)
            out.append((r.randint(0, 2), i, s, s + r.randint(0, r.choice([0, 500, 5000, 10**6, 10**8, 10**12, 8 * 10**15]))))
        return out

    left, right = rows(60), rows(60)
    a, b = (spark.createDataFrame(x, "k long, segment_id long, s long, e long") for x in (left, right))
    got = sorted((x.segment_id, x.r_segment_id, x.os, x.oe) for x in joins.overlaps(a, b, "k").collect())
    assert got == sorted((i, j, max(s, t), min(e, f)) for k, i, s, e in left for m, j, t, f in right if k == m and max(s, t) < min(e, f))
    g = b.select("k", F.col("s").alias("gap_start_ms"), F.col("e").alias("gap_end_ms"))
    got = sorted(x.segment_id for x in joins.touching(a, g, "k").collect())
    assert got == sorted({i for k, i, s, e in left for m, j, t, f in right if k == m and ((s < f and e > t) or (s == e and t <= s < f))})
    got = sorted((x.k, x.gap_start_ms, x.gap_end_ms) for x in joins.contained(g, a, "k").collect())
    assert got == sorted({(m, t, f) for k, i, s, e in left for m, j, t, f in right if k == m and s <= t + 250 and e >= f - 250 and max(s, t) < min(e, f)})


def reading(*rows):
    return [(1, i, float(t), text, float(conf)) for i, (t, text, conf) in enumerate(rows)]


@pytest.mark.parametrize(
    ("frames", "found"),
    [
        (reading((0, "hello there", 0.9), (0.5, "hello there", 0.9), (1, "", 0), (1.5, "hello there", 0.9)), [(0, 2000, "hello there")]),
        (reading((0, "hello there", 0.9), (0.5, "", 0), (1.0, "", 0), (1.5, "hello there", 0.9)), [(0, 500, "hello there"), (1500, 2000, "hello there")]),
        (reading((0, "first words", 0.9), (0.25, "another caption", 0.9)), [(0, 500, "first words"), (250, 750, "another caption")]),
        (reading((0, "the same line x1", 0.4), (0.5, "the same line y2", 0.4)), [(0, 1000, "the same line")]),
        (reading((0, "helo there", 0.3), (0.5, "hello there", 0.6)), [(0, 1000, "hello there")]),
        (reading((0, "", 0), (0.5, "", 0)), []),
    ],
)
def test_frames_fold_into_captions(spark, frames, found):
    df = spark.createDataFrame(frames, "source_key long, frame_ordinal int, timestamp_seconds double, text string, confidence double")
    got = sorted((r.start_ms, r.end_ms, r.text) for r in folds.fold_frames(df, block_ms=1000).collect())
    assert got == found


def test_frame_folds_dont_depend_on_cuts(spark):
    """Cut into stretches and blocks against one pass over the frames of a source."""
    r = random.Random(9)
    lines = ["the quick brown fox", "the quick brown f0x", "jumps over it", "jumps over lt", "", "", "a lazy dog 1", "a lazy dog 2"]
    frames = [(k, i, i * 0.5 + r.choice([0, 0.125]), r.choice(lines), round(r.random(), 2)) for k in range(3) for i in range(150)]
    df = spark.createDataFrame(frames, "source_key long, frame_ordinal int, timestamp_seconds double, text string, confidence double")
    want = []
    for k in range(3):
        shown = None
        for _, _, t, text, conf in [f for f in frames if f[0] == k]:
            at = round(t * 1000)
            if not text:
                if shown and at - shown.seen > 750:
                    want.append((k, shown.start, shown.ends(500), shown.text))
                    shown = None
                continue
            frame = folds.Caption(at, at, text, folds.folded(text), conf)
            longer = folds.continued(shown, frame) if shown else None
            if shown and not longer:
                want.append((k, shown.start, shown.ends(500, at), shown.text))
            shown = longer or frame
        if shown:
            want.append((k, shown.start, shown.ends(500), shown.text))
    got = sorted((x.source_key, x.start_ms, x.end_ms, x.text) for x in folds.fold_frames(df, block_ms=5000).collect())
    assert got == sorted(want)


def test_parts_have_one_head_and_one_tail(spark):
    heads = spark.createDataFrame([(1, "T", "id", "u", "w", "p", "a", 9, "en", "ocr", ["careful"])], "transcript_id long, title string, source_id string, url string, webpage_url string, platform string, author string, seconds long, language string, method string, warnings array<string>")
    c = spark.createDataFrame([(i, 1, i, i * 1000, i * 1000 + 500, f"t{i}", None) for i in range(7)], CUE)
    numbered = render.numbered(c, 3)
    docs = [r.document for r in render.markdown(heads, numbered, False).orderBy("part").collect()]
    assert [d.startswith("# T\n") for d in docs] == [True, False, False]
    assert [d.count("careful") for d in docs] == [0, 0, 1]
    assert [r.document.count("WEBVTT") for r in render.webvtt(numbered).orderBy("part").collect()] == [1, 0, 0]


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_jpeg_streams_are_split_wherever_chunks_end(cut):
    images = [b"\xff\xd8" + bytes([i]) * i + b"\xff\x00" + b"\xff\xd9" for i in range(5)]
    whole = b"junk\xff" + b"--".join(images) + b"\xff"
    parts = [whole[i : i + cut] for i in range(0, len(whole), cut)]
    assert list(stream.split_jpegs(parts)) == images
    with pytest.raises(ValueError, match="inside an image"):
        list(stream.split_jpegs([whole, b"\xff\xd8 unfinished"]))
    with pytest.raises(ValueError, match="without an end"):
        list(stream.split_jpegs([b"\xff\xd8", b"x" * 100, b"x" * 100], most=50))


def test_a_second_run_is_refused_and_a_dead_one_replaced(tmp_path):
    with stream.single_flight(str(tmp_path)), pytest.raises(stream.Busy), stream.single_flight(str(tmp_path)):
        pass
    (tmp_path / ".lock").write_text(f"{socket.gethostname()} 999999999")
    with stream.single_flight(str(tmp_path)):
        assert (tmp_path / ".lock").exists()
    assert not (tmp_path / ".lock").exists()


def test_decoder_lines(spark):
    lines = [
        "[Parsed_ashowinfo_0 @ 0x1] n:0 pts_time:0 rate:48000 nb_samples:1024", "[ashowinfo @ 0x1] n:1 pts_time:0.0213 rate:48000 nb_samples:1024", "noise pts_time:1", "[silencedetect @ 0x2] silence_start: 0.5",
        "[silencedetect @ 0x2] silence_end: 2.5 | silence_duration: 2", "[silencedetect @ 0x2] silence_start: soon", "[Parsed_silencedetect_1 @ 0x2] silence_start: 5 silence_end: 6",
    ]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "media long, place int, line string")
    assert [(r.s, r.length_ms) for r in logs.frame_lines(df).orderBy("place").collect()] == [(0, 21333), (21300, 21333)]
    assert [(r.kind, r.at_ms) for r in logs.silence_lines(df).orderBy("place").collect()] == [("start", 500), ("end", 2500), ("bad", None), ("start", 5000), ("end", 6000)]
    runs = folds.decoded_runs(logs.frame_lines(df), per_ms=logs.PER_MS).collect()
    assert [(r.run_start, r.run_end) for r in runs] == [(0, 43)]


def test_sample_lengths_dont_drift(spark):
    """A thousand frames of 1024 samples at 44100 a second, with times rounded to milliseconds, are one run."""
    lines = [(1, i, f"[ashowinfo @ 0x1] n:{i} pts_time:{round(i * 1024 / 44100, 3)} rate:44100 nb_samples:1024") for i in range(1000)]
    runs = folds.decoded_runs(logs.frame_lines(spark.createDataFrame(lines, "media long, place int, line string")), per_ms=logs.PER_MS).collect()
    assert [(r.run_start, r.run_end) for r in runs] == [(0, round(1000 * 1024 / 44.1))]


def test_kept_transcripts_are_typed_strictly(spark):
    good = {"schema": 1, "pipeline_revision": "r1", "part": 0, "parts": 1, "transcript": {"metadata": {"url": "u", "platform": "p", "source_id": "s", "duration_seconds": 1.5}, "language": "en", "method": "rapidocr", "segments": [{"start_seconds": 0, "end_seconds": 1.5, "text": "x", "confidence": None}], "warnings": [], "verification_pending": False}}

    def spoilt(*path, value):
        d = json.loads(json.dumps(good))
        at = d
        for p in path[:-1]:
            at = at[p]
        at[path[-1]] = value
        return json.dumps(d)

    rows = [
        (json.dumps(good), True), (spoilt("transcript", "segments", value=[]), True), (json.dumps(good)[:-5], False), ("", False), (None, False), ("[1]", False), (spoilt("schema", value=2), False), (spoilt("schema", value="1"), False),
        (spoilt("transcript", "warnings", value="none"), False), (spoilt("transcript", "segments", value={}), False), (spoilt("transcript", "segments", 0, value="x"), False), (spoilt("transcript", "metadata", "source_id", value=5), False),
        (spoilt("transcript", "metadata", "duration_seconds", value="1.5"), False), (spoilt("transcript", "verification_pending", value=True), False), (spoilt("transcript", "verification_pending", value="no"), False),
        (spoilt("transcript", "segments", 0, "end_seconds", value=-1), False), (spoilt("transcript", "segments", 0, "text", value=" "), False), (spoilt("transcript", "method", value="guess"), False),
    ]
    df = spark.createDataFrame([(f"k{i}", p) for i, (p, _) in enumerate(rows)], "key string, payload string")
    got = {r.key for r in cache.decode(df).collect()}
    assert got == {f"k{i}" for i, (_, ok) in enumerate(rows) if ok}


def test_keys_depend_on_every_option(spark):
    s = spark.createDataFrame([("p", "s", " u ", "w", 1.5, "video")], "platform string, source_id string, url string, webpage_url string, duration_seconds double, media_type string")
    o = cache.Options()
    others = [dataclasses.replace(o, **{f: v}) for f, v in {"mode": "ocr", "language": "de", "caption_languages": ("de",), "whisper_model": "base", "ocr_profile": "fast", "ocr_region": (0.0, 0.0, 1.0, 0.5), "auth_scope": "cookie-file:x"}.items()]
    keys = s.select(*[cache.transcript_key(x).alias(str(i)) for i, x in enumerate([o, *others])]).first()
    assert len(set(keys)) == 8
    assert s.withColumn("url", F.lit("u")).select(cache.transcript_key(o)).first()[0] == keys[0]


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "a.vtt").write_bytes(b"\xef\xbb\xbfWEBVTT\n\n00:01.000 --> 00:02.000\nab\xffc\n")
    got = captions.read_captions(spark, str(tmp_path)).collect()
    assert [(r.s, r.e, r.text) for r in got] == [(1000, 2000, "ab\ufffdc")]


def test_outsized_durations_and_reports_end(spark):
    bounds = spark.createDataFrame([(1, 9 * 10**15, 60_000.0)], "key long, limit_ms long, threshold_ms double")
    union = intervals.interval_union(spark.createDataFrame([(1, 0, 5000)], "key long, s long, e long"), "key", "s", "e")
    found = intervals.gaps(union, bounds)
    covers = spark.createDataFrame([(1, 0, 8 * 10**15), (1, 10**6, 10**6 + 10)], "key long, s long, e long")
    got = intervals.coverage_of(found, covers).first()
    assert (got.gap_start_ms, got.gap_end_ms, got.covered_ms) == (5000, 9 * 10**15, 8 * 10**15 - 5000)


def test_inputs_are_trimmed_unless_files_and_never_blank(spark):
    assert one(spark, tx.normal_url(F.col("u"), F.col("f")), u=" https://x ", f=False) == "https://x"
    assert one(spark, tx.normal_url(F.col("u"), F.col("f")), u=" https://x ", f=True) == " https://x "
    assert one(spark, tx.required_input(F.col("u")), u="x") == "x"
    with pytest.raises(Exception, match="must not be blank"):
        one(spark, tx.required_input(F.col("u")), u=" \u3000")


def test_shared_folders(spark):
    assert str(session.mounted("/a/b")) == str(session.mounted("file:///a/b")) == str(session.mounted("file:/a/b")) == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        session.mounted("s3a://bucket/a")
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
