"""Cues in the windows of their media: against brute force, against the SQL twins, and with no broadcast that grows."""

import random
import re

import duckdb
import pytest

from cuelake.catalog import core
from cuelake.operators import chunks, joins


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A few long media, so that their windows are many times what the table's size tells; cues without length, too."""
    d, r = tmp_path_factory.mktemp("windows"), random.Random(4)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute("CREATE TABLE sources AS SELECT i AS source_key, i * 9000.5 AS duration_seconds FROM range(1, 41) t(i)")
    con.execute("CREATE TABLE transcripts AS SELECT i AS transcript_id, i % 40 + 1 AS source_key, 'en' AS language, 'asr' AS method, TIMESTAMP '2025-01-01' AS created_at FROM range(80) t(i)")
    con.execute("CREATE TABLE segments (segment_id BIGINT, transcript_id BIGINT, ordinal INTEGER, start_seconds DOUBLE, end_seconds DOUBLE, text VARCHAR, confidence DOUBLE, loaded_at TIMESTAMP)")
    starts = [r.choice([r.uniform(0, 200), 25.0 * r.randint(0, 8) + r.choice([-0.1, 0, 0.1, 4.9, 5, 5.1])]) for _ in range(2000)]
    rows = [(i, i % 80, i, round(max(s, 0), 3), round(max(s, 0) + r.choice([0, 0, 0.05, 2, 7, 90]), 3), r.choice(["yes", "no", "go on"])) for i, s in enumerate(starts)]
    con.executemany("INSERT INTO segments VALUES (?, ?, ?, ?, ?, ?, NULL, TIMESTAMP '2025-01-01')", rows)
    for t in ("sources", "transcripts", "segments"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d), con


@pytest.mark.parametrize("name", ["FLT04", "JN03", "PIP06"])
def test_twins_on_cues_at_borders_and_without_length(spark, tables, name):
    d, con = tables
    got = core.QUERIES[name](spark, d)
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({core.SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(theirs)


@pytest.mark.parametrize("name", ["JN03", "PIP06"])
def test_windows_are_never_broadcast(spark, tables, name):
    """Windows of long media look as small as the table of media; joined to cues they went to the driver whole."""
    plan = core.QUERIES[name](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            inside = below[: next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))]
            assert not any("Generate" in x for x in inside)


def test_in_windows_matches_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice([1, 900, 3000, 3001, 7000, 7001]), s := r.randint(0, 8000), s + r.choice([0, 1, 500, 3000, 10**15])) for i in range(400)] + [(1000, 9 * 10**15, 0, 10**15), (1001, 0, 0, 5), (1002, 5000, None, 5)]
    got = sorted((x.media, x.chunk, x.ws, x.we) for x in chunks.in_windows(spark.createDataFrame(rows, "media bigint, duration_ms bigint, s bigint, e bigint"), 3000, 1000).collect())
    windows = lambda d: [(k, k * 2000, min(d, k * 2000 + 3000)) for k in range(max(-(-(d - 3000) // 2000), 0) + 1)]
    assert got == sorted((i, *w) for i, d, s, e in rows[:400] for w in windows(d) if s < w[2] and e > w[1])


def test_copies_over_borders_go(spark):
    rows = [(1, 0, 0, 26_000, 29_000, "a"), (1, 1, 25_000, 26_100, 29_100, "a"), (1, 1, 25_000, 31_000, 32_000, "a"), (1, 1, 25_000, 30_000, 30_000, "b"), (1, 0, 0, 30_000, 30_000, "b"), (1, 1, 25_000, 26_000, 29_000, None), (1, 0, 0, 26_000, 29_000, None)]
    df = spark.createDataFrame(rows, "media int, chunk bigint, ws bigint, s bigint, e bigint, text string")
    kept = {(x.chunk, x.s, x.text) for x in joins.without_boundary_copies(df, "media", 30_000, 5_000).collect()}
    assert kept == {(0, 26_000, "a"), (1, 31_000, "a"), (0, 30_000, "b"), (1, 26_000, None), (0, 26_000, None)}
