import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.operators.intervals import coverage_of, gaps, interval_union, linear_merge, periods


def brute_union(rows):
    out = {}
    for k, s, e in sorted(r for r in rows if None not in r and r[2] > r[1]):
        runs = out.setdefault(k, [])
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return {(k, s, e) for k, runs in out.items() for s, e in runs}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 9)), max_size=40))
def test_linear_merge(rows):
    g, s, e = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    got = {tuple(map(int, x)) for x in zip(*linear_merge(g, s, s + e))}
    assert got == brute_union([(a, b, b + c) for a, b, c in rows])


def random_rows(seed, n=400):
    r = random.Random(seed)
    rows = [(r.randint(1, 4), s := r.randint(0, 5000), s + r.choice([0, -5, 3, 40, 400, 2500])) for _ in range(n)]
    return rows + rows[:20] + [(None, 1, 2), (1, None, 5), (1, 5, None)]


@pytest.mark.parametrize("bucket", [100, 1000, 10**9])
def test_periods_match_brute_force_over_bucket_borders(spark, bucket):
    rows = random_rows(bucket)
    df = spark.createDataFrame(rows, "k int, s bigint, e bigint").withColumnRenamed("k", "key").selectExpr("*", "'x' as bucket", "1 as carry")
    got = {tuple(r) for r in periods(interval_union(df, "key", "s", "e", bucket)).collect()}
    assert got == brute_union(rows)


@pytest.mark.parametrize("bucket", [100, 10**9])
def test_gaps_and_their_cover(spark, bucket):
    rows = [r for r in random_rows(7, 60) if None not in r]
    df = spark.createDataFrame(rows, "key int, s bigint, e bigint")
    limits = {1: 6000, 2: 90, 3: None, 4: 5000, 9: 300}
    bounds = spark.createDataFrame([(k, v, 50.0) for k, v in limits.items()], "key int, limit_ms bigint, threshold_ms double")
    found = gaps(interval_union(df, "key", "s", "e", bucket), bounds)
    expected = set()
    for k, limit in limits.items():
        runs = sorted((s, e) for kk, s, e in brute_union(rows) if kk == k)
        at = 0 if limit else (runs[0][1] if runs else None)
        for s, e in runs + ([(limit, limit)] if limit else []):
            stop = min(s, limit) if limit else s
            if at is not None and stop - at >= 50:
                expected.add((k, at, stop))
            at = max(at, e) if at is not None else e
    assert {tuple(r) for r in found.collect()} == expected
    covers = [(k, s + 13, e + 31) for k, s, e in rows[::2]]
    cov = {(r[0], r[1], r[2]): r[3] for r in coverage_of(found, spark.createDataFrame(covers, "key int, s bigint, e bigint")).collect()}
    for k, a, b in expected:
        ms = set()
        for kk, s, e in covers:
            if kk == k:
                ms.update(range(max(a, s), min(b, e)))
        assert cov[(k, a, b)] == len(ms)


def test_empty_table(spark):
    df = spark.createDataFrame([], "key int, s bigint, e bigint")
    assert interval_union(df, "key", "s", "e").count() == 0
    assert periods(interval_union(df, "key", "s", "e")).count() == 0
