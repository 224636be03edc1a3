"""Gaps of transcripts on odd rows: nulls in every column, empty tables, ties, repeats and clashing column names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuelake.plans.timeline_gaps import p4_found

T0, T1 = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
NAN, INF = float("nan"), float("inf")
SEG = [
    (1, 0.0, 10.0, "a"), (1, 10.0, 20.0, "b"), (1, 5.0, 12.0, "c"), (1, 100.0, 110.0, "d"), (1, 30.0, 90.0, " 　"), (1, 30.0, 90.0, None), (1, None, 50.0, "x"), (1, 50.0, None, "x"),
    (1, NAN, 60.0, "x"), (1, 60.0, INF, "x"), (1, 70.0, 40.0, "x"), (1, 60.0, 60.0, "x"), (1, 280.0, 900.0, "past the end"), (2, 0.0, 5.0, "a"), (2, 65.0, 70.0, "b"), (2, 1e300, 2e300, "c"),
    (3, 1.0, 2.0, "too short"), (4, -50.0, 3.0, "early"), (None, 1.0, 2.0, "no transcript"), (9, 1.0, 2.0, "unknown transcript"), (6, 1.0, 2.0, "x" * 50_000),
]
TRS = [(1, 10, T1), (1, 11, T0), (2, 12, T0), (3, 13, T0), (4, 10, None), (5, 10, T0), (6, None, T0), (None, 10, T0)]
SRC = [(10, 300.0), (10, 300.0), (11, 5000.0), (12, NAN), (13, 80.0), (None, 100.0)]
REP = [(1, 19.0, 60.0), (1, 55.0, 120.0), (1, 110.0, 115.0), (1, 200.0, 201.0), (1, None, 5.0), (1, 300.0, 20.0), (1, NAN, 20.0), (2, 0.0, INF), (5, 0.0, 1e300), (None, 0.0, 9.0)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    tables = {
        "segments": (SEG + SEG[:6], "transcript_id bigint, start_seconds double, end_seconds double, text string"),
        "transcripts": (TRS, "transcript_id bigint, source_key bigint, created_at timestamp"),
        "sources": (SRC, "source_key bigint, duration_seconds double"),
        "coverage_gaps": (REP + REP[:3], "transcript_id bigint, start_seconds double, end_seconds double"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        for extra in ("key", "bucket", "s", "e", "carry", "language", "method"):
            df = df.withColumn(extra, F.lit("extra"))
        df.write.parquet(f"{odd}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


def test_odd_rows(spark, folders):
    got = sorted(tuple(r) for r in p4_found(spark, folders[0]).collect())
    assert got == [(1, 20_000, 100_000, "full"), (1, 110_000, 280_000, "partial"), (2, 5_000, 65_000, "none"), (4, 3_000, 300_000, "none"), (5, 0, 300_000, "full")]


def test_empty_tables(spark, folders):
    assert p4_found(spark, folders[1]).count() == 0
