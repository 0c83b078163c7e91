"""Medians by narrowing, distinct counts, first values and duplicates against plain versions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sumbrook.functions import pii
from sumbrook.functions.parsing import detect
from sumbrook.kinds import Kind
from sumbrook.operators import firsts, profile, selection

INF = math.inf


@pytest.mark.parametrize("few", [4, 20_000])
def test_medians_of_any_values(spark, few, monkeypatch):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 8)
    rng = random.Random(4)
    columns = {
        "even": [rng.random() for _ in range(500)], "odd": [rng.gauss(0, 1e6) for _ in range(501)], "skewed": [2.0**-k for k in range(300)] + [1e300], "ties": [1.0] * 400 + [2.0] * 101, "one": [7.0],
        "wide": [-1.7e308, 1.7e308, 1e308, -1e308, 3.0], "ends": [INF, -INF, 1.0, 2.0], "mostly": [INF, INF, 1.0], "none": [], "pair": [1.0, 2.0], "small": [5e-324, 1e-323, 1.5e-323],
    }
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else rng.choice((None, math.nan)) for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    sizes = {c: (len(v), min(v, default=None), max(v, default=None)) for c, v in columns.items()}
    got = selection.medians(df, {c: F.col(c) for c in columns}, sizes)
    assert got == {c: statistics.median(v) if v else None for c, v in columns.items()}


def test_stats_read_no_expanded_rows(spark):
    df = spark.range(3000).selectExpr("id % 7 AS a", "cast(id AS double) AS b", "cast(id % 11 AS string) AS c", "if(id % 2 = 0, 0.0D, -0.0D) AS zero", "cast('NaN' AS double) AS nan")
    got = {r["column"]: r for r in profile.column_stats(df).collect()}
    assert [got[c]["distinct"] for c in ("a", "b", "c", "zero", "nan")] == [7, 3000, 11, 1, 0]
    assert got["b"]["median"] == 1499.5 and got["nan"]["missing"] == 3000 and got["c"]["median"] is None
    assert "Expand" not in selection.distinct_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()


def test_profile_of_no_rows(spark):
    got = profile.column_stats(spark.createDataFrame([], "a double, b string")).collect()
    assert [(r["rows"], r["distinct"], r["median"], r["missing_pct"]) for r in got] == [(0, 0, None, 0.0)] * 2


@pytest.mark.parametrize("distinct", [False, True])
def test_first_values_of_every_column(spark, distinct, monkeypatch):
    monkeypatch.setattr(firsts, "MERGED", 2)
    rng = random.Random(1)
    rows = [(i, rng.choice("abcdefgh") if rng.random() < 0.3 else None, str(i % 5), None) for i in range(400)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "_row long, x string, y string, z string").repartition(7)
    got = firsts.first_values(df, {c: F.col(c) for c in "xyz"}, "_row", 6, distinct)
    for at, c in enumerate("xyz", 1):
        values = [r[at] for r in rows if r[at] is not None]
        assert [r.value for r in got.where(got.column == c).orderBy("rank").collect()] == (list(dict.fromkeys(values)) if distinct else values)[:6]
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_personal_values_behind_empty_rows_are_found(spark):
    rows = [(i, None if i < 5000 else f"user{i}@example.com", "x" if i < 300 else None) for i in range(5300)]
    assert pii.sensitive_columns(spark.createDataFrame(rows, "_row long, contact string, note string"), "_row") == {"contact": "values"}


def test_kinds_of_many_open_columns(spark):
    rows = [(i, "2026-01-0%d" % (1 + i % 9), f"text {i}", "ab"[i % 2], None if i < 1000 else "5.3.2026") for i in range(2000)]
    found = detect(spark.createDataFrame(rows, "_row long, d string, t string, c string, late string"))
    assert {k: v[0] for k, v in found.items()} == {"d": Kind.DATETIME, "t": Kind.TEXT, "c": Kind.CATEGORICAL, "late": Kind.DATETIME}


def test_duplicates_of_wide_rows(spark):
    rows = [("a" * 5000, None, 0.0), ("a" * 5000, None, -0.0), (None, "a" * 5000, 0.0), ("b", "c", math.nan), ("b", "c", math.nan), ("b", "c", math.nan), ("bc", "", 1.0), ("b", "c", 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert profile.duplicate_rows(df).first().duplicates == 3
    assert profile.duplicate_rows(df.limit(0)).first().duplicates == 0
