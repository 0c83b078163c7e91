"""Plans that share one scan against the same queries one by one; sums at the edges of their types."""

import math
import re

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import AnalyticsError
from sumbrook.plans.query import MetricQuery, calculate_metric
from sumbrook.plans.shared import Shared, run_together
from sumbrook.plans.steps import Step, run_plan, step_facts
from sumbrook.plans.summary import summarise


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    rows = [(f"2026-0{1 + i % 4}-01 00:00:00", ("Web", "Mobile", None)[i % 3], ("North", "South")[i % 2], i % 7 if i % 11 else None, 1.5 * i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "Month string, Channel string, Region string, Orders long, Revenue double, Id long").withColumn("Month", F.col("Month").cast("timestamp_ntz"))
    path = str(tmp_path_factory.mktemp("sales") / "t.parquet")
    df.write.parquet(path)
    return spark.read.parquet(path)


STEPS = [
    ("sum:Orders", ["Month"], None), ("ratio:Revenue/Orders", ["Channel", "Region"], {"Region": "North"}), ("rate:Orders/Orders", [], {"Channel": ["Web", "Shop"]}),
    ("sum:Revenue", ["Month", "Channel"], [{"column": "Month", "op": "gte", "value": "2026-03"}]), ("sum:Orders", ["Region"], {"Region": "East"}),
]


def test_together_as_one_by_one(sales):
    queries = [MetricQuery.build(sales, *s) for s in STEPS]
    for q, got in zip(queries, run_together(queries, 200), strict=True):
        total, groups = q.overall().first(), q.sorted().collect() if q.group_by else []
        assert (got.overall.value, got.overall.rows_used, got.rows_matched) == (total.value, total.rows_used, total.rows_matched)
        assert [(r.value, r.rows_used) for r in got.rows] == [(r.value, r.rows_used) for r in groups]
        assert got.warnings == q.run().warnings
    assert "has no 'Shop'" in run_together(queries, 200)[2].warnings[-1]
    assert run_together([], 200) == []


def test_one_scan_and_one_shuffle_for_a_plan(sales):
    plan = Shared([MetricQuery.build(sales, *s) for s in STEPS], 200).parts()._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) == 1 and len(re.findall("Exchange hashpartitioning", plan)) == 1 and "ReadSchema" in plan and "Id" not in re.search("ReadSchema: (.*)", plan)[1]


def test_too_many_groups_refuse_one_step_alone(sales):
    queries = [MetricQuery.build(sales, "sum:Orders", g) for g in (["Month"], ["Channel", "Region"])]
    few, many = run_together(queries, 4)
    assert len(few.rows) == 4 and isinstance(many, AnalyticsError)
    outcome = run_plan(sales, [Step("sum:Orders", ("Region",)), Step("sum:Nothing")], summarise(sales))
    assert len(outcome.results) == 1 and "Nothing" in outcome.warnings[0]


def test_tables_must_be_the_same(sales):
    with pytest.raises(AnalyticsError):
        Shared([MetricQuery.build(sales, "sum:Orders"), MetricQuery.build(sales.limit(3), "sum:Orders")], 200)


def test_every_shape_of_step_has_its_total(sales):
    summary = summarise(sales)
    for axes in ((), ("Month",), ("Channel",), ("Month", "Region"), ("Channel", "Region")):
        step = Step("sum:Revenue", axes)
        found = {r.fact: r.value for r in step_facts(sales, step, summary).collect()}
        assert found["overall"] == sum(1.5 * i for i in range(300)), axes
        assert axes not in ((), ("Channel", "Region")) or len(found) == 1


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([float("inf"), 1.0], math.inf), ([-math.inf, 2.0], -math.inf), ([math.inf, -math.inf], math.nan), ([1e38, 1.0, -1e38], 1.0), ([1e300, 1e300], 2e300), ([0.1] * 10, 1.0),
        ([float("nan"), 3.0], 3.0), ([1e308, 1e308], math.inf), ([2.0**80, 0.5], 2.0**80), ([None, None], None),
    ],
)
def test_sums_of_doubles(spark, values, want):
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    got = calculate_metric(df, "sum:v", "g").rows
    assert (got == []) if want is None else got[0].value == want or math.isnan(want) and math.isnan(got[0].value)


def test_sums_of_longs_beyond_64_bits(spark):
    df = spark.createDataFrame([((1 << 63) - 1,)] * 3, "v long")
    assert calculate_metric(df, "sum:v").overall.value == 3 * ((1 << 63) - 1)
    assert calculate_metric(df, "ratio:v/v").overall.value == 1.0
