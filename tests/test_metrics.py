"""Metric queries: values, filters, refusals."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import AnalyticsError
from sumbrook.kinds import kinds
from sumbrook.plans.filters import date_range
from sumbrook.plans.metrics import available_metrics, metric
from sumbrook.plans.query import MAX_GROUPS, MetricQuery, calculate_metric, format_key

ROWS = [("2026-01-01", "Web", 100, 95, 5, 1000.5), ("2026-01-01", "API", 100, 55, 45, 10.1), ("2026-02-01", "Web", 300, 297, 3, 0.2), ("2026-02-01", None, 4, 4, 0, 0.1)]


@pytest.fixture(scope="module")
def payments(spark):
    df = spark.createDataFrame(ROWS, "Month string, Channel string, Transactions long, Successful long, Failed long, Amount_KZT double")
    return df.withColumn("Month", F.col("Month").cast("timestamp_ntz")).cache()


def test_ratio_of_sums_and_overall(payments):
    got = calculate_metric(payments, "success_rate", ["Channel"])
    assert [(g.keys["Channel"], g.value, g.rows_used) for g in got.rows] == [("API", 55 / 100 * 100, 1), ("Web", 392 / 400 * 100, 2), (None, 100.0, 1)]
    assert got.overall.value == pytest.approx(451 / 504 * 100) and got.rows_matched == 4


def test_month_keys_and_raw_order(payments):
    got = calculate_metric(payments, "transaction_count", ["Month"], [{"column": "Month", "op": "gte", "value": "2026-02"}])
    assert [(g.keys["Month"], g.value) for g in got.rows] == [("2026-02", 304)]


def test_float_sums_are_exact(spark):
    df = spark.createDataFrame([(0.1,)] * 10, "v double")
    assert calculate_metric(df, "sum:v").overall.value == 1.0


def test_missing_values_leave_both_sides(spark):
    df = spark.createDataFrame([("a", 10, 9.0), ("a", 90, math.nan), ("b", 10, None), ("b", 10, 5.0)], "g string, n long, s double")
    got = calculate_metric(df, "ratio:s/n", ["g"])
    assert [(g.value, g.rows_used) for g in got.rows] == [(0.9, 1), (0.5, 1)] and "2 rows were left out" in got.warnings[0]


def test_zero_denominator_and_empty_selection(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 10, 9)], "g string, n long, s long")
    got = calculate_metric(df, "ratio:s/n", ["g"])
    assert [g.value for g in got.rows] == [None, 0.9]
    none = calculate_metric(df, "sum:s", ["g"], {"g": "zzz"})
    assert none.rows == [] and none.overall.value == 0 and any("has no 'zzz'" in w for w in none.warnings)
    assert calculate_metric(df, "ratio:s/n", None, {"g": "zzz"}).overall.value is None


def test_total_in_one_shuffle(payments):
    q = MetricQuery.build(payments, "transaction_count", ["Channel"])
    got = {(r.Channel, r.is_total): r.value for r in q.with_total().collect()}
    assert got == {("Web", 0): 400, ("API", 0): 100, (None, 0): 4, (None, 1): 504}
    plan = q.with_total()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    q = MetricQuery.build(spark.read.parquet(f"{sf_dir}/orders.parquet"), "sum:o_totalprice", ["o_orderstatus"], [{"column": "o_orderdate", "op": "gt", "value": "1995-03"}, {"column": "o_custkey", "op": "in", "value": [1, 2]}])
    plan = q.grouped()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "In(o_custkey" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


def test_group_guard(spark):
    df = spark.range(MAX_GROUPS + 1).select(F.col("id").cast("string").alias("g"), F.lit(1).alias("v"))
    with pytest.raises(AnalyticsError, match="more than 200"):
        calculate_metric(df, "sum:v", ["g"])
    assert len(calculate_metric(df.where("id < 200"), "sum:v", ["g"]).rows) == MAX_GROUPS


@pytest.mark.parametrize(
    "kwargs",
    [
        {"name": "nope"}, {"name": "sum:"}, {"name": "ratio:a"}, {"name": "ratio:a/b/c"}, {"name": "sum:Channel"}, {"name": "sum:missing"}, {"name": 7},
        {"group_by": ["Chanel"]}, {"group_by": ["Channel", "Channel"]}, {"group_by": ["Channel", "Month", "Failed", "Successful"]},
        {"filters": [{"column": "Chanel", "value": "x"}]}, {"filters": [{"column": "Channel", "op": "like", "value": "x"}]}, {"filters": [{"column": "Channel", "op": "gt", "value": "x"}]},
        {"filters": [{"column": "Channel", "op": "eq", "value": 3}]}, {"filters": [{"column": "Transactions", "op": "eq", "value": True}]}, {"filters": [{"column": "Transactions", "op": "eq", "value": "3"}]},
        {"filters": [{"column": "Transactions", "op": "eq", "value": math.inf}]}, {"filters": [{"column": "Transactions", "op": "between", "value": [5, 1]}]}, {"filters": [{"column": "Transactions", "op": "in", "value": []}]},
        {"filters": [{"column": "Transactions", "op": "in", "value": list(range(101))}]}, {"filters": [{"column": "Month", "op": "eq", "value": "2026-13"}]}, {"filters": [{"column": "Month", "op": "eq", "value": "March"}]},
        {"filters": [{"column": "Channel"}]}, {"filters": "Channel = 'Web'"}, {"filters": [{"column": "Channel", "value": "x"}] * 11},
    ],
)
def test_refusals(payments, kwargs):
    with pytest.raises(AnalyticsError):
        MetricQuery.build(payments, kwargs.get("name", "transaction_count"), kwargs.get("group_by"), kwargs.get("filters"))


def test_personal_columns_are_gated(payments):
    for kwargs in ({"group_by": ["Channel"]}, {"filters": {"Channel": "Web"}}):
        with pytest.raises(AnalyticsError, match="personal"):
            MetricQuery.build(payments, "transaction_count", sensitive=frozenset({"Channel"}), **kwargs)


def test_values_are_data_not_code(payments):
    got = calculate_metric(payments, "transaction_count", None, {"Channel": "Web' OR '1'='1"})
    assert got.overall.value == 0


def test_metric_names(payments):
    assert "success_rate" in available_metrics(kinds(payments)) and not any(":" in m for m in available_metrics(kinds(payments)))
    of = {"Revenue_KZT": "numeric", "Orders": "numeric", "Cancelled_Orders": "numeric"}
    from sumbrook.kinds import Kind

    found = available_metrics({k: Kind(v) for k, v in of.items()})
    assert "ratio:Revenue_KZT/Orders" in found and "rate:Cancelled_Orders/Orders" in found and len(found) == 7
    assert metric("sum:Revenue_KZT").unit == "KZT" and metric("rate:a/b").unit == "%" and metric("sum:Net_Sales").label == "Net Sales"


def test_sources_are_found_without_case(spark):
    df = spark.createDataFrame([(1, 2)], "transactions long, x long")
    assert calculate_metric(df, "transaction_count").overall.value == 1


def test_date_ranges():
    assert date_range("2026-12", "c") == (datetime(2026, 12, 1), datetime(2027, 1, 1))
    assert date_range("2026-02-28", "c")[1] == datetime(2026, 3, 1)
    assert date_range("2026-02-28 10:30:05", "c") == (datetime(2026, 2, 28, 10, 30, 5), datetime(2026, 2, 28, 10, 30, 6))
    assert format_key(datetime(2026, 3, 1), True) == "2026-03" and format_key(datetime(2026, 3, 2), False) == "2026-03-02" and format_key(None, True) is None
