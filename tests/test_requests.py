"""Finalised requests, overview charts, exact sums and the text rules that were once wrong."""

import math
from dataclasses import replace
import random

import pytest
from pyspark.sql import functions as F

from sumbrook.operators import verify
from sumbrook.operators.evalstats import compare_arms
from sumbrook.plans.query import calculate_metric
from sumbrook.plans import records
from sumbrook.plans.records import dataset_records, search_metadata
from sumbrook.plans.requests import Draft, finalise, overview_charts
from sumbrook.plans.steps import run_plan
from sumbrook.plans.summary import summarise


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(f"2026-0{m}-01 00:00:00", c, r, 10 * m, 100.0 * m) for m in range(1, 5) for c in ("Web", "Mobile") for r in ("North", "South")] * 2
    df = spark.createDataFrame(rows, "Month string, Channel string, Region string, Orders long, Revenue double")
    return df.withColumn("Month", F.col("Month").cast("timestamp_ntz")).withMetadata("Channel", {"kind": "categorical"}).withMetadata("Region", {"kind": "categorical"})


@pytest.fixture(scope="module")
def summary(sales):
    return summarise(sales)


def test_names_and_values_are_spelt_as_in_the_data(sales, summary):
    plan = finalise(sales, [Draft("SUM:revenue ", ("channel",), (("region", "eq", (" north",)), ("MONTH", "in", ("2026-02",))), "pie", "Shares")], summary)
    step = plan.steps[0]
    assert (step.metric, step.group_by, step.chart) == ("sum:Revenue", ("Channel",), "pie")
    assert step.filters == [{"column": "Region", "op": "eq", "value": "North"}, {"column": "Month", "op": "in", "value": ["2026-02"]}]
    assert {r.keys["Channel"]: r.value for r in run_plan(sales, plan.steps, summary).results[0][1].rows} == {"Web": 400.0, "Mobile": 400.0}


def test_what_the_data_lack_is_refused(sales, summary):
    drafts = [Draft("sum:Profit"), Draft("sum:Orders", ("Shop",)), Draft("sum:Orders", (), (("Region", "eq", ("East",)),)), Draft("sum:Orders", (), (("Month", "eq", ("2027-01",)),)), Draft("sum:Orders", (), (("Month", "eq", ("soon",)),)), Draft("sum:Orders", (), (("Region", "in", ()),))]
    plan = finalise(sales, drafts, summary)
    assert not plan.steps and [t for t, _ in plan.refused] == [f"Step {i}" for i in range(1, 7)]


def test_axes_are_mended(sales, summary):
    one = lambda request, *axes: finalise(sales, [Draft("sum:Orders", axes)], summary, request)
    assert one("growth by channel", "Channel").steps[0].group_by == ("Month", "Channel")
    assert one("orders", "Channel", "Region").steps[0].group_by == ("Channel",) and one("orders", "Channel", "Month", "Region").steps[0].group_by == ("Month", "Channel")
    assert one("orders").steps[0].group_by == ("Month",) and one("orders").steps[0].chart == "line"
    plan = one("orders by group", "Channel")
    assert plan.steps[0].group_by == () and plan.open == {0: tuple(summary.dimensions)}
    twice = finalise(sales, [Draft("sum:Orders", ("Channel",)), Draft("SUM:ORDERS", ("CHANNEL",))], summary)
    assert len(twice.steps) == 1
    assert len(finalise(sales, [Draft("sum:Orders", ("Channel",), (("Month", "eq", (f"2026-0{m}",)),)) for m in (1, 2, 3, 4)] + [Draft("sum:Revenue", ("Region",))], summary).steps) == 4


def test_overview_charts(summary):
    assert overview_charts(summary) == [("histogram", "Orders", None, None), ("bar", "Channel", None, None), ("line", "Month", "Orders", "Channel"), ("scatter", "Orders", "Revenue", "Channel")]


def test_records_and_their_search(spark, sales, summary):
    every = dataset_records(spark, summary, "d1", "sales").cache()
    assert [r.record_id for r in every.orderBy("record_id").collect()] == [f"col-d1-{i:03d}" for i in range(5)] + ["ds-d1"]
    assert search_metadata(every, "channel канал источник", 1, "d1", "column").first().column_name == "Channel"
    assert search_metadata(every, "  ").count() == 0 and search_metadata(every, "sales", 9, entry_type="dataset").count() == 1 and search_metadata(every, "sales", 9, "d2").count() == 0
    people = spark.createDataFrame([("Ann", 1)], "customer_email string, n long")
    assert "may hold personal data" in dataset_records(spark, summarise(people), "p", "people").where("column_name = 'customer_email'").first().text


def test_arms_are_compared_with_a_verdict(spark):
    rows = [(arm, c, r, 100.0 + c + (20 if arm == "B" else 0)) for arm in "AB" for c in range(30) for r in range(2)] + [("A", 99, 0, 5.0), ("B", 98, 0, None)]
    df = spark.createDataFrame(rows, "arm string, case_id long, repeat int, latency double")
    got = compare_arms(df, "A", "B", "latency", higher_is_better=False).first()
    assert (got.cases, got.difference, got.low, got.high, got.verdict) == (30, 20.0, 20.0, 20.0, "confirmed_worse")
    assert compare_arms(df, "A", "B", "latency").first().verdict == "confirmed_better"
    assert compare_arms(df.where("case_id > 90"), "A", "B", "latency").count() == 0


def test_arms_are_compared_from_one_pass(spark):
    rows, seen = [(arm, c, float(c % 7 + (arm == "B"))) for arm in "AB" for c in range(50)], spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "arm string, case_id long, latency double")
    got = compare_arms(df.mapInArrow(counted, df.schema), "A", "B", "latency").first()
    assert (got.cases, got.difference, seen.value) == (50, 1.0, len(rows))


def test_sums_equal_fsum(spark):
    draw = random.Random(3)
    cases = [[1e-7] * 10, [0.1] * 10, [1e22, 1.0, -1e22], [1e23, 2.5], [1e-12 * draw.random() for _ in range(50)], [draw.choice([1, -1]) * 10 ** draw.uniform(-12, 22) for _ in range(200)], [-0.3, 0.1, 0.2], [-1e-9, 2**53 + 2.0]]
    df = spark.createDataFrame([(i, x) for i, case in enumerate(cases) for x in case], "g long, v double").withColumn("g", F.concat(F.lit("g"), F.col("g").cast("string")))
    got = {r.keys["g"]: r.value for r in calculate_metric(df, "sum:v", "g").rows}
    assert [got[f"g{i}"] for i in range(len(cases))] == pytest.approx([math.fsum(c) for c in cases], rel=1e-15, abs=1e-30)
    assert got["g0"] == pytest.approx(1e-6) and got["g1"] == 1.0


def test_one_name_to_group_by(sales):
    assert [r.keys for r in calculate_metric(sales, "sum:Orders", "Channel").rows] == [{"Channel": "Mobile"}, {"Channel": "Web"}]


def test_causes_and_months(spark):
    said = ["Падение вызвано сбоем, а не вызвано сезоном.", "Спад не вызван сезоном.", "Рост из-за акции.", "Маяк стоит в мае.", "Майский маяк."]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i long, s string").select("i", verify.causal(F.col("s")).alias("c"), verify.months_named(F.col("s")).alias("m")).orderBy("i").collect()
    assert [len(r.c) for r in df] == [1, 0, 1, 0, 0] and [r.m for r in df][3:] == [[5], []]


@pytest.mark.parametrize("request_", ["Падение выручки по каналам", "как менялась выручка", "выручка растёт", "снижение продаж", "revenue decline by channel"])
def test_words_of_change_add_the_time_axis(sales, summary, request_):
    assert finalise(sales, [Draft("sum:Revenue", ("Channel",))], summary, request_).steps[0].group_by == ("Month", "Channel")
    both = finalise(sales, [Draft("sum:Revenue", ("Channel",)), Draft("sum:Orders", ("Region",))], summary, request_)
    assert [s.group_by for s in both.steps] == [("Channel",), ("Region",)]  # the words belong to a step only if it is the only one


@pytest.mark.parametrize("request_", ["выручка по сегментам", "по разрезам", "продажи по срезам", "по группам"])
def test_unnamed_groups_are_left_open(sales, summary, request_):
    assert finalise(sales, [Draft("sum:Revenue", ("Channel",))], summary, request_).open == {0: tuple(summary.dimensions)}
    assert finalise(sales, [Draft("sum:Revenue")], summary, "revenue", ambiguous=True).open == {0: tuple(summary.dimensions)}


def test_another_metric_under_a_documented_name_is_refused(spark, sales, summary):
    texts = [("Return Rate is Returns divided by Orders.", "metrics, page 2"), ("The average order value is Revenue divided by Orders.", "metrics, page 1"), (None, None)]
    definitions = spark.createDataFrame(texts, "text string, source string")
    able = replace(summary, metrics=[*summary.metrics, "ratio:Revenue/Orders"])
    plan = lambda term, metric: finalise(sales, [Draft(metric, ("Channel",), term=term)], able, definitions=definitions)
    wrong = plan("return rate", "ratio:Revenue/Orders")
    assert not wrong.steps and "metrics, page 2" in wrong.refused[0][1] and wrong.unsupported == [f"Step 1: {wrong.refused[0][1]}"]
    fine = [("Average Order Value", "ratio:Revenue/Orders"), ("turnover", "sum:Revenue"), ("sum of Revenue", "sum:Revenue"), ("", "sum:Orders")]
    assert all(len(plan(*x).steps) == 1 for x in fine)


def test_what_is_not_met_is_listed(sales, summary):
    plan = finalise(sales, [Draft(" None "), Draft("sum:Profit", title="Profit")], summary, unsupported=(" EBITDA ", "EBITDA", ""))
    assert not plan.steps and plan.unsupported == ["EBITDA", f"Profit: {plan.refused[0][1]}"] and len(plan.refused) == 1
    assert finalise(sales, [Draft("-")], summary).unsupported != [] and finalise(sales, [], summary).unsupported != []


def test_records_name_values(spark, sales, summary):
    numbered = sales.withColumn("_row", F.monotonically_increasing_id())
    values = records.shown_values(numbered, summary, "_row")
    assert values == {"Channel": ["Web", "Mobile"], "Region": ["North", "South"]}
    found = search_metadata(dataset_records(spark, summary, "s", "sales", values=values), "Mobile Web", 1).first()
    assert found.column_name == "Channel" and "Values: Web, Mobile." in found.text
    assert "North" not in records.column_text("sales", "Region", replace(summary, sensitive=["Region"]), values["Region"])
