"""The catalogue's plan and its approval, corrections of a summary, assembled and settled texts, decisions between arms."""

import math
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import SumbrookError, WorkflowError
from sumbrook.kinds import Kind
from sumbrook.operators import evalstats, retrieval, verify
from sumbrook.plans import planning
from sumbrook.plans.query import calculate_metric
from sumbrook.plans.report import basic_kpis, check_result
from sumbrook.plans.steps import candidates, run_plan
from sumbrook.plans.summary import default_description, summarise

ROWS = [(f"2026-0{m}-01 00:00:00", c, r, 10 * m, 100.0 * m) for m in range(1, 5) for c in ("Web", "Mobile") for r in ("North", "South")]


@pytest.fixture(scope="module")
def sales(spark):
    df = spark.createDataFrame(ROWS, "Month string, Channel string, Region string, Orders long, Revenue double").withColumn("Month", F.col("Month").cast("timestamp_ntz"))
    return df.withMetadata("Channel", {"kind": "categorical"}).withMetadata("Region", {"kind": "categorical"})


@pytest.fixture(scope="module")
def summary(sales):
    return summarise(sales)


def test_a_catalogue_plan_is_finalised_chosen_and_approved(sales, summary):
    found = candidates(summary)
    plan = planning.finalise_catalogue(found, [planning.Proposal("measure_dynamics", "Shop", "pie", " Growth "), planning.Proposal("measure_dynamics")], summary)
    assert list(plan.steps) == ["measure_dynamics", "measure_comparison"] and plan.open == {"measure_comparison": ("Channel", "Region")} and plan.gaps == ["sum:Revenue"]
    assert (plan.steps["measure_dynamics"].group_by, plan.steps["measure_dynamics"].chart, plan.steps["measure_dynamics"].title) == (("Month",), "line", "Growth") and len(plan.notes) == 2
    with pytest.raises(WorkflowError):
        planning.choose(plan, {"measure_comparison": "Month"}, summary)
    with pytest.raises(WorkflowError):
        planning.approve(plan, [], summary)
    with pytest.raises(WorkflowError):
        planning.approve(plan, ["measure_dynamics"], summary)
    assert planning.approve(plan, list(plan.steps), summary).open == {"measure_comparison": ("Channel", "Region")}
    done = planning.approve(plan, list(plan.steps), summary, {"measure_comparison": "Region"}, frozenset({"sum:Revenue"}))
    assert not done.open and done.steps["measure_comparison"].group_by == ("Region",) and plan.steps["measure_comparison"].group_by == ()
    assert {r.keys["Region"]: r.value for r in run_plan(sales, [done.steps["measure_comparison"]], summary).results[0][1].rows} == {"North": 2000.0, "South": 2000.0}


def test_what_is_not_available_is_excluded_and_behaviour_follows(spark):
    numbers = summarise(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "Revenue double, Cost double"))
    plan = planning.finalise_catalogue(candidates(numbers), [], numbers, ["measure_dynamics", "unknown"])
    assert not plan.steps and "no date column" in plan.excluded["measure_dynamics"] and planning.behaviour(plan) == "reject"
    assert planning.behaviour(planning.CataloguePlan(steps={"a": None}, open={"a": ("x", "y")})) == "clarify" and planning.behaviour(planning.CataloguePlan(steps={"a": None})) == "answer"
    assert planning.selection(["unknown"], candidates(numbers)) == []


def test_a_summary_takes_corrections(spark, summary):
    people = spark.createDataFrame([("Ann", "1"), ("Bob", "2")], "customer_email string, amount string")
    seen = summarise(people, kind_of={"amount": Kind.NUMERIC}, personal={"customer_email": False, "amount": True})
    assert seen.columns["amount"] is Kind.NUMERIC and seen.reasons == {"amount": "given"} and seen.measures == []
    assert summarise(people).reasons == {"customer_email": "name"}
    with pytest.raises(SumbrookError):
        summarise(people, personal={"nobody": True})
    assert default_description(summary) == "A table of 16 rows and 5 columns. Measures: Orders, Revenue. Dates: Month. Categories: Channel, Region."


def test_the_shape_of_a_result(sales, summary):
    result = [calculate_metric(sales, "sum:Revenue", ["Channel"])]
    fine = check_result(summary, 5, basic_kpis(summary), result, [{"evidence": ["a.b"], "source": "sales"}], 0)
    assert len(fine) == 7 and all(fine.values())
    assert [k for k, v in check_result(summary, 6, [], result * 5, [{"evidence": [], "source": "s"}], 1).items() if not v] == ["summary_covers_all_columns", "has_kpis", "at_most_four_charts", "every_insight_has_evidence", "insights_passed_verification"]


def test_drafts_are_assembled(spark):
    drafts = spark.createDataFrame([(1, " T ", " x ", ["b", "a", "b"], "c1", "Two  WORDS"), (2, "t", "x", ["a", "z"], None, None), (3, "t", "x", [], "c9", "Two"), (4, "t", "x", None, "c1", None)], "insight_id long, title string, text string, evidence array<string>, chunk_id string, quote string")
    got = {r.insight_id: r for r in verify.assemble(drafts, spark.createDataFrame([("a",), ("b",)], "fact string"), spark.createDataFrame([("c1", "Here are two words.")], "chunk_id string, text string")).collect()}
    assert (got[1].title, got[1].text, got[1].evidence, got[1].context, got[1].issues) == ("T", "x", ["b", "a"], "c1", [])
    assert [got[i].issues for i in (2, 3, 4)] == [["unknown-evidence"], ["evidence-required", "context-not-in-source"], ["evidence-required", "context-not-in-source"]]


def test_quotes_and_ids_are_no_claims(spark):
    answers = spark.createDataFrame([(1, "It fell. Sales fell because of rain. It rose."), (2, "No quote."), (3, None)], "answer_id long, text string")
    fragments = spark.createDataFrame([(1, "It rained. Sales fell because of rain."), (1, "rain."), (9, "No quote.")], "answer_id long, text string")
    got = {r.answer_id: r.text for r in verify.without_quotes(answers, fragments).collect()}
    assert got[1].split() == ["It", "fell.", "It", "rose."] and got[2] == "No quote." and got[3] is None
    assert spark.range(1).select(verify.for_readers(F.lit("Up (success_rate.max, a.b_1) now (really)."))).first()[0] == "Up now (really)."


def test_a_candidate_is_confirmed(spark):
    resolved = spark.createDataFrame([("a", 0.5, "ambiguous"), ("b", 0.5, "ambiguous")], "column_name string, score double, status string")
    assert retrieval.confirm(resolved, "b").first().status == "confirmed"
    with pytest.raises(SumbrookError):
        retrieval.confirm(resolved, "c")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("accuracy", 0.8, 0.9, "confirmed_better"), ("latency", 5.0, 9.0, "confirmed_worse")], ("B", 1, ["latency-confirmed-higher"])),
        ([("accuracy", 0.8, 0.9, "not_confirmed"), ("agreement", 0.9, 0.7, "not_confirmed"), ("tokens", 9.0, 5.0, "confirmed_better")], ("A", 2, ["agreement-not-confirmed", "tokens-confirmed-higher"])),
        ([("agreement", 0.9, 0.9, "no_difference"), ("latency", 5.0, 4.0, "not_confirmed")], ("B", 3, [])),
        ([("accuracy", 0.9, 0.9, "no_difference")], ("A", 3, [])),
    ],
)
def test_the_rule_decides_between_arms(spark, rows, want):
    r = evalstats.decide(spark.createDataFrame(rows, "measure string, mean_a double, mean_b double, verdict string"), "A", "B").first()
    assert (r.arm, r.rule, r.caveats) == want


def test_conclusions_claim_no_more_than_the_interval(spark):
    df = spark.createDataFrame([(30, 0.97, 0.98, 0.01, -0.02, 0.04, "not_confirmed"), (30, 0.5, 0.8, 0.3, 0.1, 0.5, "confirmed_better")], "cases long, mean_a double, mean_b double, difference double, low double, high double, verdict string")
    no, yes = evalstats.conclude(df, "Context").orderBy("claim").collect()
    assert not no.claim and len(no.statements) == 4 and "At most 3.0 points" in no.statements[2]
    assert yes.claim and yes.statements == ["Context is confirmed to be better.", "The difference is +30.0 points, interval +10.0 to +50.0, over 30 cases."]


def _plain(metric, group, keep):
    """The metric by hand: plain loops over the fixture's rows and math.fsum."""
    names = ("Month", "Channel", "Region", "Orders", "Revenue")
    rows = [r for r in (dict(zip(names, row, strict=True)) for row in ROWS) if keep(r)]
    kind, _, columns = metric.partition(":")
    total = lambda rs, c: math.fsum(r[c] for r in rs)
    value = lambda rs: total(rs, columns) if kind == "sum" else total(rs, columns.split("/")[0]) / total(rs, columns.split("/")[1])
    return {k: value(list(rs)) for k, rs in ((k, list(g)) for k, g in groupby(sorted(rows, key=lambda r: r[group]), key=lambda r: r[group]))}


@pytest.mark.parametrize("metric", ["sum:Revenue", "sum:Orders", "ratio:Revenue/Orders"])
@pytest.mark.parametrize(("op", "value"), [("eq", "North"), ("in", ["North", "South"]), ("ne", "South")])
def test_metrics_equal_a_plain_calculator(sales, metric, op, value):
    keep = {"eq": lambda r: r["Region"] == value, "in": lambda r: r["Region"] in value, "ne": lambda r: r["Region"] != value}[op]
    got = calculate_metric(sales, metric, ["Channel"], [{"column": "Region", "op": op, "value": value}])
    assert {r.keys["Channel"]: r.value for r in got.rows} == pytest.approx(_plain(metric, "Channel", keep))
