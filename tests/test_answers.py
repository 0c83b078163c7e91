"""Questions in, answers out: each needed result once, numbers equal to the metric's own."""

import pytest
from pyspark.sql import functions as F

from sumbrook.plans import answers, questions
from sumbrook.plans.query import calculate_metric
from sumbrook.plans.steps import Step
from sumbrook.plans.summary import summarise

ROWS = [(f"2026-0{m}-01 00:00:00", c, 100 + 10 * m + (50 if c == "Mobile" else 0), 90 + 10 * m - (60 if m == 3 else 0) + (40 if c == "Mobile" else 0), 1e6 * m) for m in range(1, 7) for c in ("Web", "Mobile", "API")]
ASKED = [
    (1, "Как изменилась успешность?"), (2, "Какой месяц имеет максимальное значение?"), (3, "Какой канал имеет наибольшее количество транзакций?"), (4, "Какие изменения заслуживают внимания?"), (5, "Почему упала успешность?"),
    (6, "Что означает Success Rate?"), (7, "Какие события упоминаются в документации?"), (8, "Сделай прогноз на июль"), (9, "Как изменился объём в марте?"), (10, None), (11, "Какой канал имеет наибольший объём транзакций?"), (12, "Как изменилась успешность?"),
]


@pytest.fixture(scope="module")
def source(spark):
    df = spark.createDataFrame(ROWS, "Month string, Channel string, Transactions long, Successful long, Amount_KZT double").withColumn("Month", F.col("Month").cast("timestamp_ntz"))
    shown = (Step("transaction_count", ("Month",)), Step("success_rate", ("Month",)), Step("transaction_count", ("Channel",)))
    passages = spark.createDataFrame([("Success Rate is Successful over Transactions.", "guide, page 1"), ("В марте 2026 года проводилось обновление. Прочее.", "notes, page 2")], "text string, source string")
    return answers.Source(df, summarise(df), shown, passages)


@pytest.fixture(scope="module")
def told(spark, source):
    return {r.question_id: r for r in answers.answers(spark.createDataFrame(ASKED, "question_id long, question string"), source).collect()}


def test_every_question_has_one_answer(told):
    assert sorted(told) == list(range(1, 13))
    want = {1: "metric_change", 2: "extreme_period", 3: "top_category", 4: "notable_changes", 5: "cause_question", 6: "metric_definition", 7: "context_events", 8: "unsupported", 9: "unsupported", 10: "unsupported", 11: "top_category"}
    assert {i: told[i].intent for i in want} == want and told[1].answer == told[12].answer


def test_numbers_are_those_of_the_metric(told, source):
    rates = {g.keys["Month"]: g.value for g in calculate_metric(source.df, "success_rate", "Month").rows}
    high, low = max(rates, key=rates.get), min(rates, key=rates.get)
    said = lambda v: f"{v:.2f}%".replace(".", ",")
    assert f"was highest at {said(rates[high])} ({high}); was lowest at {said(rates[low])} ({low})" in told[2].answer and low == "2026-03"
    assert told[2].metrics == ["transaction_count", "success_rate"] and "transaction_count.max" in told[2].cited
    assert told[1].cited == ["success_rate.first", "success_rate.last", "success_rate.change", "success_rate.drop", "success_rate.rise"] and "points" in told[1].answer
    assert told[3].answer.startswith("Transactions Mobile has 1 110") and told[3].metrics == ["transaction_count"]
    assert told[11].metrics == ["transaction_volume"] and "21,00 m KZT" in told[11].answer


def test_causes_are_never_named_and_limits_told(told):
    assert told[5].answer.startswith(answers.CAUSE_UNKNOWN) and "обновление" in told[5].answer and answers.NOT_A_PROOF in told[5].answer
    assert answers.CAUSE_UNKNOWN in told[4].limits and told[8].answer == answers.SUPPORTED and told[8].cited == [] and answers.NOT_A_PROOF in told[7].answer
    assert "guide, page 1" in told[6].answer and "SUM(Successful) / SUM(Transactions)" in told[6].answer and told[6].limits == []


def test_what_is_missing_is_asked_for(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Revenue double, Cost double")
    bare = answers.Source(df, summarise(df))
    said = ["Как изменилась выручка?", "Какой канал лидирует?", "Что такое revenue?", "Что означает показатель?", "Какие события?"]
    told = [r for r in answers.answers(spark.createDataFrame(list(enumerate(said)), "question_id long, question string"), bare).orderBy("question_id").collect()]
    assert [told[i].answer for i in (0, 1, 3, 4)] == ["The data have no date.", "The data have no category.", "Which metric: Revenue, Cost?", "The documents name no events."]
    assert told[2].metrics == ["sum:Revenue"] and "no document defines it" in told[2].answer and told[2].limits
    assert answers.answers(spark.createDataFrame([], "question_id long, question string"), bare).count() == 0


def test_a_needed_result_is_made_once(spark, source, monkeypatch):
    seen = []
    real = answers.run_together
    monkeypatch.setattr(answers, "run_together", lambda queries, most: seen.append([(q.metric.name, *q.group_by) for q in queries]) or real(queries, most))
    many = spark.createDataFrame([(i, ASKED[i % 5][1]) for i in range(200)], "question_id long, question string")
    assert answers.evidence(many, source).select("question_id").distinct().count() == 200
    assert seen == [[("transaction_count", "Channel"), ("success_rate", "Month"), ("transaction_count", "Month")]]


def test_a_metric_is_recognised_only_if_available(spark):
    said = {"Как изменилась успешность?": "success_rate", "Какая средняя сумма?": None, "Какая выручка?": "sum:Revenue_KZT", "сколько orders было": "sum:Orders", "что с net revenue kzt": "sum:Revenue_KZT", "затраты?": None}
    available = ["success_rate", "sum:Revenue_KZT", "sum:Orders"]
    got = spark.createDataFrame([(q,) for q in said], "q string").select("q", questions.metric_of(F.col("q"), available).alias("m"))
    assert {r.q: r.m for r in got.collect()} == said
    assert spark.createDataFrame([("x",)], "q string").select(questions.metric_of(F.col("q"), []).alias("m")).first().m is None


def test_questions_are_read_once(spark, source):
    asked, seen = spark.createDataFrame([(i, ASKED[i % len(ASKED)][1]) for i in range(60)], "question_id long, question string"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = answers.evidence(asked.mapInArrow(counted, asked.schema), source).collect()
    assert seen.value == 60 and {r.question_id % len(ASKED) for r in got if r.intent == "extreme_period"} == {1}
