"""Facts, chunks, retrieval, text checks and evaluation against small plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import AnalyticsError
from sumbrook.functions.formatting import format_metric
from sumbrook.operators import charts, evalstats, facts, retrieval, text, verify
from sumbrook.plans import questions
from sumbrook.streaming.metrics import windowed_metric


def shown(df):
    return {r.fact: (round(r.value, 6), r.of) for r in df.collect()}


def test_time_facts_take_the_earlier_of_equals(spark):
    df = spark.createDataFrame([("01", 97.5), ("02", 97.8), ("03", 92.0), ("04", 97.9), ("05", None)], "t string, value double")
    got = shown(facts.time_facts(df, percent=True))
    last = df.sparkSession.createDataFrame([(None, 5.0), ("2026-01", 1.0), ("2026-02", 3.0)], "t string, value double")
    nulls = {r.fact: r for r in facts.time_facts(last, total=last.limit(1)).collect()}
    assert (nulls["first"].value, nulls["first"].of, nulls["last"].value, nulls["change"].value, nulls["overall"].value) == (1.0, "2026-01", 5.0, 4.0, 5.0)
    assert sorted(r.fact for r in facts.notable(facts.time_facts(last)).collect()) == ["change", "rise"]
    assert got == {"first": (97.5, "01"), "last": (97.9, "04"), "min": (92.0, "03"), "max": (97.9, "04"), "change": (0.4, "01 → 04"), "drop": (-5.8, "02 → 03"), "rise": (5.9, "03 → 04"), "periods": (4.0, None)}
    two = shown(facts.time_facts(spark.createDataFrame([("a", 5.0), ("b", 5.0)], "t string, value double")))
    assert "drop" not in two and two["min"] == (5.0, "a") and two["change_pct"] == (0.0, "a → b")
    assert facts.time_facts(df.limit(0)).count() == 0


def test_category_facts(spark):
    df = spark.createDataFrame([("API", 100.0), ("Mobile", 300.0), (None, None)], "key string, value double")
    total = spark.createDataFrame([(400.0,)], "value double")
    got = shown(facts.category_facts(df, total))
    assert got == {"cat1_value": (300.0, "Mobile"), "cat1_share": (75.0, "Mobile"), "cat2_value": (100.0, "API"), "cat2_share": (25.0, "API"), "categories": (2.0, None), "overall": (400.0, None)}
    assert not any("share" in f for f in shown(facts.category_facts(df, total, additive=False)))


def test_series_facts(spark):
    rows = [("1", "b", 10.0), ("2", "b", 15.0), ("1", "a", 4.0), ("2", "a", 6.0), ("2", "c", 1.0)]
    got = shown(facts.series_facts(spark.createDataFrame(rows, "t string, series string, value double")))
    assert got["s1_first"] == (4.0, "a") and got["s2_change_pct"] == (50.0, "b") and got["growth_leader"] == (50.0, "b") and got["series_count"] == (3.0, None) and "s3_first" not in got


def test_charts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "g string, value double")
    for bad in (("pie", ["g"], "g", True), ("pie", ["g"], "g", False), ("cloud", ["g"], "g", True), ("bar", [], "g", True), ("bar", ["g"], "x", True)):
        with pytest.raises(AnalyticsError):
            charts.checked_points(df, *bad)
    assert [(r.x, r.x_rank) for r in charts.checked_points(df, "bar", ["g"], "g", True).collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(AnalyticsError):
        charts.checked_points(spark.range(501).select(F.col("id").alias("g"), F.lit(1.0).alias("value")), "bar", ["g"], "g", True)
    assert charts.fit_chart(False, "pie", 7) == "bar" and charts.fit_chart(True, "pie", 2) == "line"
    bins = charts.histogram(spark.createDataFrame([(float(x),) for x in range(11)] + [(None,)], "v double"), "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [2, 2, 2, 2, 3]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_hold_every_sentence(spark, seed):
    draw = random.Random(seed)
    said = [" ".join("".join(draw.choices("abcdef", k=draw.randint(1, 12))) for _ in range(draw.randint(1, 60))) + "." for _ in range(40)]
    chunks = text.chunk_paragraphs([(1, " ".join(said[:20])), (2, " ".join(said[20:]))], 200, 60)
    assert all(len(c) <= 200 + 60 for _, _, c in chunks) and len(chunks) > 3
    for s in said:
        assert any(s in c for _, _, c in chunks) or len(s) > 200
    for (_, _, a), (_, _, b) in zip(chunks, chunks[1:], strict=False):
        shared = max((n for n in range(1, min(len(a), len(b)) + 1) if a[-n:] == b[:n]), default=0)
        assert shared <= 60
    with pytest.raises(AnalyticsError):
        text.chunk_documents(spark.range(1), 10, 10)


def test_sections_and_chunk_ids(spark):
    docs = spark.createDataFrame([("d1", "Intro text.\n# One\nBody one.\n\n12\nMore.\n## Two\nBody two."), ("d2", "")], "document_id string, text string")
    got = [(r.chunk_id, r.section, r.text) for r in text.chunk_texts(docs).orderBy("chunk_id").collect()]
    assert got == [("d1-0000", "", "Intro text."), ("d1-0001", "One", "Body one.\nMore."), ("d1-0002", "Two", "Body two.")]
    rows = [("d1", 1, "One", 2, 3, "More."), ("d1", 0, "", 0, 1, "Intro text."), ("d1", 1, "One", 1, 2, "Body one."), ("d1", 2, "Two", 3, 3, "Body two.")]
    pages = text.chunk_documents(spark.createDataFrame(rows, "document_id string, section_index int, section string, seq int, page int, text string")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section, r.text) for r in pages] == got and [(r.page, r.page_end) for r in pages] == [(1, 1), (2, 3), (3, 3)]


def plain_chunks(paragraphs, most, overlap):
    """Sentence by sentence, with the sentences of the chunk so far in a list."""
    units = []
    for page, said in paragraphs:
        for i, s in enumerate(text._sentences(said, most)):
            units.append((page, s, "\n" if i == 0 else " "))
    chunks, own, fresh = [], [], 0
    for u in units:
        if fresh and sum(len(x[1]) + 1 for x in own) + len(u[1]) + 1 > most:
            chunks.append(own)
            tail = next(t for t in range(len(own) + 1) if sum(len(x[1]) + 1 for x in own[t:]) <= overlap + 1)
            own, fresh = own[tail:], 0
        own, fresh = [*own, u], fresh + 1
    chunks += [own] if fresh else []
    return [(c[0][0], c[-1][0], "".join(x[2] + x[1] for x in c)[1:]) for c in chunks]


@pytest.mark.parametrize("seed", range(5))
def test_chunks_equal_a_plain_version(seed):
    draw = random.Random(seed)
    said = [(p, " ".join(" ".join("x" * draw.randint(1, 9) for _ in range(draw.randint(1, 50))) + draw.choice([".", "!", "…", ""]) for _ in range(draw.randint(1, 9)))) for p in range(12)]
    for most, overlap in ((60, 20), (200, 0), (120, 119)):
        assert text.chunk_paragraphs(said, most, overlap) == plain_chunks(said, most, overlap)


def test_html(spark):
    page = "<html><script>var t='</p>';</script><H1 class=x>A &amp; B</H1><p>One <b>two</b>\n three</p><ul><li>x</li></ul><p></p><div>lost?</div><table><tr><td>cell</td><td>two</td></tr></table><pre>code</pre><!-- <p>no</p> -->tail"
    assert spark.createDataFrame([(page,)], "h string").select(text.html_text(F.col("h")).alias("t")).first().t == "# A & B\nOne two three\nx\nlost?\ncell\ntwo\ncode\ntail"


def test_hash_vectors(spark):
    a, b, c = (text.hash_vector(x) for x in ("количество транзакций", "Количество транзакции", "the of"))
    assert math.fsum(x * x for x in a) == pytest.approx(1) and c == [0.0] * text.DIM
    assert math.fsum(x * y for x, y in zip(a, b, strict=True)) > 0.5
    got = spark.createDataFrame([("количество транзакций",), (None,)], "t string").select(text.embed(F.col("t")).alias("e")).collect()
    assert got[0].e == pytest.approx(a, abs=1e-6) and set(got[1].e) == {0.0}


def test_retrieval(spark):
    index = spark.createDataFrame([("a", "d1", "x", [1.0, 0.0]), ("b", "d1", "", [1.0, 1.0]), ("c", "d2", "y", [0.0, 1.0]), ("z", "d2", "x", [0.0, 0.0])], "chunk_id string, document_id string, dataset_id string, embedding array<float>")
    assert [(r.chunk_id, r.score, r.relevant) for r in retrieval.search(index, [1.0, 0.0], 3).collect()] == [("a", 1.0, True), ("b", 0.7071, True), ("c", 0.0, False)]
    assert [r.chunk_id for r in retrieval.search(index, [1.0, 0.0], 9, retrieval.document_scope(dataset_id="x")).collect()] == ["a", "b", "z"]
    assert [r.chunk_id for r in retrieval.search(index, [1.0, 0.0], 9, retrieval.document_scope("d2", "x", False)).collect()] == ["z"]
    with pytest.raises(AnalyticsError):
        retrieval.search(index, [1.0], 0)
    found = spark.createDataFrame([("n", ["число операций"], 0.1), ("m", None, 0.05)], "column_name string, aliases array<string>, score double")
    assert [(r.column_name, r.status) for r in retrieval.resolve(found, "Число  операций").collect()] == [("n", "confident")]
    assert {r.status for r in retrieval.resolve(found, "другое").collect()} == {"not_found"}
    chunks = spark.createDataFrame([("c1", "The  Quick fox")], "chunk_id string, text string")
    evidence = spark.createDataFrame([("e1", "c1", "quick FOX"), ("e2", "c1", "slow"), ("e3", "c9", "quick"), ("e4", "c1", " ")], "evidence_id string, chunk_id string, quote string")
    assert {r.evidence_id: r.verified for r in retrieval.quotes_found(evidence, chunks).collect()} == {"e1": True, "e2": False, "e3": False, "e4": False}
    docs = spark.createDataFrame([("d1", 2), ("d2", 3), ("d3", 1)], "document_id string, chunk_count long")
    assert {r.document_id for r in retrieval.new_documents(docs, index).collect()} == {"d2", "d3"}


def test_checks_of_text(spark):
    insights = [("ok", "Выручка: 1 234,5 тыс в 2026-03.", ["f1"]), ("number", "Итог 99 млн.", ["f1"]), ("none", "Ничего.", []), ("gone", "Ничего.", ["f9"]), ("cause", "Падение вызвано сбоем.", ["f1"]), ("trend", "Рост виден.", ["f2"]), ("month", "В феврале тихо.", ["f1"])]
    rows = spark.createDataFrame(insights, "insight_id string, text string, evidence array<string>")
    known = spark.createDataFrame([("f1", 1234512.0, "value"), ("f2", -5.0, "difference")], "fact string, value double, kind string")
    got = {(r.insight_id, r.rule) for r in verify.check_insights(rows, known, [3], ["2026-03"]).collect()}
    assert got == {("number", "numbers-grounded"), ("none", "evidence-required"), ("gone", "unknown-evidence"), ("cause", "no-causal-claim"), ("cause", "trend-needs-comparison"), ("trend", "trend-direction-mismatch"), ("month", "period-not-in-data")}


def test_questions(spark):
    said = {"Почему упала успешность?": ("cause_question", "success_rate"), "В каком регионе?": ("unsupported", None), "Как изменился оборот за март": ("unsupported", "transaction_volume"), "Какой канал лидирует?": ("top_category", None)}
    got = {r.q: (r.i, r.m) for r in spark.createDataFrame([(x,) for x in said], "q string").select("q", questions.intent(F.col("q")).alias("i"), questions.metric_of(F.col("q")).alias("m")).collect()}
    assert got == said


def test_evaluation(spark):
    def p(a, b):
        n = a + b
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0

    pairs = [(a, b) for a in range(8) for b in range(0, 30, 7)]
    got = spark.createDataFrame(pairs, "a long, b long").select(evalstats.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([p(a, b) for a, b in pairs])
    diffs = spark.createDataFrame([(i, 1.0 + (i % 5) * 0.1) for i in range(50)], "case_id long, diff double")
    r = evalstats.bootstrap(diffs, 2000).first()
    assert r.low < r.mean < r.high and r.mean == pytest.approx(1.2) and r.n == 50 and abs(r.high - r.low - 2 * 1.96 * 0.1414 / math.sqrt(50)) < 0.02
    assert evalstats.bootstrap(diffs.limit(0)).count() == 0
    a = spark.createDataFrame([("x", 1.0), (None, None)], "key string, value double")
    assert tuple(evalstats.numeric_score(a, a).first()) == (True, True, 0.0)
    assert evalstats.numeric_score(a, a.limit(1)).first().same_groups is False
    assert [r.v for r in spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.5, 2.0), (-1.0, -2.0, -0.5), (1.0, -1.0, 2.0)], "m double, l double, h double").select(evalstats.verdict(F.col("m"), F.col("l"), F.col("h")).alias("v")).collect()] == ["no_difference", "confirmed_better", "confirmed_worse", "not_confirmed"]


def test_formats(spark):
    values = [(None,), (1234567.891,), (2.5e9,), (12.0,)]
    df = spark.createDataFrame(values, "v double")
    assert [r.v for r in df.select(format_metric(F.col("v"), "KZT").alias("v")).collect()] == ["—", "1,23 m KZT", "2,50 bn KZT", "12 KZT"]
    assert [r.v for r in df.select(format_metric(F.col("v"), "%").alias("v")).collect()][3] == "12,00%"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_metric(stream, "sum:value", "ts", group_by=["event_type"]).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_metric(events, "sum:value", "ts", group_by=["event_type"])
    assert sorted(map(tuple, spark.table("windowed").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
