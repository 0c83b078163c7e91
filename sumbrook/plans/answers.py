"""Answers to a table of questions: what they need is found for all of them at once and joined back.

Each question is routed by its intent to a shape (over time, by category, a definition, events). The distinct results that the
questions need, each a metric in a shape, come from one scan of the data; their facts are made once and joined with the questions that cite them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalyticsError
from ..functions.formatting import format_metric
from ..kinds import Kind
from ..operators.context import event_sentences
from ..operators.facts import category_facts, notable, time_facts
from ..session import cut
from . import questions as asked
from .metrics import metric as definition
from .query import MAX_GROUPS, MetricQuery
from .shared import run_together
from .steps import Step
from .summary import Summary

EVENTS = 3
#: The shape that an intent needs, and the facts that its answer cites: names, or the beginning of names.
SHAPES = {"metric_change": "time", "extreme_period": "time", "notable_changes": "time", "cause_question": "time", "top_category": "category", "metric_definition": "definition", "context_events": "events"}
CITED = {"extreme_period": ("max", "min"), "metric_change": ("first", "last", "change", "change_pct", "drop", "rise"), "cause_question": ("first", "last", "change", "change_pct", "drop", "rise"), "top_category": ("cat",)}
CAUSE_UNKNOWN = "The data show the change alone, not its cause."
NOT_A_PROOF = "That an event falls into the same time does not prove that it is the cause."
SUPPORTED = "Questions can be about change over time, the highest and lowest period, notable changes, the leading category, a metric's definition and documented events."


@dataclass(frozen=True)
class Source:
    """What questions are answered from: a table, its summary, the steps already shown, and passages (text, source) of documents."""

    df: DataFrame
    summary: Summary
    shown: tuple[Step, ...] = ()
    passages: DataFrame | None = None

    def axis(self, shape: str) -> str | None:
        """The axis of a shape: that of a step shown, else the first that there is."""
        kind = Kind.DATETIME if shape == "time" else Kind.CATEGORICAL
        return next((s.group_by[0] for s in self.shown if s.group_by and self.summary.columns[s.group_by[0]] is kind), next((d for d in self.summary.dimensions if self.summary.columns[d] is kind), None))

    def metrics(self, shape: str) -> list[str]:
        """What a question that names no metric is about: the metrics shown in its shape; for categories the first one."""
        shapes = ("time", "category") if shape == "definition" else (shape,)
        found = list(dict.fromkeys(s.metric for s in self.shown for x in shapes if s.group_by and s.group_by[0] == self.axis(x)))
        return found[:1] if shape == "category" else found


def _routes(source: Source) -> list[tuple]:
    """intent, named, shape, metrics and clarification of every intent and metric that a question may name: the rules, written out."""
    labels, out = ", ".join(definition(m).label for m in source.summary.metrics), []
    missing = {s: f"The data have no {what}." for s, what in (("time", "date"), ("category", "category")) if source.axis(s) is None}
    for intent in [*SHAPES, "unsupported"]:
        shape = SHAPES.get(intent)
        for named in [*source.summary.metrics, None]:
            numbers = shape in ("time", "category", "definition")
            metrics = ([named] if named else source.metrics(shape)) if numbers else []
            out.append((intent, named, shape, metrics, missing.get(shape) or (f"Which metric: {labels}?" if numbers and not metrics else None)))
    return out


def route(questions: DataFrame, source: Source) -> DataFrame:
    """question_id, intent, shape, metrics (named or shown), clarification of each question (question_id, question)."""
    # few bytes but much work: one file's questions would share a task
    text = questions.select("question_id", "question").repartition("question_id", "question").select("question_id", asked.normal(F.coalesce("question", F.lit(""))).alias("text"))
    # each step names what the next one uses more than once, so that no pattern is tried twice
    read = text.select("question_id", "text", asked.matched(F.col("text")).alias("found"), asked.metric_of(F.col("text"), source.summary.metrics, True).alias("named"))
    read = read.select("question_id", asked.settled(F.col("found"), F.col("text")).alias("intent"), "named")
    routes = source.df.sparkSession.createDataFrame(_routes(source), "_intent string, _named string, shape string, metrics array<string>, clarification string")
    return read.join(F.broadcast(routes), F.col("intent").eqNullSafe(F.col("_intent")) & F.col("named").eqNullSafe(F.col("_named"))).select("question_id", "intent", "shape", "metrics", "clarification")


def _facts(source: Source, needed: list[tuple[str, str]]) -> DataFrame:
    """shape, metric, fact, value, of, notable of every needed (shape, metric): one scan for all."""
    spark = source.df.sparkSession
    queries = [MetricQuery.build(source.df, m, [source.axis(s)], None, frozenset(source.summary.sensitive)) for s, m in needed]
    parts = []
    for (shape, name), found in zip(needed, run_together(queries, MAX_GROUPS), strict=True):
        if isinstance(found, AnalyticsError):
            continue
        axis, percent = source.axis(shape), found.metric.unit == "%"
        rows = [(None if g.keys[axis] is None else str(g.keys[axis]), None if g.value is None else float(g.value)) for g in found.rows]
        groups = spark.createDataFrame(rows, "t string, value double")  # MAX_GROUPS at most
        total = spark.createDataFrame([(None if found.overall.value is None else float(found.overall.value),)], "value double")
        if shape == "time":
            facts = time_facts(groups, percent, total)
            marked = facts.join(F.broadcast(notable(facts, percent).select("fact", F.lit(True).alias("notable"))), "fact", "left")
        else:
            marked = category_facts(groups.withColumnRenamed("t", "key"), total, found.metric.additive).withColumn("notable", F.lit(None).cast("boolean"))
        parts.append(marked.select(F.lit(shape).alias("shape"), F.lit(name).alias("metric"), "fact", "value", "of", F.coalesce("notable", F.lit(False)).alias("notable")))
    empty = spark.createDataFrame([], "shape string, metric string, fact string, value double, of string, notable boolean")
    return reduce(DataFrame.unionByName, parts, empty)


def evidence(questions: DataFrame, source: Source) -> DataFrame:
    """question_id, intent, metric, fact, value, of: the facts that the answer to each question cites; see `answers` for the rest.

    For notable changes these are the steps that matter or, if none does, the least and largest value. Questions that are unsupported, need no
    numbers or a clarification have no rows; a repeated question has its rows again. The driver holds the distinct needed results.
    """
    return _cited(cut(route(questions, source)), source)


def _cited(routed: DataFrame, source: Source) -> DataFrame:
    """The evidence of questions as `route` gives them. These are best a table: else what reads them tries the patterns again for each condition on an intent."""
    wanted = routed.where("clarification is null and shape in ('time', 'category')").select("question_id", "intent", "shape", F.explode("metrics").alias("metric"))
    needed = [(r.shape, r.metric) for r in wanted.select("shape", "metric").distinct().orderBy("shape", "metric").collect()]  # two a metric at most
    facts = _facts(source, needed)
    quiet = facts.groupBy("shape", "metric").agg((~F.bool_or("notable")).alias("quiet"))
    of_result = F.broadcast(facts.join(quiet, ["shape", "metric"]))  # a result has few facts
    cites = F.lit(False)
    for intent, names in CITED.items():
        fits = F.lit(False)
        for n in names:
            fits |= F.col("fact").startswith(n) & (F.col("fact") != "categories") if n == "cat" else F.col("fact") == n
        cites |= (F.col("intent") == intent) & fits
    cites |= (F.col("intent") == "notable_changes") & (F.col("notable") | F.col("quiet") & F.col("fact").isin("min", "max"))
    return wanted.join(of_result, ["shape", "metric"]).where(cites).select("question_id", "intent", "metric", "fact", "value", "of")


#: The sentence of a fact.
SAID = {"first": "began at {} ({})", "last": "ended at {} ({})", "max": "was highest at {} ({})", "min": "was lowest at {} ({})", "change": "changed by {} in all ({})", "change_pct": "which is {} ({})", "drop": "fell most by {} ({})", "rise": "rose most by {} ({})"}


def _sentence(fact: Column, value: Column, metric: Column, of: Column, names: list[str]) -> Column:
    unit = F.coalesce(*(F.when(metric == m, definition(m).unit) for m in names), F.lit(""))
    shown = F.when((fact == "change_pct") | fact.endswith("_share"), format_metric(value, "%"))
    for u in sorted({definition(m).unit for m in names}):
        points = fact.isin("change", "drop", "rise")
        shown = F.coalesce(shown, F.when((unit == u) & points & F.lit(u == "%"), F.concat(format_metric(value, u), F.lit(" points"))), F.when(unit == u, format_metric(value, u)))
    said = [F.when(fact == f, F.format_string(s.replace("{}", "%s"), shown, F.coalesce(of, F.lit("no period")))) for f, s in SAID.items()]
    return F.coalesce(*said, F.when(fact.endswith("_value"), F.format_string("%s has %s", F.coalesce(of, F.lit("none")), shown)), F.format_string("%s of the total", shown))


def definitions(passages: DataFrame | None, metrics: list[str]) -> dict[str, tuple[str, str]]:
    """For each metric the text and source of the first passage, by source, that names its label or all its columns. One aggregate."""
    if passages is None or not metrics:
        return {}
    text, parts = F.lower("text"), []
    for i, m in enumerate(metrics):
        columns = reduce(lambda a, b: a & b, (text.contains(c.casefold()) for c in definition(m).columns))
        parts.append(F.min(F.when(text.contains(definition(m).label.casefold()) | columns, F.struct("source", "text"))).alias(f"p{i}"))
    r = passages.agg(*parts).first()
    return {m: (r[f"p{i}"].text, r[f"p{i}"].source) for i, m in enumerate(metrics) if r[f"p{i}"]}


def answers(questions: DataFrame, source: Source) -> DataFrame:
    """question_id, intent, metrics, answer, cited (metric.fact), limits of each question (question_id, question), whose ids must be unique.

    A question that can't be answered is told why. Numbers and periods in an answer are those of the cited facts alone; a cause is never named. A null
    question is unsupported. No questions give no rows.
    """
    routed, names = cut(route(questions, source)), source.summary.metrics
    facts = _cited(routed, source)
    rank = F.coalesce(*(F.when(F.col("fact") == f, i) for i, f in enumerate(SAID)), F.regexp_extract("fact", r"(\d+)", 1).try_cast("int") * 2 + F.col("fact").endswith("_share").cast("int"))
    said = facts.withColumns({"said": _sentence(F.col("fact"), F.col("value"), F.col("metric"), F.col("of"), names), "rank": rank, "label": F.coalesce(*(F.when(F.col("metric") == m, definition(m).label) for m in names), F.col("metric"))})
    by_metric = said.groupBy("question_id", "metric", "label").agg(F.array_sort(F.collect_list(F.struct("rank", "said", "fact"))).alias("parts"))
    told = by_metric.select("question_id", "metric", F.concat("label", F.lit(" "), F.array_join(F.transform("parts", lambda p: p.said), "; "), F.lit(".")).alias("sentence"), F.transform("parts", lambda p: F.concat("metric", F.lit("."), p.fact)).alias("cited"))
    whole = told.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("metric", "sentence", "cited"))).alias("told"))
    defined = definitions(source.passages, names)
    formula = F.coalesce(*(F.when(F.col("m") == m, f"{definition(m).label}: " + (f"«{defined[m][0]}» ({defined[m][1]}). " if m in defined else "no document defines it. ") + f"It is calculated as {definition(m).formula}.") for m in names), F.lit(""))
    joined = routed.join(whole, "question_id", "left")
    by_definition = joined.select("question_id", F.explode("metrics").alias("m")).groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(formula)), " ").alias("definition"))
    joined = joined.join(by_definition, "question_id", "left")
    events = []
    if source.passages is not None:
        picked = source.passages.select("source", F.explode(event_sentences(F.col("text"))).alias("sentence")).orderBy("source", "sentence").limit(EVENTS)
        events = [f"{r.source} says: «{r.sentence}»." for r in picked.collect()]
    numbers = F.array_join(F.transform("told", lambda t: t.sentence), " ")
    happened = " ".join(events)
    text = F.coalesce(
        F.col("clarification"), F.when(F.col("intent") == "unsupported", SUPPORTED), F.when(F.col("intent") == "metric_definition", F.col("definition")),
        F.when(F.col("intent") == "context_events", f"{happened} {NOT_A_PROOF}" if events else "The documents name no events."),
        F.when(F.col("intent") == "cause_question", F.concat(F.lit(CAUSE_UNKNOWN + " "), numbers, F.lit(f" {events[0]} {NOT_A_PROOF}" if events else ""))), numbers, F.lit("There are no values to answer from."),
    )
    cited = F.coalesce(F.flatten(F.transform("told", lambda t: t.cited)), F.array().cast("array<string>"))
    changed = F.exists(cited, lambda c: c.rlike(r"\.(change|drop|rise)$"))
    undefined = F.exists("metrics", lambda m: ~m.isin(list(defined) or [""]))
    limits = [F.when((F.col("intent") == "cause_question") | F.col("intent").isin("metric_change", "notable_changes") & changed, CAUSE_UNKNOWN), F.when((F.col("intent") == "metric_definition") & undefined, "A formula of the system stands in for a missing definition.")]
    return joined.select("question_id", "intent", "metrics", text.alias("answer"), cited.alias("cited"), F.array_compact(F.array(*limits)).alias("limits"))
