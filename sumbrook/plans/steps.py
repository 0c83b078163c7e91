"""Analyses that a dataset allows, and the steps of a plan as metric queries.

The interactive part of planning (approval, choices, retries) is no Spark work and is left out; see the README.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SumbrookError
from ..kinds import Kind
from ..operators.charts import fit_chart
from ..operators.facts import category_facts, series_facts, time_facts
from .metrics import NAMED, metric
from .query import MAX_GROUPS, MetricQuery, MetricResult
from .shared import run_together
from .summary import Summary

MAX_STEPS = 4
CATEGORIES = (2, 12)
# fixed values: the named analyses as metric, axis and chart, and the words of a main measure
ANALYSES = {"count_dynamics": ("transaction_count", "time", "line"), "volume_dynamics": ("transaction_volume", "time", "line"), "success_dynamics": ("success_rate", "time", "line"), "channel_distribution": ("transaction_count", "category", "pie")}
GENERIC = {"measure_dynamics": ("time", "line"), "measure_comparison": ("category", "bar")}
MEASURE_WORDS = ("revenue", "sales", "amount", "income", "turnover", "total", "выруч", "продаж", "сумм", "доход", "оборот")


@dataclass(frozen=True)
class Candidate:
    id: str
    metric: str
    role: str
    chart: str
    axes: tuple[str, ...]
    reasons: tuple[str, ...] = ()

    @property
    def available(self) -> bool:
        return not self.reasons


@dataclass(frozen=True)
class Step:
    metric: str
    group_by: tuple[str, ...] = ()
    filters: Any = None
    chart: str = "bar"
    title: str = ""


@dataclass
class Outcome:
    results: list[tuple[Step, MetricResult]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def main_measure(measures: list[str]) -> str:
    return next((m for m in measures if any(w in m.casefold() for w in MEASURE_WORDS)), measures[0])


def candidates(summary: Summary) -> list[Candidate]:
    """The analyses of payments; of other data with numbers the two generic ones. Each says why it isn't available."""
    times = tuple(c for c in summary.dimensions if summary.columns[c] is Kind.DATETIME)
    low, high = CATEGORIES
    groups = tuple(c for c in summary.dimensions if summary.columns[c] is Kind.CATEGORICAL and low <= summary.statistics[c]["distinct"] <= high)
    sums = [m for m in summary.metrics if m.startswith("sum:")]
    generic = bool(sums) and not any(m in NAMED for m in summary.metrics)
    wanted = [(i, main_measure(sums), role, chart) for i, (role, chart) in GENERIC.items()] if generic else [(i, *a) for i, a in ANALYSES.items()]
    out = []
    for name, m, role, chart in wanted:
        axes = times if role == "time" else groups
        why = ([] if m in summary.metrics else [f"metric {m} needs the columns {', '.join(metric(m).columns)}"]) + ([] if axes else ["no date column" if role == "time" else f"no category of {low} to {high} values"])
        out.append(Candidate(name, m, role, chart, axes, tuple(why)))
    return out


def rules_plan(found: list[Candidate], selected: list[str] | None = None, choices: dict[str, str] | None = None) -> tuple[list[Step], dict[str, tuple[str, ...]]]:
    """Steps of the available, selected analyses; and for those with several possible axes and no choice, the axes."""
    steps, open_ = [], {}
    for c in found:
        if not c.available or selected is not None and c.id not in selected:
            continue
        axis = (choices or {}).get(c.id)
        axis = axis if axis in c.axes else c.axes[0] if len(c.axes) == 1 else None
        if axis is None:
            open_[c.id] = c.axes
        elif len(steps) < MAX_STEPS:
            steps.append(Step(c.metric, (axis,), None, c.chart, c.id))
    return steps, open_


def run_plan(df: DataFrame, steps: list[Step], summary: Summary) -> Outcome:
    """Each step's result; all steps share one scan of the table. A step that is refused is left out with a warning; the others go on."""
    out, queries = Outcome(), []
    for step in steps[:MAX_STEPS]:
        try:
            queries.append((step, MetricQuery.build(df, step.metric, list(step.group_by), step.filters, frozenset(summary.sensitive))))
        except SumbrookError as e:
            out.warnings.append(f"{step.title or step.metric}: {e}")
    for (step, _), found in zip(queries, run_together([q for _, q in queries], MAX_GROUPS), strict=True):
        if isinstance(found, SumbrookError):
            out.warnings.append(f"{step.title or step.metric}: {found}")
            continue
        timed = bool(step.group_by) and summary.columns[step.group_by[0]] is Kind.DATETIME
        out.results.append((replace(step, chart=fit_chart(timed, step.chart, len(found.rows))), found))
        out.warnings += found.warnings
    return out


def step_facts(df: DataFrame, step: Step, summary: Summary) -> DataFrame:
    """The facts of a step, `overall` among them: of a series, of several, of categories; without groups, or with other ones, the total alone."""
    q = MetricQuery.build(df, step.metric, list(step.group_by), step.filters, frozenset(summary.sensitive))
    percent, total, axes = q.metric.unit == "%", q.overall(), step.group_by
    timed = bool(axes) and summary.columns[axes[0]] is Kind.DATETIME
    if timed and len(axes) == 1:
        return time_facts(q.grouped().withColumnRenamed(axes[0], "t"), percent, total)
    if timed and len(axes) == 2:
        return series_facts(q.grouped().withColumnRenamed(axes[0], "t").withColumnRenamed(axes[1], "series"), percent, total)
    if len(axes) == 1:
        return category_facts(q.grouped().withColumnRenamed(axes[0], "key"), total, q.metric.additive)
    return total.where("value is not null").select(F.lit("overall").alias("fact"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("of"))
