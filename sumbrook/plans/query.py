"""The metric query: filter, leave out rows without the metric's sources, group, sum, derive the value."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalyticsError
from ..kinds import Kind, column_name, kinds
from .filters import Condition, compile_filters, known_column
from .metrics import Metric, metric, source_columns
from .shared import run_together

MAX_GROUP_BY = 3
MAX_GROUPS = 200
MAX_EXAMPLES = 8
#: A double is summed in three whole parts: before the point, and twice so many binary places behind it.
SUM_BITS = 60
#: Doubles from here on are whole, and from there on too large for a sum of decimals.
_WHOLE, _LARGE = float(2**53), float(2**80)


@dataclass(frozen=True)
class Group:
    keys: dict[str, Any]
    value: float | int | None
    rows_used: int


@dataclass
class MetricResult:
    metric: Metric
    group_by: list[str]
    rows: list[Group]
    overall: Group
    rows_matched: int
    warnings: list[str] = field(default_factory=list)


def exact_sum(c: Column, of: T.DataType) -> Column:
    """A sum that doesn't depend on the order of the rows: whole numbers as decimals, doubles without loss down to 2 ** -120.

    A double is cut into whole numbers, whose sums are exact; only the three sums are rounded, when they are put
    together. Doubles of 2 ** 80 and more, infinities with them, are added up as doubles: inf and -inf make NaN. NaN is left out.
    """
    if isinstance(of, T.IntegralType):
        return F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    if isinstance(of, T.DecimalType):
        return F.sum(c)
    x, step = c.cast("double"), F.lit(float(2**SUM_BITS))
    small, fitting = F.abs(x) < _WHOLE, F.abs(x) < _LARGE
    whole = F.when(small, x.cast("long").cast("decimal(38,0)")).otherwise(F.when(fitting, x).cast("decimal(38,0)"))
    behind = F.when(small, (x - x.cast("long")) * step).otherwise(F.when(fitting, 0.0))
    finer = (behind - behind.cast("long")) * step
    parts = [F.sum(p.cast("long").cast("decimal(20,0)")).cast("double") for p in (behind, finer)]
    exact = F.sum(whole).cast("double") + (parts[0] + parts[1] / step) / step
    large = F.sum(F.when(~fitting & ~F.isnan(x), x))
    return F.when(large.isNull(), exact).otherwise(large + F.coalesce(exact, F.lit(0.0)))


def usable_rows(df: DataFrame, sources: dict[str, str]) -> Column:
    """Whether a row has all the metric's sources; NaN is missing."""
    parts = []
    for name in dict.fromkeys(sources.values()):
        c = F.col(column_name(name))
        parts.append(c.isNotNull() & ~F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNotNull())
    return reduce(and_, parts)


@dataclass(frozen=True)
class MetricQuery:
    """A checked query over a table. `grouped()` and `overall()` are lazy plans, whose sums of whole numbers must fit into a long; `run()` collects at most MAX_GROUPS groups."""

    df: DataFrame
    metric: Metric
    group_by: list[str]
    conditions: list[Condition]
    where: Column | None
    sources: dict[str, str]
    kinds: dict[str, Kind]

    @classmethod
    def build(cls, df: DataFrame, name: str, group_by: list[str] | str | None = None, filters: Any = None, sensitive: frozenset[str] = frozenset()) -> MetricQuery:
        m, of, groups = metric(name), kinds(df), [group_by] if isinstance(group_by, str) and group_by else list(group_by or [])
        if len(groups) > MAX_GROUP_BY:
            raise AnalyticsError(f"Grouping by {len(groups)} columns is too much; the limit is {MAX_GROUP_BY}.")
        if len(set(groups)) < len(groups):
            raise AnalyticsError("A column is grouped by twice.")
        for g in groups:
            if known_column(g, of) in sensitive:
                raise AnalyticsError(f"Column {g!r} holds personal data and can't be grouped by.")
        sources = source_columns(m, of)
        conditions, where = compile_filters(filters, of, sensitive)
        return cls(df, m, groups, conditions, where, sources, of)

    def matched(self) -> DataFrame:
        return self.df if self.where is None else self.df.where(self.where)

    def _aggregates(self) -> list[Column]:
        sums = [exact_sum(F.col(column_name(c)), self.df.schema[c].dataType).alias(f"sum_{i}") for i, c in enumerate(self.sources.values())]
        return [*sums, F.count(F.lit(1)).alias("rows_used")]

    def _value(self, zero: bool) -> Column:
        sums = {}
        for i, (name, c) in enumerate(self.sources.items()):
            s = F.col(f"sum_{i}")
            s = F.coalesce(s, F.lit(0)) if zero else s
            sums[name] = s.cast("long" if isinstance(self.df.schema[c].dataType, T.IntegralType) else "double")
        return self.metric.value(sums)

    def grouped(self) -> DataFrame:
        """The group columns, value, rows_used; one partial aggregate before the only shuffle."""
        keys = [F.col(column_name(g)) for g in self.group_by]
        return self.matched().where(usable_rows(self.df, self.sources)).groupBy(*keys).agg(*self._aggregates()).select(*keys, self._value(False).alias("value"), "rows_used")

    def sorted(self) -> DataFrame:
        return self.grouped().orderBy(*(F.col(column_name(g)).asc_nulls_last() for g in self.group_by))

    def overall(self) -> DataFrame:
        """One row: value, rows_used, rows_matched; of no rows a sum is 0 and a ratio null."""
        usable = usable_rows(self.df, self.sources)
        marked = self.matched().select(*(F.when(usable, F.col(column_name(c))).alias(c) for c in dict.fromkeys(self.sources.values())), usable.alias("_usable"))
        sums = [exact_sum(F.col(column_name(c)), self.df.schema[c].dataType).alias(f"sum_{i}") for i, c in enumerate(self.sources.values())]
        return marked.agg(*sums, F.count_if("_usable").alias("rows_used"), F.count(F.lit(1)).alias("rows_matched")).select(self._value(True).alias("value"), "rows_used", "rows_matched")

    def with_total(self) -> DataFrame:
        """Groups and the total in one shuffle; is_total tells the total from the null group. No rows give no total."""
        if not self.group_by:
            return self.overall().select(F.lit(1).cast("int").alias("is_total"), "value", "rows_used")
        keys = [F.col(column_name(g)) for g in self.group_by]
        usable = self.matched().where(usable_rows(self.df, self.sources))
        total = F.when(F.grouping_id() > 0, 1).otherwise(0).cast("int")
        found = usable.groupingSets([keys, []], *keys).agg(*self._aggregates(), total.alias("is_total"))
        return found.select(*keys, "is_total", self._value(False).alias("value"), "rows_used")

    def run(self) -> MetricResult:
        """Groups, total, month test and unknown filter values from one scan. Sums of whole numbers may leave 64 bits here."""
        found = run_together([self], MAX_GROUPS)[0]
        if isinstance(found, AnalyticsError):
            raise found
        return found

    def warnings(self, overall: Group, matched: int, known: dict[str, set]) -> list[str]:
        """What a reader must know of the result; known has the filters' values that the table holds."""
        out = []
        if left_out := matched - overall.rows_used:
            out.append(f"{left_out} rows were left out: a value of {', '.join(self.sources.values())} is missing.")
        if not matched:
            out.append("No rows match the filters.")
        if self.metric.denominator and overall.rows_used and overall.value is None:
            out.append(f"The sum of {self.metric.denominator} is 0: the metric has no value.")
        for f in self.conditions:
            if self.kinds[f.column] in (Kind.CATEGORICAL, Kind.TEXT) and f.op in ("eq", "in"):
                values, c = f.value if isinstance(f.value, list) else [f.value], F.col(column_name(f.column))
                if missing := [v for v in values if v not in known.get(f.column, set())]:
                    some = [r[0] for r in self.df.where(c.isNotNull()).select(c).distinct().orderBy(c).limit(MAX_EXAMPLES).collect()]
                    out.append(f"Column {f.column!r} has no {', '.join(map(repr, missing))}; it has for example {', '.join(map(repr, some))}.")
        return out


def format_key(value: Any, month_start: bool) -> Any:
    """A group key for display: months as yyyy-MM, midnights as dates; null stays null."""
    if not hasattr(value, "strftime"):
        return value
    if month_start:
        return value.strftime("%Y-%m")
    if not hasattr(value, "hour") or (value.hour, value.minute, value.second, value.microsecond) == (0, 0, 0, 0):
        return value.strftime("%Y-%m-%d")
    return value.strftime("%Y-%m-%d %H:%M:%S")


def key_text(c: Column, month_start: bool = False) -> Column:
    """The same for a timestamp column."""
    if month_start:
        return F.date_format(c, "yyyy-MM")
    return F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


def calculate_metric(df: DataFrame, name: str, group_by: list[str] | str | None = None, filters: Any = None, sensitive: frozenset[str] = frozenset()) -> MetricResult:
    return MetricQuery.build(df, name, group_by, filters, sensitive).run()


def month_totals(df: DataFrame, time: str, measures: list[str]) -> DataFrame:
    """month (yyyy-MM) and the exact sum of each measure; rows without a time make up the month null. One shuffle of partial sums."""
    sums = [exact_sum(F.col(column_name(m)), df.schema[m].dataType).alias(m) for m in measures]
    return df.groupBy(F.date_format(F.col(column_name(time)), "yyyy-MM").alias("month")).agg(*sums)
