"""Several metric queries over one table in one scan and one shuffle.

A row is expanded to what it counts for: the group and the total of each query whose filter it meets, the filter values
that it shows to exist, and the test whether date keys are first days of months. What it doesn't meet costs nothing more. One aggregate,
combined before the shuffle, sums it all up.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..errors import AnalyticsError
from ..kinds import Kind, column_name

if TYPE_CHECKING:
    from .query import MetricQuery, MetricResult

#: What an expanded row stands for.
GROUP, TOTAL, KNOWN, TABLE = 0, 1, 2, 3


class Shared:
    """The plan of queries over the same table: `parts()` is lazy, `collect()` brings at most `most` + 1 groups a query."""

    def __init__(self, queries: Sequence[MetricQuery], most: int):
        if any(q.df is not queries[0].df for q in queries):
            raise AnalyticsError("Queries that share a scan must be over the same table.")
        self.queries, self.df, self.most = list(queries), queries[0].df, most
        self.keys = list(dict.fromkeys(g for q in queries for g in q.group_by))
        self.sources = list(dict.fromkeys(c for q in queries for c in q.sources.values()))
        self.dates = [k for k in self.keys if queries[0].kinds[k] is Kind.DATETIME]
        asked = [(f.column, v) for q in queries for f in q.conditions if q.kinds[f.column] in (Kind.CATEGORICAL, Kind.TEXT) and f.op in ("eq", "in") for v in (f.value if isinstance(f.value, list) else [f.value])]
        self.asked: dict[str, list] = {}
        for column, value in dict.fromkeys(asked):
            self.asked.setdefault(column, []).append(value)

    def _part(self, part: int, of: int, keys: Sequence[str] = (), sources: Sequence[str] = (), usable: Column | None = None, told: Column | None = None, tests: bool = False) -> Column:
        """A struct of one shape: what a row counts for, with nulls in the fields that this part doesn't use."""
        shape = self.df.schema
        field = lambda name, c, kind: (c if c is not None else F.lit(None)).cast(kind).alias(name)
        own = lambda c, names: F.col(column_name(c)) if c in names else None
        fields = [F.lit(part).alias("part"), F.lit(of).alias("of"), field("told", told, "string"), field("usable", usable, "boolean")]
        fields += [field(f"k{i}", own(k, keys), shape[k].dataType) for i, k in enumerate(self.keys)]
        values = [own(c, sources) for c in self.sources]
        fields += [field(f"v{i}", v if v is None or usable is None else F.when(usable, v), shape[c].dataType) for i, (c, v) in enumerate(zip(self.sources, values, strict=True))]
        fields += [field(f"m{i}", F.col(column_name(k)) == F.date_trunc("month", F.col(column_name(k))) if tests else None, "boolean") for i, k in enumerate(self.dates)]
        return F.struct(*fields)

    def parts(self) -> DataFrame:
        """part, of, told, k*, s* (sums), rows, rows_used, m*: a row for each group, total and known value, and one for the table."""
        from .query import exact_sum, usable_rows

        counted = []
        for i, q in enumerate(self.queries):
            matched, usable = F.lit(True) if q.where is None else q.where, usable_rows(self.df, q.sources)
            counted.append(F.when(matched, self._part(TOTAL, i, (), q.sources.values(), usable)))
            if q.group_by:
                counted.append(F.when(matched & usable, self._part(GROUP, i, q.group_by, q.sources.values(), F.lit(True))))
        for i, (column, values) in enumerate(self.asked.items()):
            counted.append(F.when(F.col(column_name(column)).isin(values), self._part(KNOWN, i, told=F.col(column_name(column)))))
        if self.dates:
            counted.append(self._part(TABLE, 0, tests=True))
        rows = self.df.select(F.explode(F.array_compact(F.array(*counted))).alias("p")).select("p.*")
        sums = [exact_sum(F.col(f"v{i}"), self.df.schema[c].dataType).alias(f"s{i}") for i, c in enumerate(self.sources)]
        tests = [F.bool_and(f"m{i}").alias(f"m{i}") for i in range(len(self.dates))]
        by = ["part", "of", "told", *(f"k{i}" for i in range(len(self.keys)))]
        return rows.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("rows"), F.count_if("usable").alias("rows_used"), *tests)

    def _valued(self, parts: DataFrame) -> DataFrame:
        """`real`, a query's value as a double, or `whole` where it is a sum of whole numbers. A total over no rows is 0, a group's null."""
        real, whole = F.lit(None).cast("double"), F.lit(None).cast("decimal(38,0)")
        for i, q in enumerate(self.queries):
            sums = {}
            for name, c in q.sources.items():
                s = F.col(f"s{self.sources.index(c)}")
                s = F.when(F.col("part") == TOTAL, F.coalesce(s, F.lit(0).cast(parts.schema[f"s{self.sources.index(c)}"].dataType))).otherwise(s)
                sums[name] = s if isinstance(self.df.schema[c].dataType, T.IntegralType) else s.cast("double")
            mine, value = F.col("of") == i, q.metric.value(sums)
            if q.metric.denominator is None and isinstance(self.df.schema[q.sources[q.metric.numerator]].dataType, T.IntegralType):
                whole = F.when(mine, value.cast("decimal(38,0)")).otherwise(whole)
            else:
                real = F.when(mine, value.cast("double")).otherwise(real)
        return parts.withColumns({"real": real, "whole": whole})

    def table(self) -> DataFrame:
        """step, is_total, key (its group columns as text, in order), value (a double), rows_used: all groups and totals of the plan, in one lazy result."""
        parts = self._valued(self.parts())
        keys = [F.when(F.col("of") == i, F.array(*(F.col(f"k{self.keys.index(g)}").cast("string") for g in q.group_by)).cast("array<string>")) for i, q in enumerate(self.queries)]
        told = parts.where(F.col("part").isin(GROUP, TOTAL)).withColumn("is_total", (F.col("part") == TOTAL).cast("int"))
        return told.select(F.col("of").alias("step"), "is_total", F.when(F.col("part") == GROUP, F.coalesce(*keys)).alias("key"), F.coalesce("real", F.col("whole").cast("double")).alias("value"), "rows_used")

    def collect(self) -> list[MetricResult | AnalyticsError]:
        """Each query's result, in order; one with over `most` groups has an error in its place."""
        from .query import Group, MetricResult, format_key

        order = W.partitionBy("part", "of").orderBy(*(F.asc_nulls_last(f"k{i}") for i in range(len(self.keys))), F.col("told"))
        ranked = self._valued(self.parts()).withColumn("place", F.row_number().over(order)).where((F.col("part") == KNOWN) | (F.col("place") <= self.most + 1))
        found: dict[tuple[int, int], list] = {}
        for r in ranked.orderBy("part", "of", "place").collect():  # at most `most` + 1 rows a query, and the filters' values
            found.setdefault((r.part, r.of), []).append(r)
        table = found.get((TABLE, 0), [None])[0]
        months = {k: bool(table[f"m{i}"]) if table else False for i, k in enumerate(self.dates)}
        known = {column: {r.told for r in found.get((KNOWN, i), [])} for i, column in enumerate(self.asked)}
        value = lambda r: r.real if r.whole is None else int(r.whole)
        out: list[MetricResult | AnalyticsError] = []
        for i, q in enumerate(self.queries):
            groups = found.get((GROUP, i), [])
            if len(groups) > self.most:
                out.append(AnalyticsError(f"There are more than {self.most} groups. Filter, or group by another column."))
                continue
            total = found.get((TOTAL, i), [None])[0]
            overall = Group({}, value(total), total.rows_used) if total else Group({}, 0 if q.metric.denominator is None else None, 0)
            rows = [Group({g: format_key(r[f"k{self.keys.index(g)}"], months.get(g, False)) for g in q.group_by}, value(r), r.rows) for r in groups]
            matched = total.rows if total else 0
            out.append(MetricResult(q.metric, q.group_by, rows, overall, matched, q.warnings(overall, matched, known)))
        return out


def run_together(queries: Sequence[MetricQuery], most: int) -> list[MetricResult | AnalyticsError]:
    """The results of queries over one table, read once. No queries give no results."""
    return Shared(queries, most).collect() if queries else []
