"""Chart points and axes over metric results, and overview charts of raw columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import AnalyticsError

MAX_POINTS = 500
MAX_TITLE = 200
PIE_CATEGORIES = 6
FREQUENT = 15


def points(groups: DataFrame, x: str, series: str | None = None) -> DataFrame:
    """x, series, value, x_rank, s_rank of a result table, in the natural order of the raw keys, nulls last."""
    rank = lambda c: F.dense_rank().over(W.orderBy(F.col(c).asc_nulls_last()))  # noqa: E731  a row for each group
    s = F.col(series) if series else F.lit(None)
    ranked = groups.withColumn("x_rank", rank(x)).withColumn("s_rank", rank(series) if series else F.lit(1))
    return ranked.select(F.col(x).cast("string").alias("x"), s.cast("string").alias("series"), "value", "x_rank", "s_rank")


def checked_points(groups: DataFrame, chart: str, group_by: list[str], x: str, additive: bool) -> DataFrame:
    """The points of a line, bar or pie; the rules are checked before anything is drawn."""
    if chart not in ("line", "bar", "pie"):
        raise AnalyticsError(f"Unknown chart {chart!r}; there are line, bar and pie.")
    if not 1 <= len(group_by) <= 2 or x not in group_by:
        raise AnalyticsError("A chart needs one or two grouping columns, and its x axis is one of them.")
    if chart == "pie" and (len(group_by) > 1 or not additive):
        raise AnalyticsError("A pie needs one grouping column and a metric whose parts add up.")
    found = points(groups, x, next((g for g in group_by if g != x), None))
    if chart == "pie":
        found = found.where("value is not null")
        low, high = found.agg(F.min("value"), F.max("value")).first()
        if low is None or low < 0 or high <= 0:
            raise AnalyticsError("A pie needs values that are not negative, one of them positive.")
    if found.limit(MAX_POINTS + 1).count() > MAX_POINTS:
        raise AnalyticsError(f"More than {MAX_POINTS} points.")
    return found.orderBy("x_rank", "s_rank")


def fit_chart(time_axis: bool, requested: str, categories: int) -> str:
    """Time goes on a line; a pie of more than six categories becomes bars."""
    if time_axis:
        return "line"
    return "bar" if requested == "line" or requested == "pie" and categories > PIE_CATEGORIES else requested


def frequency(df: DataFrame, column: str, n: int = FREQUENT) -> DataFrame:
    """value, count of the n commonest values; ties by value."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("count"), "value").limit(n)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, count over equal ranges between the least and the greatest value; empty bins are left out."""
    c = F.col(column).cast("double")
    edges = df.agg(F.min(c).alias("_low"), F.max(c).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    place: Column = F.when(width > 0, F.least(F.floor((c - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = df.where(c.isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", place)  # one row
    counted = placed.groupBy("bin", "_low", "_high").agg(F.count("*").alias("count"))
    return counted.select("bin", (F.col("_low") + F.col("bin") * width).alias("low"), (F.col("_low") + (F.col("bin") + 1) * width).alias("high"), "count")
