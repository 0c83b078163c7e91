"""Comparison facts over metric results: a table of (fact, value, period or category).

Inputs are result tables: `t` or `key`, `value`, as MetricQuery.grouped gives them. They hold one row for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_CATEGORIES = 12
#: A step is material from so many percentage points, or this share of the series' greatest value.
MATERIAL_POINTS, MATERIAL_SHARE = 2.0, 0.10


def _facts(row: DataFrame, items: list[tuple[str, Column, Column]]) -> DataFrame:
    stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), v.cast("double").alias("value"), g.cast("string").alias("of")) for n, v, g in items)))
    return row.select(stacked.alias("f")).select("f.*").where("value is not null")


def time_facts(series: DataFrame, percent: bool = False, total: DataFrame | None = None) -> DataFrame:
    """overall (the value of total, if given), first, last, min, max, change, change_pct, drop, rise and periods of (t, value).

    Ties go to the earlier period; a null period is the last one.
    """
    none, order = F.lit(None).cast("string"), W.orderBy(F.col("t").asc_nulls_last())
    points = series.where("value is not null").select(F.col("t").cast("string").alias("t"), F.col("value").cast("double").alias("value"))
    step = points.withColumn("step", F.col("value") - F.lag("value").over(order)).withColumn("pair", F.concat_ws(" → ", F.lag("t").over(order), F.col("t"))).withColumn("none", F.col("t").isNull())
    one = step.agg(
        F.count("*").alias("n"),
        F.min(F.struct("none", "t", "value")).alias("first"), F.max(F.struct("none", "t", "value")).alias("last"),
        F.min(F.struct("value", "none", "t")).alias("low"), F.min(F.struct((-F.col("value")).alias("minus"), "none", "t")).alias("high"),
        F.min(F.when(F.col("step").isNotNull(), F.struct("step", "none", "t", "pair"))).alias("drop"),
        F.min(F.when(F.col("step").isNotNull(), F.struct((-F.col("step")).alias("minus"), "none", "t", "pair"))).alias("rise"),
    )
    many, change = F.col("n") > 1, F.col("last.value") - F.col("first.value")
    pair = F.concat_ws(" → ", "first.t", "last.t")
    items = [
        ("first", F.col("first.value"), F.col("first.t")),
        ("last", F.when(many, F.col("last.value")), F.col("last.t")),
        ("min", F.when(many, F.col("low.value")), F.col("low.t")),
        ("max", F.when(many, -F.col("high.minus")), F.col("high.t")),
        ("change", F.when(many, change), pair),
        ("drop", F.when((F.col("n") > 2) & (F.col("drop.step") < 0), F.col("drop.step")), F.col("drop.pair")),
        ("rise", F.when((F.col("n") > 2) & (F.col("rise.minus") < 0), -F.col("rise.minus")), F.col("rise.pair")),
        ("periods", F.when(F.col("n") > 0, F.col("n")), none),
    ]
    if not percent:
        items.insert(5, ("change_pct", F.when(many & (F.col("first.value") != 0), change / F.col("first.value") * 100), pair))
    return _with_overall(_facts(one, items), total)


def _with_overall(found: DataFrame, total: DataFrame | None) -> DataFrame:
    if total is None:
        return found
    overall = total.where("value is not null").select(F.lit("overall").alias("fact"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("of"))
    return overall.unionByName(found)


def category_facts(groups: DataFrame, total: DataFrame, additive: bool = True) -> DataFrame:
    """cat<i>_value and, for additive metrics, cat<i>_share of (key, value), greatest first, 12 at most; overall and categories."""
    rows = groups.where("value is not null").select(F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value"))
    place = F.row_number().over(W.orderBy(F.desc("value"), F.col("key").asc_nulls_last()))
    ranked = rows.withColumn("i", place).where(F.col("i") <= MAX_CATEGORIES).crossJoin(F.broadcast(total.select(F.col("value").cast("double").alias("total")).limit(1)))  # one row
    share = F.when(F.lit(additive) & (F.col("total") != 0), F.col("value") / F.col("total") * 100)
    name = lambda what: F.concat(F.lit("cat"), F.col("i"), F.lit(what))
    listed = F.explode(F.array(F.struct(name("_value").alias("fact"), F.col("value").alias("value"), F.col("key").alias("of")), F.struct(name("_share").alias("fact"), share.alias("value"), F.col("key").alias("of"))))
    count = rows.agg(F.count("*").cast("double").alias("value")).select(F.lit("categories").alias("fact"), "value", F.lit(None).cast("string").alias("of"))
    return ranked.select(listed.alias("f")).select("f.*").where("value is not null").unionByName(count).transform(_with_overall, total)


def series_facts(points: DataFrame, percent: bool = False, total: DataFrame | None = None) -> DataFrame:
    """s<i>_first, _last, _change, _change_pct of each series of (t, series, value), growth_leader and series_count.

    Series are numbered by where they first appear in order of (t, series). The leader is the greatest change, in
    percent or, for percentages, points; ties go to the greater name.
    """
    rows = points.where("value is not null").select(F.col("t").cast("string").alias("t"), F.col("series").cast("string").alias("series"), F.col("value").cast("double").alias("value"))
    each = rows.withColumn("none", F.col("t").isNull()).groupBy("series").agg(F.min(F.struct("none", "t", "value")).alias("first"), F.max(F.struct("none", "t", "value")).alias("last"), F.count("*").alias("n"))
    delta = F.col("last.value") - F.col("first.value")
    pct = F.when(F.col("first.value") != 0, delta / F.col("first.value") * 100)
    numbered = each.withColumn("i", F.row_number().over(W.orderBy("first.none", "first.t", F.col("series").asc_nulls_last()))).withColumn("delta", delta).withColumn("pct", pct)
    several = numbered.where("n > 1")
    name = lambda what: F.concat(F.lit("s"), F.col("i"), F.lit(what))
    parts = [("_first", F.col("first.value")), ("_last", F.col("last.value")), ("_change", F.col("delta"))] + ([] if percent else [("_change_pct", F.col("pct"))])
    listed = F.explode(F.array(*(F.struct(name(n).alias("fact"), v.alias("value"), F.col("series").alias("of")) for n, v in parts)))
    grown = F.col("delta") if percent else F.col("pct")
    leader = several.where(grown.isNotNull()).agg(F.max(F.struct(grown.alias("value"), "series")).alias("m")).where("m is not null").select(F.lit("growth_leader").alias("fact"), F.col("m.value").alias("value"), F.col("m.series").alias("of"))
    count = numbered.agg(F.count("*").cast("double").alias("value")).select(F.lit("series_count").alias("fact"), "value", F.lit(None).cast("string").alias("of"))
    return several.select(listed.alias("f")).select("f.*").where("value is not null").unionByName(leader).unionByName(count).transform(_with_overall, total)


def material(step: Column, greatest: Column, percent: bool) -> Column:
    """Whether a step matters: by points for percentages, else against the series' greatest value."""
    return F.abs(step) >= (F.lit(MATERIAL_POINTS) if percent else MATERIAL_SHARE * F.abs(greatest))


def notable(found: DataFrame, percent: bool = False) -> DataFrame:
    """fact, value, of: those of drop, rise and change among time_facts that matter, in that order of their names.

    They are measured in points for percentages, else against the series' maximum; without one nothing is notable.
    """
    greatest = found.where("fact = 'max'").select(F.col("value").alias("_top"))
    steps = found.where(F.col("fact").isin("drop", "rise", "change") & (F.col("value") != 0))
    if percent:
        return steps.where(material(F.col("value"), F.lit(1.0), True)).select("fact", "value", "of")
    joined = steps.crossJoin(F.broadcast(greatest.where("_top <> 0").limit(1)))  # one row
    return joined.where(material(F.col("value"), F.col("_top"), False)).select("fact", "value", "of")
