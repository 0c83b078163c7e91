"""Column profiles, quality issues and duplicates, each from as few passes as its shape allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..kinds import Kind, column_name, kinds
from .firsts import first_values
from .selection import distinct_counts, medians

TOP_VALUES = 12
SAMPLES = 5
VALUE_LENGTH = 60
#: Columns profiled in one aggregate, so that generated code stays small.
COLUMNS_AT_ONCE = 40
MISSING_ERROR, MISSING_WARNING, INVALID_ERROR = 50.0, 5.0, 20.0


def _text(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, VALUE_LENGTH)


STATS = "column string, kind string, rows long, missing long, missing_pct double, distinct long, low double, high double, mean double, median double, std double, first string, last string"


def column_stats(df: DataFrame) -> DataFrame:
    """column, kind, rows, missing, missing_pct, distinct, low, high, mean, median, std of each column.

    Numbers only for numeric columns, low and high also for dates (as text). Null and NaN are missing. Values marked by
    `<name>__invalid` are not missing. One aggregate without distinct counts, one pass that makes values distinct, and the
    passes that narrow the medians: see selection.py. The driver holds a row for each column.
    """
    names = [c for c in df.columns if not c.endswith("__invalid")]
    of = kinds(df.select(*map(column_name, names)))
    column = {}
    for name in names:
        c = F.col(column_name(name))
        column[name] = F.when(~F.isnan(c), c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c
    found: dict[str, dict] = {}
    for at in range(0, len(names), COLUMNS_AT_ONCE):
        some, aggs = names[at : at + COLUMNS_AT_ONCE], [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(some):
            c = column[name]
            invalid = F.count_if(column_name(f"{name}__invalid")) if f"{name}__invalid" in df.columns else F.lit(0)
            aggs += [F.count(c).alias(f"n{i}"), invalid.alias(f"i{i}")]
            if of[name] is Kind.NUMERIC:
                v = c.cast("double")
                aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
            elif of[name] is Kind.DATETIME:
                aggs += [F.date_format(F.min(c), "yyyy-MM-dd HH:mm:ss").alias(f"l{i}"), F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss").alias(f"h{i}")]
        r = df.agg(*aggs).first()
        for i, name in enumerate(some):
            missing = r["rows"] - r[f"n{i}"] - r[f"i{i}"]
            found[name] = {"column": name, "kind": of[name].value, "rows": r["rows"], "missing": missing, "n": r[f"n{i}"], "distinct": 0}
            if of[name] is Kind.NUMERIC:
                found[name] |= {"low": r[f"l{i}"], "high": r[f"h{i}"], "mean": r[f"m{i}"], "std": r[f"s{i}"]}
            elif of[name] is Kind.DATETIME:
                found[name] |= {"first": r[f"l{i}"], "last": r[f"h{i}"]}
    numbers = {name: (p["n"], p["low"], p["high"]) for name, p in found.items() if of[name] is Kind.NUMERIC}
    for name, median in medians(df, {name: column[name] for name in numbers}, numbers).items():
        found[name]["median"] = median
    for r in distinct_counts(df, names).collect() if names else []:  # a row for each column
        found[r["column"]]["distinct"] = r["distinct"]
    fields = [f.split()[0] for f in STATS.split(", ")]
    rows = df.sparkSession.createDataFrame([tuple(0.0 if f == "missing_pct" else p.get(f) for f in fields) for p in found.values()], STATS)
    return rows.withColumn("missing_pct", F.round(F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0)), 2))


def _values(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _text(F.col(column_name(c))).alias("value")) for c in columns)))
    counted = df.select(row, pairs.alias("p")).select(row, "p.*").where("value is not null")
    return counted.groupBy("column", "value").agg(F.count("*").alias("count"), F.min(row).alias("_first"))


def _first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(*order))).where(F.col("rank") <= n)


def top_values(df: DataFrame, columns: list[str], row: str, n: int = TOP_VALUES) -> DataFrame:
    """column, rank, value, count: the n commonest values of each column, ties by first appearance in order of `row`."""
    return _first_n(_values(df, columns, row), n, F.desc("count"), F.col("_first")).select("column", "rank", "value", "count")


def sample_values(df: DataFrame, columns: list[str], row: str, n: int = SAMPLES) -> DataFrame:
    """column, rank, value: the first n distinct values of each column, from one pass and without counting the others."""
    return first_values(df, {c: _text(F.col(column_name(c))) for c in columns}, row, n, distinct=True)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row, duplicates: the rows beyond the first of each set of equal rows; nulls are equal.

    Rows are told apart by 128 bits of fingerprint, so what is shuffled doesn't grow with their texts; two different rows are taken
    for equal with a chance of one in 2 ** 128.
    """
    columns = [F.col(column_name(c)) for c in df.columns]
    if not columns:
        return df.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("duplicates"))
    # xxhash64 skips nulls, so where they stand is hashed too
    holes = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    marks = [F.xxhash64(*columns, holes).alias("_a"), F.xxhash64(F.lit(1), *columns, holes).alias("_b")]
    shared = df.select(*marks).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return shared.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row, duplicates: the rows beyond the first of each set of equal rows; nulls are equal."""
    same = df.groupBy(*(F.col(column_name(c)) for c in df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def quality_issues(stats: DataFrame, duplicates: DataFrame | None = None, invalid: DataFrame | None = None, personal: list[str] | None = None) -> DataFrame:
    """issue, column, severity, count from column_stats, duplicate_rows, a table (column, invalid, present) and the personal columns."""
    none = F.lit(None).cast("string")
    severity = F.when(F.col("missing_pct") >= MISSING_ERROR, "error").when(F.col("missing_pct") >= MISSING_WARNING, "warning").otherwise("info")
    shown = lambda issue, of, level, n: F.struct(F.lit(issue).alias("issue"), of.alias("column"), level.alias("severity"), n.cast("long").alias("count"))
    empty = (F.col("missing") == F.col("rows")) & (F.col("rows") > 0)
    tests = [
        F.when(empty, shown("empty_column", F.col("column"), F.lit("error"), F.col("missing"))),
        F.when(~empty & (F.col("missing") > 0), shown("missing_values", F.col("column"), severity, F.col("missing"))),
        F.when((F.col("distinct") == 1) & (F.col("rows") > 1), shown("constant_column", F.col("column"), F.lit("info"), F.lit(1))),
        F.when(F.col("column").rlike(r"^Unnamed: \d+$"), shown("unnamed_column", F.col("column"), F.lit("warning"), F.lit(1))),
        F.when(F.col("column").isin(personal or []), shown("possible_personal_data", F.col("column"), F.lit("info"), F.col("rows") - F.col("missing"))),
    ]
    found = stats.select(F.explode(F.array_compact(F.array(*tests))).alias("i")).select("i.*")
    if duplicates is not None:
        found = found.unionByName(duplicates.where("duplicates > 0").select(F.lit("duplicate_rows").alias("issue"), none.alias("column"), F.lit("warning").alias("severity"), F.col("duplicates").alias("count")))
    if invalid is not None:
        level = F.when(F.col("invalid") * 100.0 >= INVALID_ERROR * F.col("present"), "error").otherwise("warning")
        found = found.unionByName(invalid.where("invalid > 0").select(F.concat(F.lit("invalid_"), F.col("kind")).alias("issue"), "column", level.alias("severity"), F.col("invalid").cast("long").alias("count")))
    return found


def head(df: DataFrame, row: str, n: int) -> DataFrame:
    """The first n rows in the order of the table; only n rows of each task meet."""
    return df.orderBy(row).limit(n)
