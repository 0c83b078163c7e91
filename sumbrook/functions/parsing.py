"""Text columns to typed ones. Every parser keeps apart what is missing and what is invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kinds import Kind, column_name
from ..operators.firsts import first_values
from ..operators.selection import distinct_counts

# fixed values: tokens that mean a missing value, truth and falsehood
NULL_TOKENS = ["", "-", "—", "–", "n/a", "na", "nan", "null", "none", "н/д"]
TRUE_TOKENS = ["true", "да", "yes", "y", "истина", "1"]
FALSE_TOKENS = ["false", "нет", "no", "n", "ложь", "0"]
# fixed values: the date patterns in order of preference; ISO stands for ISO 8601
ISO = "iso"
DATE_PATTERNS = ["yyyy-M-d", "yyyy-M", "d.M.yyyy", "d/M/yyyy", "yyyy/M/d", "M/yyyy", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "d.M.yyyy H:m:s", "d.M.yyyy H:m", ISO]
MIN_RATIO = 0.8
SAMPLE = 500
MAX_CATEGORIES = 50
MAX_CATEGORY_RATIO = 0.5

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_ROW = "_row"
# fixed values: the characters that Unicode calls blank
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def clean(c: Column) -> Column:
    """Trimmed text; tokens of a missing value are null."""
    text = F.btrim(c.cast("string"), F.lit(_BLANKS))
    return F.when(~F.lower(text).isin(NULL_TOKENS), text)


def parse_numeric(c: Column) -> Column:
    """Blanks, currency and percent signs go; with both marks the comma groups thousands, alone it is the decimal mark."""
    return _numeric(clean(c))


def _numeric(cleaned: Column) -> Column:
    text = F.regexp_replace(cleaned, "[\\s  ₸$€£₽%]", "")
    plain = F.when(text.contains(",") & text.contains("."), F.replace(text, F.lit(","), F.lit(""))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def parse_boolean(c: Column) -> Column:
    text = F.regexp_replace(F.lower(clean(c)), r"^([01])\.0$", "$1")
    return F.when(text.isin(TRUE_TOKENS), True).when(text.isin(FALSE_TOKENS), False)


def parse_datetime(c: Column, pattern: str) -> Column:
    text = clean(c)
    if pattern == ISO:
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_mixed_datetime(c: Column) -> Column:
    """For a column that the user calls dates: any of the patterns, day first."""
    return F.coalesce(*(parse_datetime(c, p) for p in DATE_PATTERNS))


def coerce(c: Column, kind: Kind, pattern: str | None = None) -> Column:
    if kind is Kind.NUMERIC:
        return parse_numeric(c)
    if kind is Kind.BOOLEAN:
        return parse_boolean(c)
    if kind is Kind.DATETIME:
        return parse_datetime(c, pattern) if pattern else parse_mixed_datetime(c)
    return F.regexp_replace(clean(c), r"^(-?\d+)\.0$", "$1")


def detect(df: DataFrame, row: str = _ROW) -> dict[str, tuple[Kind, str | None]]:
    """The kind, and for dates the pattern, of every text column.

    Booleans by words alone come before numbers (0.8 of the values parse), dates (0.8 of the first 500 values in order of
    `row`), categories (50 values at most, half as many as rows) and text. One aggregate tests all columns; one pass takes the first
    values of those that are still open, on which the dates are tried; one more counts distinct values where an estimate leaves a doubt.
    """
    names = [c for c in df.columns if c != row]
    words = [t for t in TRUE_TOKENS + FALSE_TOKENS if t not in "01"]
    parts: list[Column] = []
    for i, name in enumerate(names):
        text = F.col(f"t{i}")
        parts += [F.count(text).alias(f"n{i}"), F.count_if(F.lower(text).isin(words)).alias(f"b{i}"), F.count(_numeric(text)).alias(f"f{i}"), F.approx_count_distinct(text).alias(f"d{i}")]
    cleaned = df.select(*(clean(F.col(column_name(name))).alias(f"t{i}") for i, name in enumerate(names)))  # each value is cleaned once
    r, found = cleaned.agg(*parts).first(), {}
    for i, name in enumerate(names):
        n = r[f"n{i}"]
        found[name] = (Kind.BOOLEAN, None) if n and r[f"b{i}"] == n else (Kind.NUMERIC, None) if n and r[f"f{i}"] >= MIN_RATIO * n else (Kind.TEXT, None)
    open_ = [i for i, name in enumerate(names) if found[name][0] is Kind.TEXT and r[f"n{i}"]]
    if open_:
        firsts = first_values(df, {names[i]: clean(F.col(column_name(names[i]))) for i in open_}, row, SAMPLE)
        tried = firsts.groupBy("column").agg(F.count("*").alias("n"), *(F.count(parse_datetime(F.col("value"), p)).alias(f"p{k}") for k, p in enumerate(DATE_PATTERNS)))
        for t in tried.collect():  # a row for each column
            best = max(range(len(DATE_PATTERNS)), key=lambda k: (t[f"p{k}"], -k))
            if t[f"p{best}"] >= MIN_RATIO * t.n:
                found[t.column] = (Kind.DATETIME, DATE_PATTERNS[best])
    open_ = [i for i in open_ if found[names[i]][0] is Kind.TEXT and r[f"d{i}"] <= 2 * MAX_CATEGORIES]
    if open_:
        texts = df.select(*(clean(F.col(column_name(names[i]))).alias(names[i]) for i in open_))
        counts = {d["column"]: d["distinct"] for d in distinct_counts(texts, texts.columns).collect()}
        for i in open_:
            if counts.get(names[i], 0) <= MAX_CATEGORIES and counts.get(names[i], 0) <= MAX_CATEGORY_RATIO * r[f"n{i}"]:
                found[names[i]] = (Kind.CATEGORICAL, None)
    return found


def typed(df: DataFrame, kinds: dict[str, tuple[Kind, str | None]]) -> DataFrame:
    """The coerced columns with their kind in the metadata, and `<name>__invalid` for values that are there but don't parse.

    A numeric column without nulls or fractions becomes long.
    """
    whole = [F.bool_and(v.isNotNull() & (v == F.floor(v)) & (F.abs(v) < 2**53)).alias(str(i)) for i, (c, (k, _)) in enumerate(kinds.items()) if k is Kind.NUMERIC for v in [parse_numeric(F.col(column_name(c)))]]
    longs = df.agg(*whole).first().asDict() if whole else {}
    out = []
    for i, (name, (kind, pattern)) in enumerate(kinds.items()):
        c = F.col(column_name(name))
        value = coerce(c, kind, pattern)
        typed_value = value.cast("long") if longs.get(str(i)) else value
        out += [typed_value.alias(name, metadata={"kind": kind.value}), (clean(c).isNotNull() & value.isNull()).alias(f"{name}__invalid")]
    return df.select(*[c for c in df.columns if c not in kinds], *out)
