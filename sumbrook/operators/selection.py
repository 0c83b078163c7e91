"""Exact medians and distinct counts of many columns, without a buffer that holds a column's values."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kinds import column_name

#: Ranges that a column's values are counted in at once; a range of so few values is looked at value by value.
BINS = 1024
FEW = 20_000
_LARGEST = 1.7976931348623157e308


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct: the different values of each column, null and NaN left out; a column without values has no row.

    Values become (column, fingerprint of 128 bits), which are made distinct where they are read and again after the shuffle;
    rows are neither multiplied by aggregates nor do long texts travel. Zeros of either sign are equal.
    """
    each = []
    for i, name in enumerate(columns):
        c = F.col(column_name(name))
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c + F.lit(0.0).cast(df.schema[name].dataType))
        each.append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b"))))
    marks = df.select(F.explode(F.array_compact(F.array(*each))).alias("m")).select("m.*")
    return marks.distinct().groupBy("i").agg(F.count("*").alias("distinct")).select(F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column"), "distinct")


@dataclass(frozen=True)
class _Range:
    """The values from low to high, among which the searched value is the one of this rank (from 0)."""

    low: float
    high: float
    rank: int
    held: int


def _bin(v: Column, r: _Range) -> Column:
    """The range of v: halves are taken before the difference, which could be infinite."""
    share = (v / 2 - F.lit(r.low / 2)) / F.lit(r.high / 2 - r.low / 2)
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def medians(df: DataFrame, columns: dict[str, Column], sizes: dict[str, tuple[int, float, float]]) -> dict[str, float | None]:
    """The exact median of each of `columns` (doubles; null and NaN left out), the mean of the middle two for an even number.

    sizes: for each column its number of values, the least and the largest. A pass counts the values of all columns in BINS ranges,
    and each column goes on with the range that holds its middle, from the least to the largest value there, until few values or one
    are left; these come back with their counts. The driver sees BINS rows a column and pass, at last FEW distinct values.
    """
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], _Range] = {}
    for name, (n, low, high) in sizes.items():
        for rank in {(n - 1) // 2, n // 2} if n else ():
            open_[name, rank] = _Range(max(low, -_LARGEST), min(high, _LARGEST), rank, n)
    while open_:
        for key, r in [(k, r) for k, r in open_.items() if r.low == r.high]:
            found[key] = r.low
            del open_[key]
        if not open_:
            break
        same: dict[tuple[str, float, float], list[tuple[str, int]]] = {}
        for key, r in open_.items():
            same.setdefault((key[0], r.low, r.high), []).append(key)  # the middle two mostly go together
        parts = []
        for i, keys in enumerate(same.values()):
            r, c = open_[keys[0]], columns[keys[0][0]].cast("double")
            v = F.least(F.greatest(c, F.lit(-_LARGEST)), F.lit(_LARGEST))
            fit = c.isNotNull() & ~F.isnan(c) & v.between(r.low, r.high)
            few = r.held <= FEW
            parts.append(F.when(fit, F.struct(F.lit(i).alias("i"), (F.lit(-1) if few else _bin(v, r)).alias("bin"), (v if few else F.lit(None).cast("double")).alias("only"), v.alias("v"))))
        rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*")
        counted: dict[int, list] = {}
        for x in rows.groupBy("i", "bin", "only").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            counted.setdefault(x.i, []).append(x)
        for i, keys in enumerate(same.values()):
            ranges = sorted(counted[i], key=lambda x: x.low)
            for key in keys:
                rank = open_[key].rank
                for x in ranges:
                    if rank < x.n:
                        open_[key] = _Range(x.low, x.high, rank, x.n)
                        break
                    rank -= x.n
    infinite = {name: (low, high) for name, (n, low, high) in sizes.items() if n}

    def told(name: str, rank: int) -> float:
        v, (low, high) = found[name, rank], infinite[name]
        return high if v == _LARGEST and high > v else low if v == -_LARGEST and low < v else v

    out: dict[str, float | None] = {}
    for name, (n, _, _) in sizes.items():
        if not n:
            out[name] = None
            continue
        a, b = told(name, (n - 1) // 2), told(name, n // 2)
        out[name] = a if a == b else _middle(a, b)
    return out


def _middle(a: float, b: float) -> float:
    if abs(a) == float("inf") or abs(b) == float("inf"):
        return a + b
    return float((Fraction(a) + Fraction(b)) / 2) if abs(a) + abs(b) == float("inf") else (a + b) / 2
