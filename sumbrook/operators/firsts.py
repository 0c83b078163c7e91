"""The first values of every column in the order of the rows, from one pass over the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA = "i int, row long, value string"
#: Tasks whose finds meet in one task before all do.
MERGED = 256


class _Firsts:
    """The n rows that come first, of distinct values if asked, of one column. What two of them hold can be put together in any order."""

    def __init__(self, n: int, distinct: bool):
        self.n, self.distinct, self.rows, self.values = n, distinct, np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, rows: np.ndarray, values: pa.Array) -> None:
        fit = values.is_valid().to_numpy(zero_copy_only=False)
        if len(self.rows) == self.n:
            fit &= rows < self.rows[-1]
        at = np.flatnonzero(fit)
        if not len(at):
            return
        at = at[np.argsort(rows[at], kind="stable")]
        if not self.distinct:
            at = at[: self.n]
        rows, texts = np.concatenate((self.rows, rows[at])), np.concatenate((self.values, np.array(values.take(pa.array(at)).to_pylist(), object)))
        order = np.argsort(rows, kind="stable")
        if self.distinct:
            seen: dict[str, int] = {}
            for i in order:
                if seen.setdefault(texts[i], i) == i and len(seen) == self.n:
                    break
            order = np.array(list(seen.values()), np.int64)
        self.rows, self.values = rows[order[: self.n]], texts[order[: self.n]]


def _kept(columns: int, n: int, distinct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Firsts(n, distinct) for _ in range(columns)]
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for i, h in enumerate(held):
                h.add(rows, batch.column(i + 1))
        for i, h in enumerate(held):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(h.rows), pa.int32()), pa.array(h.rows), pa.array(h.values.tolist(), pa.string())], ["i", "row", "value"])

    return run


def first_values(df: DataFrame, columns: dict[str, Column], row: str, n: int, distinct: bool = False) -> DataFrame:
    """column, rank (from 1), value: the first n values of each of `columns` (text, null is none) in the order of `row`, a long without nulls.

    With `distinct` each value counts where it stands first. A task keeps n rows a column, whatever it reads; what tasks kept
    meets in groups of MERGED tasks first, so no task reads what all have kept. Rows with equal numbers come in no set order.
    """
    kept = df.select(F.col(row).cast("long").alias("row"), *(c.cast("string").alias(str(i)) for i, c in enumerate(columns.values()))).mapInArrow(_kept(len(columns), n, distinct), SCHEMA)
    merged = F.floor(F.spark_partition_id() / MERGED)
    some = _least(kept.withColumn("of", merged), ["i", "of"], n, distinct)
    place = F.row_number().over(W.partitionBy("i").orderBy("row")).cast("int")
    least = _least(some, ["i"], n, distinct).withColumn("rank", place)
    names = F.array(*(F.lit(c) for c in columns))
    return least.select(F.element_at(names, F.col("i") + 1).alias("column"), "rank", "value")


def _least(rows: DataFrame, by: list[str], n: int, distinct: bool) -> DataFrame:
    if distinct:
        rows = rows.groupBy(*by, "value").agg(F.min("row").alias("row"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("row"))).where(F.col("place") <= n).drop("place")
