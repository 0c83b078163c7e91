"""Pieces shared by the operators: shared-folder tables, salted ranks, bounded Arrow slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Salts of a key in a salted rank, at least.
SALTS = 2048
#: Rows in an Arrow batch, so that a batch of long texts stays small.
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see, which spark.checkpoint.dir names. Only local runs, such as tests, may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors then cost no earlier work."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def id_text(col: Column) -> Column:
    """A document id as text; a null id counts as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def remainder(col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.pmod(F.crc32(id_text(col).cast("binary")), F.lit(of).cast("long"))


def unit_hash(*cols: Column) -> Column:
    """A hash of the columns as a number from 0 to 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def buckets_for(rows: int) -> int:
    """Salts for a table: neither a salt's rows nor a key's salts are more than the root of the rows, or SALTS."""
    return max(SALTS, isqrt(rows))


def running(df: DataFrame, keys: list[str], salt: Column, order: list[Column], size: Column, out: str, buckets: int) -> DataFrame:
    """Add `out`: the sum of `size` over the rows before this one among those with equal keys.

    A key may hold any share of the rows, so each key is dealt over `buckets` salts; the order is by salt, then by
    `order`. The salts' totals are added up in two steps, so a window never holds more than the root of a key's salts.
    Keys must not be null.
    """
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(buckets)).cast("int")).withColumn("_size", size.cast("long"))
    by = [*keys, "_salt"]
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = salted.groupBy(*by).agg(F.sum("_size").alias("_total")).withColumn("_coarse", F.floor(F.col("_salt") / (isqrt(buckets) + 1)))
    before = lambda keys, place: F.coalesce(F.sum("_total").over(W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = totals.groupBy(*keys, "_coarse").agg(F.sum("_total").alias("_total")).select(*keys, "_coarse", before(keys, "_coarse").alias("_before"))
    fine = totals.select(*by, "_coarse", before([*keys, "_coarse"], "_salt").alias("_within"))
    offsets = fine.join(coarse, [*keys, "_coarse"]).select(*by, (F.col("_before") + F.col("_within")).alias("_offset"))
    ranked = salted.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return ranked.join(offsets, by).withColumn(out, F.col("_offset") + F.col("_inside")).drop("_salt", "_size", "_inside", "_offset")


#: A key that holds more than one of so many rows is hot; there are fewer hot keys than this.
HOT = 1024


def join_hot(rows: DataFrame, table: DataFrame, key: str, held: str, total: int, how: str = "inner") -> DataFrame:
    """rows with table's columns by key, where table has one row for each key and `held` says how many of `total` rows have it.

    how is inner or left. Hot keys, HOT at most, are broadcast, so their rows stay where they are; the others are joined by shuffle.
    """
    hot = F.col(held) * HOT > F.lit(total)
    some, others = table.where(hot).drop(held), table.where(~hot).drop(held)
    rest = rows.join(F.broadcast(some.select(key)), key, "left_anti")
    return rows.join(F.broadcast(some), key).unionByName(rest.join(others, key, how))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of `column`; a longer value comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # the worker waits for its next task without what this one needed


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values, text or bytes, as bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]
