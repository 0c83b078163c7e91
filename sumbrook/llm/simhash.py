"""Near copies by SimHash and covering locality-sensitive hashing.

Radius r = 2: every bit position gets a nonzero vector of r + 1 = 3 bits; for each nonzero mask vector v a table keeps
the positions whose vector has an odd product with v. Two fingerprints that differ in at most two positions put at
most two linear conditions on v, so some nonzero v meets both and the pair collides in that table: no link is missed.
A cell of two fingerprints is verified by their differing bits. Larger cells are split without pairs: their members
agree on the table's positions, and two of them differ in at most two others exactly if some value is within one bit
of both, so each is dealt to the values around it inside the cell; such a value gathers one fingerprint for each free
position at most, whatever the number of copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, slices, small_batches, texts
from .components import components

RADIUS = 2
SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks: 2^(r+1) - 1 of them, each of about 4/7 of the 64 positions for r = 2."""
    most = (1 << (radius + 1)) - 1
    given = [1 + xxhash.xxh64_intdigest(bytes([i]), SEED) % most for i in range(64)]
    return [sum(1 << i for i in range(64) if (given[i] & v).bit_count() & 1) for v in range(1, most + 1)]


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) < 3:
        return xxhash.xxh64_intdigest(joined, SEED)
    n, counts, digest = len(words) - 2, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    begins = [0, *ends]
    for at in range(0, n, 50_000):
        upto = min(n, at + 50_000)
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins[at:upto], ends[at + 2 : upto + 2], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [_signed(fingerprint(t)) for t in texts(batch, "text")]
        others = batch.select([c for c in batch.schema.names if c != "text"])
        yield pa.RecordBatch.from_arrays([*others.columns, pa.array(found, pa.int64())], [*others.schema.names, "fp"])


def simhash(rows: DataFrame) -> DataFrame:
    """rows without their text (bytes) and with fp, its fingerprint as a signed long. Null and blank texts have the fingerprint 0."""
    small_batches(rows.sparkSession)
    kept = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema
    return rows.mapInArrow(_fingerprints, kept)


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints `fp` at two or fewer differing bits."""
    tables = masks()
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(tables))))
    tabled = fps.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    cells = tabled.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = cells.where("n = 2").where(close).select("u", "v")
    members = tabled.join(cells.where("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in tables))
    around = F.transform(F.element_at(flips, F.col("t") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    balls = members.select("t", "fp", F.explode(around).alias("centre")).groupBy("t", "centre").agg(F.collect_list("fp").alias("of")).where("size(of) > 1")
    split = balls.select(F.array_min("of").alias("u"), F.explode("of").alias("v")).where("u <> v").where(close)
    return pairs.unionByName(split).distinct()


def _placed(marked: DataFrame, least: list[str]) -> DataFrame:
    """fp, held (rows of marked that have it), chosen: the least struct of the columns `least` in the fingerprint's component."""
    fps = cut(marked.groupBy("fp").agg(F.min(F.struct(*least)).alias("least"), F.count("*").alias("held")))
    roots = components(links(fps))
    rooted = cut(fps.join(roots, fps.fp == roots.u, "left").select("fp", "held", "least", F.coalesce("root", "fp").alias("root")))
    chosen = rooted.groupBy("root").agg(F.min("least").alias("chosen"), F.count("*").alias("members"))
    return join_hot(rooted, chosen, "root", "members", rooted.count()).select("fp", "held", "chosen")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row: the smallest doc_id that is reachable over links, itself included.

    Rows with equal fingerprints are one node, so a text with any number of copies adds one. Repeated rows each come
    back. A null doc_id takes part; it is never the smallest, and a component of null ids only has the id null. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    marked = cut(simhash(rows))
    placed = cut(_placed(marked.withColumn("none", F.col("doc_id").isNull()), ["none", "doc_id"]))
    return join_hot(marked, placed.select("fp", "held", F.col("chosen.doc_id").alias("component_id")), "fp", "held", marked.count()).select("doc_id", "fp", "component_id")


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark has a hash for values of this type: maps and variants have none."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component, unchanged.

    It is the one of the smallest doc_id; without an id a row comes last. Different texts with that id are told apart by
    their hashes, of which the smallest stays, and then by their other columns but those that hold a map or a variant at any depth; of
    rows that are equal in all this one stays.
    Columns may have any names. An empty table gives no rows.
    """
    mark = uuid.uuid4().hex  # so that no column of docs has the name
    key = [f"none_{mark}", f"id_{mark}", f"first_{mark}", f"second_{mark}", f"rest_{mark}"]
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rest = F.xxhash64(F.lit("rest"), *(F.col(f"`{f.name}`") for f in docs.schema if _hashable(f.dataType)))
    own = dict(zip(key, (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(text), F.xxhash64(F.lit("second"), text), rest), strict=True))
    marked = cut(simhash(docs.select(*(c.alias(k) for k, c in own.items()), F.col("text").cast("binary").alias("text"))))
    chosen = _placed(marked, key).select("chosen.*").distinct()
    return docs.withColumns(own).dropDuplicates(key).join(chosen, key, "left_semi").drop(*key)
