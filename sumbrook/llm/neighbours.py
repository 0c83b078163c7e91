"""Approximate nearest neighbours by an inverted multi-index.

A vector's halves are quantised separately, so 256 centroids a half make 65,536 cells. A query takes the cells in
order of the sum of its squared distances to the two centroids, from a heap, until they hold enough candidates. The
entries of those cells are ranked by exact distance, in blocks of the index that meet blocks of queries.

How many candidates are enough is measured on the table itself: for a bounded number of its vectors the exact
neighbours are found by one pass over all rows, and the cells are taken far enough to hold the stated share of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small_batches, unit_hash

#: Vectors that the centroids are fitted on, in expectation; chosen by a hash of their id.
SAMPLE = 16_384
#: Centroids of each half at most; fewer for small tables.
CENTROIDS = 256
ROUNDS = 12
#: The share of exact neighbours that the cells taken are to hold, and the vectors on which it is measured.
RECALL = 0.95
MEASURED = 256
#: First-half centroids whose cells make one block, and the rows of a block that meet in one group.
GROUP = 8
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
SEED = 5


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0)


def centroids(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means in numpy on a bounded sample; empty clusters keep their centre."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(SEED).choice(len(distinct), k, replace=False)] if k else distinct
    for _ in range(rounds if k else 0):
        own = _squared(x, centres).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Codebook:
    def __init__(self, sample: np.ndarray, most: int):
        self.half = (sample.shape[1] + 1) // 2
        self.first, self.second = centroids(sample[:, : self.half], most), centroids(sample[:, self.half :], most)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(x[:, : self.half], self.first).argmin(1), _squared(x[:, self.half :], self.second).argmin(1)

    def visit(self, q: np.ndarray, counts: np.ndarray, want: int) -> list[tuple[int, int]]:
        """The cells that a query takes: pairs of centroid ranks leave the heap by summed distance."""
        a, b = _squared(q[None, : self.half], self.first)[0], _squared(q[None, self.half :], self.second)[0]
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db, pa_, pb = a[by_a].tolist(), b[by_b].tolist(), by_a.tolist(), by_b.tolist()
        heap, reached, got, out = [(da[0] + db[0], 0, 0)], [-1] * len(da), 0, []
        n_a, n_b = len(da), len(db)
        # row i is open once row i - 1 is past the same column; each row is entered from the left
        while heap and got < want:
            _, i, j = heapq.heappop(heap)
            reached[i] = j
            n = counts[pa_[i], pb[j]]
            if n:
                got += int(n)
                out.append((pa_[i], pb[j]))
            if j + 1 < n_b and (i == 0 or reached[i - 1] >= j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if i + 1 < n_a and reached[i + 1] == j - 1:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles): without vectors that are null, zero or empty or hold null, NaN or infinite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(probes: Broadcast, width: int, k: int):
    """The k nearest index rows of each probe among those of one partition, with their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, q = probes.value
        held = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, a, b = (batch.column(c).to_numpy() for c in (2, 3, 4))
            far = _squared(q, _matrix(batch.column(1), width))
            far[own_ids[:, None] == ids] = np.inf
            far, cell = np.hstack((held[0], far)), np.hstack((held[1], np.broadcast_to(a.astype(np.int64) << 32 | b, far.shape)))
            at = np.argsort(far, 1, kind="stable")[:, :k]
            held = np.take_along_axis(far, at, 1), np.take_along_axis(cell, at, 1)
        which, place = np.nonzero(np.isfinite(held[0]))
        cells = held[1][which, place]
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(held[0][which, place]), pa.array(cells >> 32, pa.int32()), pa.array(cells & 0xFFFFFFFF, pa.int32())], ["probe", "far", "a", "b"])

    return run


def enough(index: DataFrame, book: Codebook, counts: np.ndarray, k: int, recall: float = RECALL, measured: int = MEASURED) -> int:
    """How many vectors a query's cells must hold so that they hold the share `recall` of its k nearest ones."""
    width = book.first.shape[1] + book.second.shape[1]
    rows = index.orderBy(F.xxhash64(F.lit("measured"), F.col("vec_id")), "vec_id", "row").select("row", "v").limit(measured).toPandas()
    q = _matrix(rows.v, width)
    probes = index.sparkSession.sparkContext.broadcast((rows.row.to_numpy(), q))  # `measured` rows
    near = index.mapInArrow(_nearest(probes, width, k), "probe int, far double, a int, b int")
    best = near.withColumn("place", F.row_number().over(W.partitionBy("probe").orderBy("far", "a", "b"))).where(F.col("place") <= k).toPandas()  # k rows a probe
    if not len(best):
        return int(counts.sum())
    first, second = _squared(q[:, : book.half], book.first), _squared(q[:, book.half :], book.second)
    needed = []
    for probe, cells in best.groupby("probe"):
        sums = (first[probe][:, None] + second[probe]).ravel()
        by = np.argsort(sums, kind="stable")
        reached = np.empty(len(by), np.int64)
        reached[by] = np.cumsum(counts.ravel()[by])
        needed += reached[cells.a.to_numpy() * counts.shape[1] + cells.b.to_numpy()].tolist()
    return int(np.quantile(needed, recall, method="higher"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, centroids_: int = CENTROIDS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest by Euclidean distance among the other rows found.

    The dimension is the commonest one; vectors of another take no part. Equal distances go by the smaller vec_id. A repeated
    vec_id is several rows: each is a query of its own, with ranks of its own, and a candidate for the others. An empty table, or one without usable queries, gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    fine = usable(vectors)
    sizes = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width, total = sizes[0].d, sizes[0]["count"]
    fine = fine.where(F.size("v") == width)
    sample = fine.where(unit_hash(F.lit("codebook"), F.col("vec_id")) * total < SAMPLE).orderBy("vec_id").toPandas().v
    if not len(sample):  # the hash can miss every row of a tiny table
        sample = fine.orderBy("vec_id").limit(1).toPandas().v
    book = Codebook(_matrix(sample, width), centroids_)
    held = spark.sparkContext.broadcast(book)  # two arrays of `centroids_` rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = held.value.cells(_matrix(batch.column(1), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["vec_id", "v", "row", "a", "b"])

    index = cut(fine.withColumn("row", F.monotonically_increasing_id()).mapInArrow(encode, "vec_id long, v array<double>, row long, a int, b int"))
    counts = np.zeros((len(book.first), max(1, len(book.second))), np.int64)
    for r in index.groupBy("a", "b").count().toLocalIterator():  # a row for each cell at most: centroids_ squared
        counts[r.a, r.b] = r["count"]
    counted = spark.sparkContext.broadcast(counts)
    want = max(enough(index, book, counts, k, recall), min(total, k + 1))  # a query is in its own cells
    groups = -(-len(book.first) // GROUP)
    cells = GROUP * counts.shape[1]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, vectors_ = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch.column(2), width) if batch.num_rows else []
            for row, query, q in zip(rows, ids, vectors_, strict=True):
                seen = np.zeros((groups, cells), bool)
                for a, b in held.value.visit(q, counted.value, want):
                    seen[a // GROUP, a % GROUP * counts_width + b] = True
                at = np.flatnonzero(seen.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(at), pa.int64()), pa.array([query] * len(at), pa.int64()), pa.array([q] * len(at), pa.list_(pa.float64())), pa.array(at, pa.int32()), pa.array([np.packbits(seen[g]).tobytes() for g in at], pa.binary())], ["own", "query_id", "q", "g", "cells"])

    counts_width = counts.shape[1]
    queries = index.where(is_query).select("row", "vec_id", "v").repartition(max(8, spark.sparkContext.defaultParallelism), "row")
    asked = cut(queries.mapInArrow(visit, "own long, query_id long, q array<double>, g int, cells binary"))
    rows_of = {r.g: r["count"] for r in index.groupBy(F.floor(F.col("a") / GROUP).cast("int").alias("g")).count().collect()}
    asked_of = {r.g: r["count"] for r in asked.groupBy("g").count().collect()}
    row_parts, query_parts = [-(-rows_of.get(g, 0) // BLOCK_ROWS) or 1 for g in range(groups)], [-(-asked_of.get(g, 0) // QUERY_ROWS) or 1 for g in range(groups)]

    def of(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("g") + 1)

    def spread(values: list[int]) -> Column:
        return F.explode(F.sequence(F.lit(0), of(values) - 1))

    left = index.withColumn("g", F.floor(F.col("a") / GROUP).cast("int")).withColumn("x", F.pmod(F.xxhash64("row"), of(row_parts)).cast("int")).withColumn("y", spread(query_parts))
    right = asked.withColumn("y", F.pmod(F.xxhash64("own"), of(query_parts)).cast("int")).withColumn("x", spread(row_parts))

    def rerank(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, float]] = []
        if len(rows) and len(queries):
            rows = rows.sort_values(["vec_id", "row"], kind="stable")
            x, ids, own = _matrix(rows.v, width), rows.vec_id.to_numpy(), rows.row.to_numpy()
            cell = (rows.a.to_numpy() % GROUP) * counts_width + rows.b.to_numpy()
            for row, query, q, seen in zip(queries.own, queries.query_id, queries.q, queries.cells, strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(seen, np.uint8), count=cells)[cell].astype(bool) & (own != row))
                if len(at):
                    gap = x[at] - q
                    far = np.sqrt((gap * gap).sum(1))
                    best = np.argsort(far, kind="stable")[:k]
                    out += zip([row] * len(best), [query] * len(best), own[at[best]], ids[at[best]], far[best], strict=True)
        return pd.DataFrame(out, columns=["own", "query_id", "row", "vec_id", "score"]).astype({"own": "int64", "query_id": "int64", "row": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("g", "x", "y").cogroup(right.groupBy("g", "x", "y")).applyInPandas(rerank, "own long, query_id long, row long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("own").orderBy("score", "vec_id", "row")).cast("int")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
