"""Exact search for many queries at once: blocked matrix products over an index that keeps its norms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import AnalyticsError
from .retrieval import MIN_SCORE, TOP

#: Queries that are broadcast together; more are answered in several passes. Index rows of one product.
QUERY_BLOCK = 8192
INDEX_ROWS = 4096


def with_norms(index: DataFrame, key: str, embedding: str = "embedding", scope: Column | None = None) -> DataFrame:
    """key, scope, v (doubles), norm: the index as it is searched; keep it as a table, so that no search computes a norm again.

    Rows without a vector, or with a missing or non-finite component, are left out. Without a scope all rows are in the scope "".
    """
    v = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    scoped = F.coalesce((scope if scope is not None else F.lit("")).cast("string"), F.lit(""))
    return index.select(F.col(key).cast("long").alias("key"), scoped.alias("scope"), v.alias("v")).where(fine).withColumn("norm", norm)


class _Best:
    """The k best rows of each query in one scope, by score, then key."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.keys = k, np.full((queries, 0), -np.inf), np.zeros((queries, 0), np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.hstack((self.scores, scores)), np.hstack((self.keys, np.broadcast_to(keys, scores.shape)))
        at = np.lexsort((keys, -scores), axis=1)[:, : self.k]
        self.scores, self.keys = np.take_along_axis(scores, at, 1), np.take_along_axis(keys, at, 1)


def _searched(held, k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, norms, scopes = held.value
        best: dict[str, _Best] = {}
        asked = {s: np.flatnonzero((scopes == s) | (scopes == "")) for s in set(scopes.tolist())}
        everywhere = np.flatnonzero(scopes == "")
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(at, INDEX_ROWS)
                keys, v, norm = part.column(0).to_numpy(), part.column(2).flatten().to_numpy().reshape(part.num_rows, width), part.column(3).to_numpy()
                in_scope = np.array(part.column(1).to_pylist(), object)
                for s in set(in_scope.tolist()):
                    who, rows = asked.get(s, everywhere), np.flatnonzero(in_scope == s)
                    if len(who):
                        lengths = norms[who][:, None] * norm[rows]
                        cosines = np.divide(q[who] @ v[rows].T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
                        if s not in best:
                            best[s] = _Best(len(who), k)
                        best[s].add(np.round(cosines, 4) + 0.0, keys[rows])
        for s, found in best.items():
            who, place = np.nonzero(np.isfinite(found.scores))
            of = asked.get(s, everywhere)[who]
            yield pa.RecordBatch.from_arrays([pa.array(ids[of], pa.int64()), pa.array([s] * len(of), pa.string()), pa.array(found.keys[who, place]), pa.array(found.scores[who, place])], ["query", "scope", "key", "score"])

    return run


def search_many(index: DataFrame, queries: DataFrame, k: int = TOP, min_score: float = MIN_SCORE["offline"]) -> DataFrame:
    """query, scope, rank, key, score, relevant: the k best rows for each query in each scope that it asks for, ties to the smaller key.

    index and queries are tables of `with_norms`; a query of scope "" is asked in every scope of its own. A task keeps k rows for each query
    and scope whatever it reads, and these meet once; the index is neither sorted nor shuffled. The driver holds the queries' vectors
    QUERY_BLOCK at a time. Queries of another dimension than the index have no rows; keys of queries should be unique.
    """
    if k < 1:
        raise AnalyticsError("k must be at least 1.")
    spark = index.sparkSession
    schema = "query long, scope string, key long, score double"
    first = index.select(F.size("v").alias("d")).first()
    width = first.d if first else 0
    asked = queries.where(F.size("v") == width).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK)))))
    rows = index.where(F.size("v") == width).select("key", "scope", "v", "norm")
    parts = [spark.createDataFrame([], schema)]
    for block in sorted(r.block for r in asked.select("block").distinct().collect()):
        own = asked.where(F.col("block") == block).orderBy("key").toPandas()
        q = np.stack(own.v.to_numpy()).astype(np.float64).reshape(len(own), width)
        held = spark.sparkContext.broadcast((own["key"].to_numpy(np.int64), q, own["norm"].to_numpy(np.float64), own["scope"].to_numpy(object)))  # about QUERY_BLOCK vectors
        parts.append(rows.mapInArrow(_searched(held, k, width), schema))
    found = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(W.partitionBy("query", "scope").orderBy(F.desc("score"), "key")).cast("int")
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query", "scope", "rank", "key", "score", (F.col("score") >= min_score).alias("relevant"))
