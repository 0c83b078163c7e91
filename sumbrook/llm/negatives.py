"""Hard negatives by a dual-tree search: candidates near an anchor in inner product, but of another label.

Anchors and candidates each stand in a tree of boxes and balls. A pair of nodes has an interval that holds every inner product of
their rows; if it lies outside what every request of the anchor node still wants, all of them are done with that candidate node.
Pairs of leaves are scored exactly. The trees' upper nodes follow one space partition fitted on a bounded sample: pairs of top nodes
are judged on the driver, pairs of blocks in Spark tasks, and inside a pair of blocks the trees go on in the task.

A request is an anchor with a range of scores: the k best candidates in it are wanted. The first search wants positives, the
second the negatives of each positive. Before a search each request is scored against one block, its own place's, so
that pruning begins with a known k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, small_batches, unit_hash

#: Rows that the space partition is fitted on, in expectation.
SAMPLE = 16_384
#: Candidates of a block, about: a share of the table between these. Anchors of a block; rows of a leaf inside a task.
BLOCK_ROWS = (256, 8192)
BLOCKS = 64
BLOCK_ANCHORS = 512
#: Tasks that score pairs of blocks, at most.
MOST_TASKS = 1 << 14
LEAF = 128
#: Levels of the space partition, and of its top, at most: 1024 leaves, 64 top nodes.
LEVELS = 10
TOP = 6
SEED = 11
FAR = 1 << 62  # beyond every score


# --- nodes


class Node:
    """Rows `at` of a matrix with their box, the ball around its centre and their least and largest label."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, at: np.ndarray):
        own, named = x[at], labels[at]
        self.at, self.children = at, ()
        self.low, self.high = own.min(0), own.max(0)
        self.ball()
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(1).max()))
        self.labels = int(named.min()), int(named.max())

    def ball(self) -> None:
        self.centre = (self.low + self.high) / 2
        self.length = float(np.sqrt((self.centre**2).sum()))


def grow(x: np.ndarray, labels: np.ndarray) -> Node:
    """The tree over the rows of x: nodes are halved at the median of their widest dimension, down to LEAF rows."""
    root = Node(x, labels, np.arange(len(x)))
    stack = [root]
    while stack:
        node = stack.pop()
        widest = int((node.high - node.low).argmax()) if x.shape[1] else -1
        if len(node.at) > LEAF and widest >= 0 and node.high[widest] > node.low[widest]:
            by = node.at[np.argsort(x[node.at, widest], kind="stable")]
            node.children = tuple(Node(x, labels, part) for part in (by[: len(by) // 2], by[len(by) // 2 :]))
            stack += node.children
    return root


def interval(a: Node, b: Node) -> tuple[float, float]:
    """Bounds of the inner products of a row of a and a row of b, by boxes and by balls, wider than rounding."""
    products = np.stack((a.low * b.low, a.low * b.high, a.high * b.low, a.high * b.high))
    least, most = float(products.min(0).sum()), float(products.max(0).sum())
    middle = float(a.centre @ b.centre)
    reach = a.radius * b.length + b.radius * a.length + a.radius * b.radius
    slack = 1 + 1e-9 * float(np.abs(products).max(0).sum())
    return max(least, middle - reach) - slack, min(most, middle + reach) + slack


def apart(a: Node, b: Node, same: bool) -> bool:
    """Whether no row of a and row of b have the same label (same) or different ones (not same)."""
    if same:
        return a.labels[1] < b.labels[0] or b.labels[1] < a.labels[0]
    return a.labels[0] == a.labels[1] == b.labels[0] == b.labels[1]


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by doubles if no sum can leave their whole numbers."""
    if not x.size or not y.size or np.abs(x).max() * np.abs(y).max() * x.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


# --- the search in one pair of blocks


class Requests:
    """Requests of one block: arrays of anchor rows, and for each request its anchor, range, k-th best score and finds so far."""

    def __init__(self, table: pa.Table, width: int):
        rows, first, self.anchor = np.unique(_numbers(table, "row"), return_index=True, return_inverse=True)
        self.x = _matrix(table, width)[first]
        self.rows, self.labels = rows, _numbers(table, "label")[first]
        self.low, self.high = _numbers(table, "low"), _numbers(table, "high")
        self.floor = np.maximum(_numbers(table, "floor"), self.low) if "floor" in table.column_names else self.low.copy()
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in range(table.num_rows)]
        by = np.argsort(self.anchor, kind="stable")
        self.of = np.split(by, np.cumsum(np.bincount(self.anchor, minlength=len(rows)))[:-1]) if len(rows) else []


def search_block(asked: Requests, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int) -> int:
    """Adds to asked.best the (minus score, id, row) of the k best candidates in range for each request; returns the pairs of rows scored."""
    if not len(x) or not len(asked.rows):
        return 0
    scored = 0
    stack = [(grow(asked.x, asked.labels), grow(x, labels))]
    while stack:
        a, b = stack.pop()
        if apart(a, b, same):
            continue
        least, most = interval(a, b)
        wanting = np.concatenate([asked.of[i] for i in a.at])
        wanting = wanting[(asked.floor[wanting] <= most) & (asked.high[wanting] >= least)]
        if not len(wanting):
            continue  # none of the anchors wants anything there
        if a.children and (not b.children or len(a.at) > len(b.at)):
            stack += [(part, b) for part in a.children]
        elif b.children:
            stack += sorted(((a, part) for part in b.children), key=lambda p: float(a.centre @ p[1].centre))  # the higher scores first
        else:
            anchors, own = np.unique(asked.anchor[wanting], return_inverse=True)
            scores = inner(asked.x[anchors], x[b.at])
            scored += scores.size
            match = (asked.labels[anchors][:, None] == labels[b.at]) == same
            match &= asked.rows[anchors][:, None] != rows[b.at]
            told = scores[own]
            fit = match[own] & (told >= asked.floor[wanting][:, None]) & (told <= asked.high[wanting][:, None])
            for i in np.flatnonzero(fit.any(1)):
                at = np.flatnonzero(fit[i])
                if len(at) > k:
                    at = at[np.lexsort((rows[b.at[at]], ids[b.at[at]], -told[i][at]))[:k]]
                r = wanting[i]
                held = sorted(asked.best[r] + list(zip((-told[i][at]).tolist(), ids[b.at[at]].tolist(), rows[b.at[at]].tolist(), strict=True)))[:k]
                asked.best[r] = held
                if len(held) == k:
                    asked.floor[r] = max(asked.floor[r], -held[-1][0])
    return scored


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, width)


def _ids(table: pa.Table) -> np.ndarray:
    """vec_id, where null comes last among ties."""
    return table.column("vec_id").combine_chunks().fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)


def _seed(width: int, same: bool, k: int):
    """The requests with `floor`: the score of the k-th best candidate in their home block, or the lowest one wanted."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        own = Requests(asked, width)
        search_block(own, _matrix(held, width), _numbers(held, "row"), _ids(held), _numbers(held, "label"), same, k)
        return asked.append_column("floor", pa.array(own.floor))

    return run


def _found(width: int, same: bool, k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        own, rows = Requests(asked, width), _numbers(held, "row")
        search_block(own, _matrix(held, width), rows, _ids(held), _numbers(held, "label"), same, k)
        which = [i for i, best in enumerate(own.best) for _ in best]
        best = [b for best in own.best for b in best]
        order = np.argsort(rows, kind="stable")
        at = order[np.searchsorted(rows[order], [row for _, _, row in best])] if best else []
        return pa.table({"request": asked.column("request").combine_chunks().take(pa.array(which, pa.int64())), "score": pa.array([-s for s, _, _ in best], pa.int64()), "vec_id": held.column("vec_id").combine_chunks().take(pa.array(at, pa.int64())), "found": pa.array([row for _, _, row in best], pa.int64())})

    return run


# --- upper nodes

SUMMARY = "node int, top int, low array<double>, high array<double>, radius double, first long, last long, wants long, most long"


def _summary(width: int, requests: bool):
    """A block's node as a row; of requests also the least score that one wants and the largest that one takes."""

    def run(table: pa.Table) -> pa.Table:
        node = Node(_matrix(table, width), _numbers(table, "label"), np.arange(table.num_rows))
        wants, most = (int(_numbers(table, "floor").min()), int(_numbers(table, "high").max())) if requests else (-FAR, FAR)
        block, top = (table.column(c)[0].as_py() for c in ("block", "top"))
        return pa.table({"node": pa.array([block], pa.int32()), "top": pa.array([top], pa.int32()), "low": [node.low.tolist()], "high": [node.high.tolist()], "radius": [node.radius], "first": [node.labels[0]], "last": [node.labels[1]], "wants": [wants], "most": [most]})

    return run


class Told(Node):
    """A node from its row."""

    def __init__(self, row: dict):
        self.low, self.high = np.array(row["low"], float), np.array(row["high"], float)
        self.ball()
        self.radius, self.labels, self.wants, self.most = row["radius"], (row["first"], row["last"]), row["wants"], row["most"]


def _united(width: int):
    """The node above the blocks of one top."""

    def run(table: pa.Table) -> pa.Table:
        nodes = [Told(r) for r in table.to_pylist()]
        low, high = np.min([n.low for n in nodes], 0), np.max([n.high for n in nodes], 0)
        centre = (low + high) / 2
        radius = max(n.radius + float(np.sqrt(((n.centre - centre) ** 2).sum())) for n in nodes)
        top = table.column("top")[0].as_py()
        return pa.table({"node": pa.array([top], pa.int32()), "top": pa.array([top], pa.int32()), "low": [low.tolist()], "high": [high.tolist()], "radius": [radius], "first": [min(n.labels[0] for n in nodes)], "last": [max(n.labels[1] for n in nodes)], "wants": [min(n.wants for n in nodes)], "most": [max(n.most for n in nodes)]})

    return run


def meets(a: Told, b: Told, same: bool) -> bool:
    """Whether a request in a may want a row in b."""
    if apart(a, b, same):
        return False
    least, most = interval(a, b)
    return most >= a.wants and least <= a.most


def _meeting(same: bool):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        right = [(r["node"], Told(r)) for r in held.to_pylist()]
        pairs = [(r["node"], node) for r in asked.to_pylist() for a in (Told(r),) for node, b in right if meets(a, b, same)]
        return pa.table({"asks": pa.array([a for a, _ in pairs], pa.int32()), "block": pa.array([b for _, b in pairs], pa.int32())})

    return run


class Partition:
    """Medians of the widest dimensions of a sample, `levels` deep, in the order of a heap."""

    def __init__(self, x: np.ndarray, levels: int):
        self.levels = levels
        self.dims, self.cuts = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        held = {0: x}
        for node in range((1 << levels) - 1):
            own = held.pop(node)
            if len(own):
                self.dims[node] = dim = int((own.max(0) - own.min(0)).argmax())
                self.cuts[node] = np.median(own[:, dim])
            over = own[:, self.dims[node]] > self.cuts[node] if len(own) else np.zeros(0, bool)
            held[2 * node + 1], held[2 * node + 2] = own[~over], own[over]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - ((1 << self.levels) - 1)


# --- tables


def whole_vectors(vectors: DataFrame, times: int = 256) -> DataFrame:
    """vec_id, label, v: the rows that take part, each component x as floor(times * x).

    Rows with a null label, a null vector, or a null or non-finite component don't; nor do vectors of another dimension than the
    commonest one (ties: the smaller), or with a component so large that an inner product could leave 64 bits, since they have no score.
    """
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * times))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where("label is not null and embedding is not null").where(fine)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    width = sizes[0].d if sizes else 0
    most = min(isqrt((1 << 61) // max(1, width)), (1 << 31) - 1)
    fitting = F.forall("embedding", lambda x: F.floor(x.cast("double") * times).between(-most, most))
    return rows.where(F.size("embedding") == width).where(fitting).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.cast("array<int>").alias("v"))


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


class Index:
    """Candidates (row, vec_id, label, v) dealt over blocks along the space partition."""

    def __init__(self, rows: DataFrame, width: int, total: int, block_rows: int | None = None, sample: int = SAMPLE):
        spark = rows.sparkSession
        block_rows = block_rows or min(max(total // BLOCKS, BLOCK_ROWS[0]), BLOCK_ROWS[1])
        levels = min(LEVELS, max(0, round(log2(max(1, total / block_rows)))))
        drawn = rows.where(unit_hash(F.lit(SEED), F.col("row")) * total < sample).select("v").toArrow() if levels else None
        parts = spark.sparkContext.broadcast(Partition(_matrix(drawn, width) if levels else np.zeros((0, width)), levels))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                yield from table.append_column("leaf", pa.array(parts.value.leaves(_matrix(table, width)), pa.int32())).to_batches()

        self.width, self.levels = width, levels
        placed = cut(rows.mapInArrow(dealt, "row long, vec_id long, label long, v array<int>, anchor boolean, leaf int"))
        held = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # 1024 rows at most
        counts = [held.get(i, 0) for i in range(1 << levels)]
        self.blocks = [max(1, round(n / block_rows)) for n in counts]
        self.begins = [sum(self.blocks[:i]) for i in range(len(self.blocks))]
        self.rows = placed.withColumn("block", self.home(F.col("row"))).withColumn("top", self.top(F.col("leaf")))
        held_summary = self.rows.select("block", "top", "label", "v").groupBy("block").applyInArrow(_summary(width, False), SUMMARY)
        self.summary = cut(held_summary)

    def home(self, row: Column) -> Column:
        """The block of a row in its leaf; a leaf of many equal vectors has many blocks."""
        return (_at(self.begins, F.col("leaf")) + F.pmod(F.xxhash64(row), _at(self.blocks, F.col("leaf")))).cast("int")

    def top(self, leaf: Column) -> Column:
        return F.shiftright(leaf, max(0, self.levels - TOP))


def search(index: Index, requests: DataFrame, anchors: int, same: bool, k: int) -> DataFrame:
    """request, place (from 1), score, vec_id, found (its row): for each request its k best candidates in range.

    requests: request, row (of the anchor itself), label, v, leaf, low, high. The candidates have the anchor's label (same) or another one; the anchor
    itself is none. Ties go by vec_id (null last), then by row. A request without candidates has no rows.
    """
    width = index.width
    held = index.rows.select("row", "vec_id", "label", "v", "block")
    sides = max(1, round(anchors / BLOCK_ANCHORS))
    levels = min(index.levels, max(0, round(log2(sides))))
    own = F.shiftright(F.col("leaf"), index.levels - levels)
    salts = max(1, round(sides / (1 << levels)))
    asked = requests.withColumn("home", index.home(F.col("request"))).withColumn("top", index.top(F.col("leaf")))
    asked = asked.withColumn("block", (F.shiftright("leaf", index.levels - levels) * salts + F.pmod(F.xxhash64("row"), F.lit(salts))).cast("int")).withColumn("top", F.shiftright(own, max(0, levels - TOP)))
    kept = "request long, row long, label long, v array<int>, low long, high long, block int, top int"
    asked = asked.select("request", "row", "label", "v", "low", "high", "block", "top", "home")
    seeded = cut(asked.groupBy("home").cogroup(held.groupBy("block")).applyInArrow(_seed(width, same, k), f"{kept}, home int, floor long"))
    summary = cut(seeded.groupBy("block").applyInArrow(_summary(width, True), SUMMARY))
    tops = [[(r.node, Told(r.asDict())) for r in s.groupBy("top").applyInArrow(_united(width), SUMMARY).collect()] for s in (summary, index.summary)]  # 64 rows each
    meeting = [(a, b) for a, x in tops[0] for b, y in tops[1] if meets(x, y, same)]
    spark = index.rows.sparkSession
    left = summary.join(F.broadcast(spark.createDataFrame(meeting, "top int, held_top int")), "top")
    right = index.summary.join(F.broadcast(spark.createDataFrame(meeting, "asked_top int, top int")), "top")
    pairs = cut(left.groupBy("top", "held_top").cogroup(right.groupBy("asked_top", "top")).applyInArrow(_meeting(same), "asks int, block int"))
    asking = seeded.withColumnRenamed("block", "asks").join(pairs, "asks").select("asks", "block", "request", "row", "label", "v", "low", "high", "floor")
    holding = held.join(pairs, "block").select("asks", "block", "row", "vec_id", "label", "v")
    # few bytes but much work: the number of pairs decides how many tasks there are
    tasks = min(MOST_TASKS, max(1, pairs.count()))
    asking, holding = (side.repartition(tasks, "asks", "block") for side in (asking, holding))
    found = asking.groupBy("asks", "block").cogroup(holding.groupBy("asks", "block")).applyInArrow(_found(width, same, k), "request long, score long, vec_id long, found long")
    place = F.row_number().over(W.partitionBy("request").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")).cast("int")
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    vectors: vec_id, label, v (whole numbers), as `whole_vectors` gives them. An anchor's positives are the first `positives` other rows of its label by
    inner product; the negatives of a positive are the first `negatives` rows of another label whose score lies from
    `low` to `high` percent of the positive's. Higher scores come first, ties by smaller vec_id (null last). Repeated rows
    are rows of their own, as candidates and as anchors. Positives without negatives, and empty tables, give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    marked = vectors.select("vec_id", "label", "v", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = cut(marked.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v", "anchor"))
    total, anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    if not anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index(rows, width, total, block_rows=block_rows)
    asking = index.rows.where("anchor").select("row", "vec_id", "label", "v", "leaf")
    every = asking.select(F.col("row").alias("request"), "row", "label", "v", "leaf", F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    best = search(index, every, anchors, True, positives)
    part = lambda percent: F.col("score").cast("decimal(20,0)") * F.lit(Decimal(percent) / 100)
    told = asking.withColumnRenamed("vec_id", "anchor_id").join(best.select(F.col("request").alias("row"), "place", "score", F.col("vec_id").alias("positive_id")), "row")
    ranged = told.withColumns({"low": F.ceil(part(low)).cast("long"), "high": F.floor(part(high)).cast("long"), "request": F.col("row") * positives + F.col("place") - 1})
    wanted = cut(ranged.where("low <= high"))
    hard = search(index, wanted.select("request", "row", "label", "v", "leaf", "low", "high"), anchors, False, negatives)
    named = wanted.select("request", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return hard.join(named, "request").select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
