"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. All copies of a text that are in one shard are one entry (group, shard, count),
so a round of propagation joins entries, not documents, and a group of any size has 40 of them at most. In each round
an entry moves towards the shard that holds most of its group (a group too large for one shard has several such
homes), as far as the shard's quota admits. Documents without
a link cut no edge wherever they are: they fill what is left. The law kept is `rows`: counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, cut, join_hot, running

SHARDS = 40
ROUNDS = 8


def _array(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def _at(values: list[int], shard: str) -> Column:
    return F.element_at(_array(values), F.col(shard) + 1)


def _sums(df: DataFrame, by: str, what: str, shards: int) -> list[int]:
    """A sum for each shard; one row for each comes to the driver."""
    found = {r[0]: r[1] for r in df.groupBy(by).agg(F.sum(what)).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _round(entries: DataFrame, quota: list[int], settled: list[int], salts: int) -> tuple[DataFrame, list[int], int]:
    """One round: entries after it, the settled documents of each shard, how many documents moved."""
    shards = len(quota)
    # a group's homes are the shards that hold most of it, as many as it needs to fit into what others leave free
    spare = [max(0, q - s) for q, s in zip(quota, settled, strict=True)]
    by_count = W.partitionBy("g").orderBy(F.desc("n"), "shard")
    ranked = entries.withColumn("open", _at(spare, "shard")).withColumn("_of", F.sum("n").over(W.partitionBy("g"))).where("open > 0")
    filled = F.coalesce(F.sum("open").over(by_count.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = ranked.withColumn("home", filled < F.col("_of"))
    end = F.sum(F.when(F.col("home"), F.greatest(F.col("open") - F.col("n"), F.lit(0))).otherwise(0)).over(by_count.rowsBetween(W.unboundedPreceding, 0))
    homes = marked.withColumn("end", end).where("home").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("end", (-F.col("n")).alias("minus"), "shard"))).alias("homes"))  # a shard each
    other = entries.join(homes, "g").where(~F.exists("homes", lambda h: h.shard == F.col("shard")))
    offset = F.coalesce(F.sum("n").over(by_count.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fits = other.withColumn("_at", offset).withColumn("_h", F.filter("homes", lambda h: h.end > F.col("_at"))).where("size(_h) > 0").withColumn("_h", F.col("_h")[0])
    wants = cut(fits.select("g", "shard", "n", F.col("_h.shard").alias("to"), (-F.col("_h.minus")).alias("best_n")).where("n <= best_n"))
    load, leaving = _sums(entries, "shard", "n", shards), _sums(wants, "shard", "n", shards)
    if not sum(leaving):
        return entries, settled, 0
    settled = [a - b for a, b in zip(load, leaving, strict=True)]
    room = [max(0, q - s) for q, s in zip(quota, settled, strict=True)]
    # those of the largest groups go first, by the power of two of their number; no task has to see all that want to go there
    fine = salts // 64 + 1
    order = (F.lit(63) - F.floor(F.log2("best_n"))) * fine + F.pmod(F.xxhash64("g"), F.lit(fine))
    queued = running(wants, ["to"], order, [F.desc("best_n"), F.col("g"), F.col("shard")], F.col("n"), "before", 64 * fine)
    moved = queued.withColumn("go", F.greatest(F.least(_at(room, "to") - F.col("before"), F.col("n")), F.lit(0))).where("go > 0").select("g", "shard", "to", "go")
    changes = moved.select("g", "shard", (-F.col("go")).alias("n")).union(moved.select("g", F.col("to").alias("shard"), F.col("go").alias("n")))
    after = cut(entries.union(changes).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return after, settled, _moved(entries, after)


def _moved(before: DataFrame, after: DataFrame) -> int:
    squares = [df.agg(F.coalesce(F.sum(F.col("n").cast("decimal(38,0)") * F.col("n")), F.lit(0))).first()[0] for df in (before, after)]
    return int(squares[1] - squares[0])


def assign(marked: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add `shard` to marked, whose column g (never null) says which documents are linked, and whose column `_turn` is a hash of the document."""
    total = marked.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    salts = buckets_for(total)
    first = marked.select("g", F.pmod("_turn", F.lit(shards)).cast("int").alias("shard")).groupBy("g", "shard").agg(F.count("*").alias("n"))
    # at most `shards` rows for each g
    entries = cut(first.withColumn("_of", F.sum("n").over(W.partitionBy("g"))).where("_of > 1").drop("_of"))
    settled = [0] * shards
    for _ in range(rounds):
        entries, settled, moved = _round(entries, quota, settled, salts)
        if not moved:
            break
    held = running(entries, ["shard"], F.xxhash64("g"), [F.desc("n"), F.col("g")], F.col("n"), "_before", salts)
    held = cut(held.withColumn("keep", F.greatest(F.least(_at(quota, "shard") - F.col("_before"), F.col("n")), F.lit(0))).select("g", "shard", "n", "keep"))
    inside = W.partitionBy("g").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    spans = held.withColumn("low", F.coalesce(F.sum("keep").over(inside), F.lit(0)))
    groups = spans.groupBy("g").agg(F.sum("keep").alias("_kept"), F.sum("n").alias("_n"), F.collect_list(F.when(F.col("keep") > 0, F.struct("low", (F.col("low") + F.col("keep")).alias("high"), "shard"))).alias("_spans"))
    # the rest of a group that has no room is handed out together: its place in the pool goes on from the groups before
    groups = running(groups.withColumn("_all", F.lit(0)), ["_all"], F.xxhash64("g"), [F.col("g")], F.col("_n") - F.col("_kept"), "_pool", salts).drop("_all")
    kept = _sums(held, "shard", "keep", shards)
    rest = sum(_sums(held, "shard", "n", shards)) - sum(kept)
    room, ends = [q - k for q, k in zip(quota, kept, strict=True)], []
    for r in room:
        ends.append((ends or [0])[-1] + r)
    joined = cut(join_hot(marked, groups.withColumn("_held", F.col("_n")), "g", "_held", total, "left"))
    linked = running(joined.where("_n is not null"), ["g"], F.col("_turn"), [F.col("_turn"), F.col("doc_id")], F.lit(1), "_rank", salts)
    single = running(joined.where("_n is null").withColumn("_all", F.lit(0)), ["_all"], F.col("_turn"), [F.col("_turn"), F.col("doc_id")], F.lit(1), "_rank", salts).drop("_all")
    pool = F.when(F.col("_n").isNull(), F.col("_rank") + rest).otherwise(F.col("_pool") + F.col("_rank") - F.col("_kept"))
    own = F.filter("_spans", lambda s: (s.low <= F.col("_rank")) & (F.col("_rank") < s.high))[0]["shard"]
    free = F.size(F.filter(_array(ends), lambda e: e <= F.col("_place"))).cast("int")
    every = linked.unionByName(single).withColumn("_place", pool).withColumn("_own", own)
    placed = every.withColumn("shard", F.when(F.col("_n").isNotNull() & (F.col("_rank") < F.col("_kept")), F.col("_own")).otherwise(free))
    return placed.drop("_kept", "_n", "_spans", "_pool", "_rank", "_place", "_own")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    size is the text's bytes plus 16; a null text has no bytes (its crc32 is that of nothing, 0), and null texts are
    linked with each other. Repeated rows are documents of their own, which equal texts link. Each shard's rows have
    the slots 0, 1, 2 and on. No documents give no rows. Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    link = F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit("second"), F.col("text"))), F.lit(" "), F.octet_length("text").cast("string"))
    marked = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(link, F.lit("null")).alias("g")).withColumn("_turn", F.xxhash64(F.lit("shard"), F.col("doc_id").cast("string"), F.col("g"))))
    placed = cut(assign(marked, shards, rounds))
    slotted = running(placed, ["shard"], F.col("_turn"), [F.col("_turn"), F.col("doc_id")], F.lit(1), "slot", buckets_for(marked.count()))
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
