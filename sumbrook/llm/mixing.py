"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a pseudorandom order, are one stream of words that is packed into blocks of fixed length.
Every output shard draws how many of its slots each source gets: a multinomial draw under the condition that the
sources' totals are exact, made by dealing one ticket for each slot through a pseudorandom permutation. A shard's
slots of a source are numbered on from those of the shards before it; a slot's number within its source is mapped to a
block by the source's own index permutation, and blocks and slots are joined by that index.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import buckets_for, cut, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 256
SLOTS_PER_SHARD = 4096
WORD = r"[^\x20\x09-\x0D]"
WORDS = WORD + "+"
#: Slots made by one row before the next split, and documents for which a task makes slots.
_STEP = 1 << 16
ROWS_PER_TASK = 10_000


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1, chosen by the key columns.

    n = a * b + rest. Two Feistel steps on the mixed radix (a, b) permute the first a * b numbers, the rest stays; then
    all are turned by half, and the same is done once more with other keys, so the rest moves too.
    """

    def one(x: Column, salt: str) -> Column:
        def step(s: Column) -> Column:
            high = (s.high + F.pmod(F.xxhash64(s.low, F.lit(salt), *key), s.a)) % s.a
            return let(F.struct(high.alias("high"), s.low.alias("low")), lambda t: t.high * s.b + (t.low + F.pmod(F.xxhash64(t.high, F.lit(salt + "low"), *key), s.b)) % s.b)

        def radix(s: Column) -> Column:
            return let(F.struct(s.x.alias("x"), s.a.alias("a"), F.floor(n / s.a).cast("long").alias("b")), lambda s: F.when(s.x < s.a * s.b, let(F.struct(F.floor(s.x / s.b).cast("long").alias("high"), (s.x % s.b).alias("low"), s.a.alias("a"), s.b.alias("b")), step)).otherwise(s.x))

        return let(F.struct(x.alias("x"), F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("long"), F.lit(1)).alias("a")), radix)

    return one((one(i, "one") + F.floor(n / 2).cast("long")) % n, "two")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_key, source, source_size, target of each source of sizes (_key, source, size).

    Targets rise with the weights up to `most` times the source; in order of that limit over the weight, the first
    source that the common level of those from it on does not fill sets the level. The windows hold a row for each source.
    """
    per = sizes.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("_limit", most * F.col("source_size")).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    order = W.orderBy("_ratio", "_key")
    every = W.partitionBy(F.lit(0))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    found = limited.withColumn("_level", level).withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_key", "_level"))).over(every))
    return found.select("_key", "source", "source_size", F.coalesce(F.least(F.col("_limit"), F.col("_w") * F.col("_first._level")), F.col("_limit")).alias("target"))


def _numbered(rows: DataFrame, count: str, out: str, parts: int) -> DataFrame:
    """Each row `count` times, numbered from 0 as `out`."""
    steps = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(_STEP).cast("long")))).repartition(parts, *(c for c in ("_key", "shard", "_from") if c in [*rows.columns, "_from"]))
    return steps.withColumn(out, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (_STEP - 1), F.col(count) - 1)))).drop("_from")


def wanted(sources: DataFrame, block: int) -> DataFrame:
    """_key, source_size, taken, slots, begin of each source that is taken: its words and slots in the mix, and the slots before its own.

    A source's slots are those of its first pass, which takes each block once, then those of the second.
    """
    taken = F.round("target").cast("long")
    first = F.least(taken, F.col("source_size"))
    per = sources.select("_key", "source_size", taken.alias("taken"), F.ceil(first / block).cast("long").alias("first_slots"), (taken - first).alias("_more"))
    per = per.where("taken > 0").withColumn("slots", F.col("first_slots") + F.ceil(F.col("_more") / block).cast("long")).drop("_more")
    return per.withColumn("begin", F.coalesce(F.sum("slots").over(W.orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each source


def draw(wants: DataFrame, seed: int, parts: int) -> DataFrame:
    """_key, shard, count, before: the slots that each output shard draws of each source, and those of the shards before it."""
    total = wants.agg(F.sum("slots")).first()[0] or 0
    tickets = _numbered(wants.select("_key", "begin", "slots"), "slots", "_ticket", parts)
    dealt = permuted(F.col("begin") + F.col("_ticket"), F.lit(total).cast("long"), F.lit("slots"), F.lit(seed))
    counts = tickets.select("_key", F.floor(dealt / SLOTS_PER_SHARD).cast("long").alias("shard")).groupBy("_key", "shard").agg(F.count("*").alias("count"))
    wide = max(1, isqrt(total // SLOTS_PER_SHARD))
    return running(counts, ["_key"], F.floor(F.col("shard") / wide), [F.col("shard")], F.col("count"), "before", total // SLOTS_PER_SHARD // wide + 1)


def _slots(wants: DataFrame, drawn: DataFrame, block: int, seed: int, parts: int) -> DataFrame:
    """_key, block, shard, position, words of each slot of the shards' draws. The ragged last block of a source comes last in a pass."""
    in_shard = W.partitionBy("shard")  # a row for each source
    placed = drawn.withColumn("_base", F.sum("count").over(in_shard.orderBy("_key").rowsBetween(W.unboundedPreceding, -1))).withColumn("_all", F.sum("count").over(in_shard))
    one = _numbered(placed.join(wants, "_key"), "count", "_i", parts)
    number = permuted(F.col("before") + F.col("_i"), F.col("slots"), F.col("_key"), F.lit(seed))
    one = one.withColumn("_number", number)
    epoch = (F.col("_number") >= F.col("first_slots")).cast("long")
    k, want = F.col("_number") - epoch * F.col("first_slots"), F.when(epoch == 0, F.least("taken", "source_size")).otherwise(F.col("taken") - F.col("source_size"))
    full = F.floor(F.col("source_size") / block).cast("long")
    # a whole pass has every block; the blocks of one that is cut short are chosen by one more permutation
    index = F.when((k < full) & (want < F.col("source_size")), permuted(k, F.greatest(full, F.lit(1)), F.col("_key"), epoch, F.lit(seed))).otherwise(k)
    position = permuted(F.coalesce("_base", F.lit(0)) + F.col("_i"), F.col("_all"), F.col("shard"), F.lit("position"), F.lit(seed))
    return one.select("_key", index.alias("block"), "shard", position.alias("position"), F.least(F.lit(block).cast("long"), want - k * block).alias("words"))


def plan_mix(docs: DataFrame, block: int = BLOCK, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed documents (doc_id, size, _key, start), the sources' targets and the slots of the mix."""
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")).withColumn("_key", source_key(F.col("source"))))
    rows = sized.count()
    sources, parts = cut(targets(sized.select("_key", "source", "size"))), max(1, rows // ROWS_PER_TASK)
    turn = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    placed = running(sized.where("size > 0"), ["_key"], turn, [turn, F.col("doc_id"), F.col("size")], F.col("size"), "start", buckets_for(rows))
    none = sized.where("size = 0").withColumn("start", F.lit(None).cast("long"))
    wants = cut(wanted(sources, block))
    drawn = cut(draw(wants, seed, parts))
    return placed.unionByName(none).select("doc_id", "size", "_key", "start"), sources, _slots(wants, drawn, block, seed, parts)


def packed(placed: DataFrame, sources: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, shard, position, block, words, spans of each slot of the mix that plan_mix planned.

    spans are the block's words in order, as far as the slot takes them: doc_id, start (of the document in its source's
    stream), and begin and end (counted in the document's words).
    """
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    met = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0).cast("long"))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    blocks = met.groupBy("_key", "block").agg(F.array_sort(F.collect_list(F.struct(low.alias("low"), high.alias("high"), "start", "doc_id"))).alias("held"))  # `block` spans at most
    dealt = slots.hint("merge").join(blocks, ["_key", "block"])  # both sides grow with the documents
    begun = F.filter("held", lambda h: h.low < F.col("words"))

    def span(h: Column) -> Column:
        at = F.col("block") * block - h.start
        return F.struct(h.doc_id.alias("doc_id"), h.start.alias("start"), (at + h.low).alias("begin"), (at + F.least(h.high, F.col("words"))).alias("end"))

    return dealt.join(sources.select("_key", "source"), "_key").select("source", "shard", "position", "block", "words", F.transform(begun, span).alias("spans"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row: how many of its words the packed slots hold, repeats counted.

    A source's taken words are its target rounded; none is taken more than twice. Null and blank texts have no words
    and are never taken. A null source is a source, the last one. Repeated rows are documents of their own. Equal seeds
    give equal mixes. Columns other than doc_id, source and text are not read. No documents give no rows.
    """
    placed, sources, slots = plan_mix(docs, block, seed)
    placed = cut(placed)
    dealt = cut(packed(placed, sources, slots, block))
    used = dealt.select(source_key(F.col("source")).alias("_key"), F.inline("spans")).groupBy("_key", "start").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    every = placed.join(used.hint("merge"), ["_key", "start"], "left")  # a start is one document's; rows without words have none
    return every.join(sources.select("_key", "source_size", "target"), "_key").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _reach(docs: DataFrame, sources: DataFrame, rows: int, seed: int) -> DataFrame:
    """_key, source_size, target in documents of each source that is taken: how many draws of its index permutation meet its target in words.

    docs: `rows` rows of _key, _index, _words. A whole pass has every document. The one that is cut short goes as far as documents lie by half or more in the words left.
    """
    goal = F.round("target").cast("long")
    goals = sources.select("_key", F.floor(goal / F.col("source_size")).cast("long").alias("_whole"), (goal % F.col("source_size")).alias("_left"))
    held = goals.join(docs.groupBy("_key").agg(F.count("*").alias("_held")), "_key")
    # the permutation of _slots for the same pass: a place in the pass and the document that it draws
    drawn = docs.select("_key", F.col("_index").alias("_place")).join(held, "_key").select("_key", "_place", permuted(F.col("_place"), F.col("_held"), F.col("_key"), F.col("_whole"), F.lit(seed)).alias("_index"))
    passed = drawn.hint("merge").join(docs, ["_key", "_index"])  # both sides grow with the documents
    wide = isqrt(rows) + 1
    reached = running(passed, ["_key"], F.floor(F.col("_place") / wide), [F.col("_place")], F.col("_words"), "_start", rows // wide + 1)
    more = reached.join(goals, "_key").where(2 * F.col("_start") + F.col("_words") <= 2 * F.col("_left")).groupBy("_key").agg(F.count("*").alias("_more"))
    return held.join(more, "_key", "left").select("_key", F.col("_held").alias("source_size"), (F.col("_whole") * F.col("_held") + F.coalesce("_more", F.lit(0))).alias("target"))


def mixed_slots(docs: DataFrame, seed: int = 1) -> DataFrame:
    """shard, position and the columns of docs, as c0, c1 and so on, of each slot of a mix of whole documents.

    The operator's own draw over blocks of one document: the shards' draws number the slots of a source, and its index permutation maps the
    numbers to documents. Every source's words meet its target to half a document; see `mixed_documents`.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, (doc_id, source, text) = docs.toDF(*names), (F.col(names[[c.lower() for c in docs.columns].index(c)]) for c in ("doc_id", "source", "text"))
    turn = F.xxhash64(F.lit(seed), doc_id.cast("string"), source.cast("string"), text)
    sized = own.where(text.rlike(WORD)).withColumns({"_words": F.regexp_count(text, F.lit(WORDS)).cast("long"), "_key": source_key(source), "_turn": turn, "_row": F.monotonically_increasing_id()})
    sized = cut(sized)  # a row's number is fixed here; texts travel once, when all is drawn
    rows = sized.count()
    narrow = sized.select("_row", "_key", "_words", "_turn", doc_id.alias("_doc"))
    listed = cut(running(narrow, ["_key"], F.col("_turn"), [F.col("_turn"), F.col("_doc")], F.lit(1), "_index", buckets_for(rows)).select("_row", "_key", "_words", "_index"))
    sources, parts = cut(targets(sized.select("_key", source.cast("string").alias("source"), F.col("_words").alias("size")))), max(1, rows // ROWS_PER_TASK)
    wants = cut(wanted(_reach(listed, sources, rows, seed), 1))
    drawn = cut(draw(wants, seed, parts))
    slots = _slots(wants, drawn, 1, seed, parts).select("_key", F.col("block").alias("_index"), "shard", "position")
    dealt = slots.hint("merge").join(listed.select("_key", "_index", "_row"), ["_key", "_index"])  # both sides grow with the documents
    return dealt.select("_row", "shard", "position").hint("merge").join(sized, "_row").select("shard", "position", *names)


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows of docs, each none, once or twice, so that every source's words meet its target to half a document: those of `mixed_slots`.

    A row is copied as often as the target holds its whole source, and once more if the source's index permutation draws it before the words
    that are then left are used up. The rows of an output shard lie in one partition, in the order of their positions. Rows count one by one:
    neither a null nor a repeated doc_id ties them together. Texts without words, null ones among them, are never taken. Columns may have any
    names. No documents give no rows.
    """
    dealt = mixed_slots(docs, seed)
    return dealt.repartition("shard").sortWithinPartitions("shard", "position").drop("shard", "position").toDF(*docs.columns)
