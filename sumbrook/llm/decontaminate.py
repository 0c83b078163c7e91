"""Benchmark passages in documents, by a prefix-filtered join with exact verification.

A window (13 consecutive words of an item, or a whole shorter item) must be contained whole, so its necessary prefix
is a single token: its rarest word over the corpus. Windows, corpus counts and prefixes are tables that Spark joins.
Documents are read twice: once to count the words that the benchmark has, once for candidates. A place of a document
is a candidate if it holds a prefix word and the window, laid so that its prefix is there, lies inside the document; the
candidate's text is then joined with the windows' texts, which verifies it word by word.

Only filters of fixed size are broadcast: bitmaps of FILTER_BITS, which say of a word (and of its place and the
window's length) that no window has it as its prefix. A bitmap that a huge benchmark fills lets more candidates
through to the join, and loses none.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HOT, cut, join_hot, slices, small_batches, texts

WINDOW = 13
FILTER_BITS = 1 << 24

#: Every byte outside the word class becomes a space, capital letters become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        said, sizes, items = [], [], []
        for item, text in zip(batch.column(batch.schema.get_field_index("item_id")).to_pylist(), texts(batch, "text"), strict=True):
            found = words(text)
            own = {b" ".join(found[i : i + WINDOW]) for i in range(max(1, len(found) - WINDOW + 1))} if found else set()
            said += own
            sizes += [min(len(found), WINDOW)] * len(own)
            items += [item] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())], ["said", "n", "item"])


def windows(benchmark: DataFrame) -> DataFrame:
    """said (the words, by spaces), n (how many), items (ids without nulls) of each distinct window."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_windows, "said string, n int, item string").groupBy("said", "n").agg(F.collect_set("item").alias("items"))


#: Place and length that stand for any.
_ANY = 255


def _slot(word: bytes, place: int = _ANY, n: int = _ANY) -> int:
    return xxhash.xxh64_intdigest(word, place << 8 | n)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_slot(w.encode(), p, n) % bits for w, p, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["slot"])

    return run


def _bitmap(rows: DataFrame, bits: int) -> Broadcast:
    """A bitmap of the rows (word, place, n), of the same size whatever their number."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    found = rows.mapInArrow(_slots(bits), "slot long").groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()  # bits / 64 rows at most
    held = np.zeros(bits // 64, np.int64)
    held[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def _has(bitmap: np.ndarray, slot: int) -> bool:
    at = slot % (8 * len(bitmap))
    return bool(bitmap[at >> 3] >> (at & 7) & 1)


def _count(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in slices(batches, "text"):
            seen = Counter(words(b" ".join(texts(batch, "text"))))
            seen = {w: n for w, n in seen.items() if _has(known, _slot(w))}
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return run


def prefixes(found: DataFrame, text: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """word, place, n of each window: its rarest word in text (the first of equals), where it stands, and the window's length."""
    spoken = found.select("said", "n", F.posexplode(F.split("said", " ")).alias("place", "word"))
    vocabulary = cut(spoken.groupBy("word").agg(F.count("*").alias("held")))
    held = _bitmap(vocabulary.select("word", F.lit(_ANY).alias("place"), F.lit(_ANY).alias("n")), bits)
    counts = text.mapInArrow(_count(held), "word string, n long").groupBy("word").agg(F.sum("n").alias("seen"))
    rarity = cut(vocabulary.join(counts, "word", "left").select("word", "held", F.coalesce("seen", F.lit(0)).alias("seen")))
    total = rarity.agg(F.sum("held")).first()[0] or 0
    rarest = join_hot(spoken, rarity, "word", "held", total).groupBy("said", "n").agg(F.min(F.struct("seen", "place", "word")).alias("least"))
    return rarest.select("least.word", "least.place", "n").distinct()


def _candidates(prefix: Broadcast, placed: Broadcast, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_prefix, fits = prefix.value, placed.value
        for batch in slices(batches, "text"):
            listed = [words(text) for text in texts(batch, "text")]
            heads = [w for w in set(chain.from_iterable(listed)) if _has(is_prefix, _slot(w))]
            # the places and lengths that such a word can have in a window
            able = {w: found for w in heads if (found := [(p, n) for n in sizes for p in range(n) if _has(fits, _slot(w, p, n))])}
            n_words, out = list(map(len, listed)), []
            for said in listed:
                own = []
                for at in [at for at, word in enumerate(said) if word in able]:
                    for place, n in able[said[at]]:
                        begin = at - place
                        if begin >= 0 and begin + n <= len(said):
                            own.append((begin, n, b" ".join(said[begin : begin + n]).decode("utf8", "replace")))
                out.append(own)
            others = batch.select([c for c in batch.schema.names if c != "text"])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("n", pa.int32()), ("said", pa.string())]))
            columns = [pa.array(n_words, pa.int64()), pa.array([[dict(zip(("begin", "n", "said"), x, strict=True)) for x in own] for own in out], kind)]
            yield pa.RecordBatch.from_arrays([*others.columns, *columns], [*others.schema.names, "n_words", "found"])

    return run


def _text_key(text: Column) -> Column:
    """128 bits of hash and the length: equal texts have equal hits, so each is verified once."""
    return F.when(text.isNotNull(), F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit("second"), text)), F.octet_length(text).cast("string"))).otherwise("")


def _hits(rows: DataFrame, benchmark: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """rows (with text) as a table without text, with key and n_words; and for each key with a hit its merged spans and items."""
    small_batches(rows.sparkSession)
    found = cut(windows(benchmark))
    prefix = cut(prefixes(found, rows.select("text"), bits))
    sizes = sorted(r.n for r in prefix.select("n").distinct().collect())  # WINDOW of them at most
    empty = F.expr("cast(array() as array<struct<begin:long,n:int,said:string>>)")
    schema = rows.drop("text").withColumns({"n_words": F.lit(0).cast("long"), "found": empty}).schema
    held = _bitmap(prefix.select("word", F.lit(_ANY).alias("place"), F.lit(_ANY).alias("n")), bits), _bitmap(prefix.select("word", "place", "n"), bits)
    marked = cut(rows.mapInArrow(_candidates(*held, sizes), schema))
    texts_ = marked.where("size(found) > 0").groupBy("key").agg(F.any_value("found").alias("found"))
    each = cut(texts_.select("key", F.inline("found")))
    met = cut(found.select("said", "items").join(each.groupBy("said").agg(F.count("*").alias("held")), "said"))
    hits = cut(join_hot(each, met, "said", "held", each.count()).select("key", "begin", (F.col("begin") + F.col("n")).alias("end"), "items"))
    by = W.partitionBy("key").orderBy("begin", "end")
    apart = F.coalesce(F.col("begin") > F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int")
    islands = hits.select("key", "begin", "end").distinct().withColumn("apart", apart).withColumn("island", F.sum("apart").over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    items = hits.select("key", F.explode_outer("items").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return marked.drop("found"), spans.join(items, "key")


def contamination(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, spans (hit words, from begin to before end), items (ids of the items with windows in the text) of each row.

    Null and blank texts have no words and are clean. Repeated rows each come back. Repeated items count once; an item
    without an id marks words but adds no item. An empty benchmark leaves every document clean. Documents of any length
    are processed whole; other columns than doc_id, text and item_id are not read. No documents give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    marked, hits = _hits(rows, benchmark, bits)
    keyed = cut(hits.join(marked.groupBy("key").agg(F.count("*").alias("held")), "key"))
    joined = join_hot(marked, keyed, "key", "held", marked.count(), "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<begin:long,end:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s.end - s.begin)


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of docs that are not contaminated, unchanged: null and blank texts stay, equal texts stay or go together.

    Columns may have any names. Texts are known by their hashes. Rows of a hot text, null among them, are judged where they lie; the
    others are joined with the contaminated texts alone.
    """
    rows = docs.select(_text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    marked, hits = _hits(rows, benchmark, bits)
    sizes = cut(marked.groupBy("key").agg(F.any_value("n_words").alias("n_words"), F.count("*").alias("held")))
    bad = cut(hits.join(sizes, "key").where(is_contaminated(hit_words(F.col("spans")), F.col("n_words"))).select("key"))
    total = sizes.agg(F.sum("held")).first()[0] or 0
    key = f"key_{uuid.uuid4().hex}"  # so that no column of docs has the name
    hot = cut(sizes.where(F.col("held") * HOT > total).select("key").join(bad.withColumn("bad", F.lit(True)), "key", "left").select(F.col("key").alias(key), F.col("bad").isNull().alias("clean")))
    keyed = docs.withColumn(key, _text_key(F.col("text")))
    stay = keyed.join(F.broadcast(hot.where("clean").select(key)), key, "left_semi")  # hot: fewer than HOT rows
    rest = keyed.join(F.broadcast(hot.select(key)), key, "left_anti").join(bad.withColumnRenamed("key", key), key, "left_anti")
    return stay.unionByName(rest).drop(key)
