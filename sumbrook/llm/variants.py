"""Spelling variants: words one edit apart, found through a positional q-gram inverted index.

Two words of which the longer has m code points and that differ by one inserted, deleted or replaced code point share at
least m - 2q + 1 of their q-grams, each at the same place or, if one word is longer, one place on. A word is
posted under its q + 1 rarest grams with place and length; two near words always share such a posting list, since one
edit destroys q grams at most. Inside a list the members get a positional index of all their grams; for each of
them the postings of its grams are merged through a heap under the length and position limits, the longest ones are only
looked up, and what reaches the overlap bound is verified.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, slices, small_batches, texts

#: Code points of a gram.
Q = 3
#: Slots in which grams are counted to tell the rare from the common; a shared slot only changes the order of grams.
SLOTS = 1 << 18
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
#: Posting rows of a bucket, and buckets at most.
BUCKET_ROWS = 8_192
BUCKETS = 1 << 16
#: Buckets of a task, about: few bytes but much work, so their number and not their size decides.
BUCKETS_A_TASK = 4
#: A bucket of over so many times the mean is split into blocks.
UNEVEN = 4


# --- words and their counts


def altered(doc_id: str, run: str) -> str:
    """The run, or, if 31 divides h, the crc32 of `<doc_id>:<run>`, the run without its code point h % length."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # shorter runs have no result of `least` code points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(iter([batch]), "text"):
                for doc_id, text in zip(part.column(0).to_pylist(), texts(part, "text"), strict=True):
                    for word, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes.lower changes A-Z only
                        word = altered(doc_id, word)
                        if len(word) >= least:
                            counts[word] += n
                    if len(counts) > HELD_WORDS:
                        yield flush()
        yield flush()

    return run


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """word, n: the altered runs of letters with at least `least` code points that occur at least `occurrences` times.

    Null and empty texts have none; a null doc_id counts as the empty string. Repeated rows count each time. Counts are added up in
    the task that reads the texts and again by Spark before the shuffle, so a common word is one row for each task.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(id_text(F.col("doc_id")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_counted(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# --- postings


def grams(word: str) -> list[str]:
    return [word[i : i + Q] for i in range(len(word) - Q + 1)]


class Rarity(dict):
    """gram -> its place in the one order of all grams: by count in the vocabulary, then by code points."""

    def __init__(self, counts: np.ndarray):
        super().__init__()
        self.counts = counts

    def __missing__(self, gram: str) -> tuple[int, str]:
        self[gram] = found = (int(self.counts[_slot(gram)]), gram)
        return found


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SLOTS


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for g, n in Counter(g for word in batch.column(0).to_pylist() for g in grams(word)).items():
            counts[_slot(g)] += n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["slot", "n"])


def _posted(held: Broadcast, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(held.value)
        for batch in batches:
            rows = [(zlib.crc32(g.encode()) % buckets, w, i) for w, word in enumerate(batch.column(0).to_pylist()) for (_, g), i in heapq.nsmallest(Q + 1, [(rarity[g], i) for i, g in enumerate(grams(word))])]
            bucket, which, place = (np.array(x, np.int32) for x in (zip(*rows, strict=True) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *(c.take(pa.array(which)) for c in batch.columns), pa.array(place)], ["bucket", "word", "n", "place"])

    return run


# --- merging


def one_edit(u: str, v: str) -> bool:
    """Whether v is u with one code point inserted or replaced; v is not shorter."""
    half, more = len(u) // 2, len(v) - len(u)
    if u[:half] != v[:half] and u[half + 1 - more :] != v[half + 1 :]:
        return False  # the edit lies in one half, so the other one is the same
    for at, (a, b) in enumerate(zip(u, v, strict=False)):
        if a != b:
            return u[at + 1 - more :] == v[at + 1 :]
    return more == 1


def reaching(postings: list[tuple[list[int], int]], least: int, members: list[Member], tokens: dict[int, set[int]]) -> Iterator[int]:
    """The members that stand in at least `least` of the postings (ascending members, token).

    Such a member stands in one of all postings but the `least` - 1 longest: those are merged through a heap, and for
    the longest ones a member's own tokens, kept in `tokens`, are looked up.
    """
    postings.sort(key=_length)
    cut = len(postings) - least + 1
    long = {t for _, t in postings[cut:]}
    last, n = -1, 0
    for v in chain(heapq.merge(*[p for p, _ in postings[:cut]]), (-1,)):
        if v == last:
            n += 1
            continue
        if last >= 0:
            if n < least:
                if last not in tokens:
                    tokens[last] = set(members[last][3])
                n += len(long & tokens[last])
            if n >= least:
                yield last
        last, n = v, 1


def _length(posting: tuple[list[int], int]) -> int:
    return len(posting[0])


#: A member of a posting list: its row, word, move and the tokens of its grams that come behind the list's in the order of rarity.
Member = tuple[int, str, int, list[int]]


def near_in_list(indexed: list[Member], asking: list[Member], longest: int, place: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows of near words among the members of a posting list: the asker, and the longer one or the later in code-point order.

    A token is gram << 32 | place. The list's gram stands at `place` of the longer word and is taken as the rarest that a
    pair shares, so only the grams behind it count. Indexed words have `longest` code points; an asker's move says whether it is one of them
    (0) or shorter, with the list's gram at the same place (1) or one place before (2).
    """
    index: dict[int, list[int]] = {}
    for at, (_, _, _, behind) in enumerate(indexed):
        for t in behind:
            if t in index:
                index[t].append(at)
            else:
                index[t] = [at]
    tokens: dict[int, set[int]] = {}
    least = longest - 2 * Q  # the bound, less the list's gram
    for row, word, move, behind in asking:
        first = bisect(indexed, word, key=lambda m: m[1]) if move == 0 else 0
        if first == len(indexed):
            continue
        found = []
        for t in behind:
            if move == 0:
                moved = (t,)
            elif move == 1:  # grams before one that stays where it is stay, those behind one that moves on move on
                moved = (t,) if t & 0xFFFFFFFF < place else (t, t + 1)
            else:
                moved = (t + 1,) if t & 0xFFFFFFFF >= place else (t, t + 1)
            for m in moved:
                if (p := index.get(m)) and p[-1] >= first:
                    found.append((p if p[0] >= first else p[bisect_left(p, first) :], m))
        if len(found) < least:
            continue
        for at in reaching(found, least, indexed, tokens) if least > 0 else range(first, len(indexed)):
            if one_edit(word, indexed[at][1]):
                yield row, indexed[at][0]


def _near(held: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        rarity = Rarity(held.value)
        words, ns, places, homes = (table.column(c).to_pylist() for c in ("word", "n", "place", "home"))
        distinct = sorted(set(words))
        rank = {g: i << 32 for i, g in enumerate(sorted({g for word in distinct for g in grams(word)}, key=rarity.__getitem__))}
        ordered = {word: sorted([rank[g] | i for i, g in enumerate(grams(word))]) for word in distinct}
        lists: dict[tuple[int, int], tuple[list[Member], list[Member]]] = {}
        for row in sorted(range(len(words)), key=words.__getitem__):
            word, place = words[row], places[row]
            tokens = ordered[word]
            token = rank[word[place : place + Q]] | place
            at = bisect(tokens, token)
            behind, size = tokens[at:], len(word)
            indexed, asking = lists.setdefault((size, token), ([], []))
            member = (row, word, 0, behind)
            asking.append(member)
            if homes[row]:
                indexed.append(member)
            if at <= Q:  # an inserted code point takes one gram less from the shorter word than from the longer one
                lists.setdefault((size + 1, token), ([], []))[1].append((row, word, 1, behind))
                lists.setdefault((size + 1, token + 1), ([], []))[1].append((row, word, 2, behind))
        found: dict[tuple[str, str], int] = {}
        for (longest, token), (indexed, asking) in lists.items():
            if indexed and len(asking) > 1:
                for a, b in near_in_list(indexed, asking, longest, token & 0xFFFFFFFF):
                    found[words[a], words[b]], found[words[b], words[a]] = ns[b], ns[a]
        return pa.table([pa.array([u for u, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "near", "near_n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: pairs of words (word, n) one edit apart, in either direction. Words must be distinct and of 2q code points or more.

    A pair may come back more than once. A bucket of posting lists is one group; a larger one is split: its indexed words
    are dealt over blocks, and the askers meet each block.
    """
    spark = words.sparkSession
    counts = np.zeros(SLOTS, np.int64)
    for r in words.select("word").mapInArrow(_count_grams, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # SLOTS rows at most
        counts[r.slot] = r.n
    held = spark.sparkContext.broadcast(counts)  # 2 MB
    rows = (Q + 1) * words.count()
    buckets = max(1, min(BUCKETS, rows // BUCKET_ROWS))
    posted = cut(words.select("word", "n").mapInArrow(_posted(held, buckets), "bucket int, word string, n long, place int"))
    most = UNEVEN * max(BUCKET_ROWS, rows // buckets)
    large = posted.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > most).select("bucket", F.ceil(F.col("rows") / (most / UNEVEN)).cast("int").alias("blocks"))
    spread = posted.join(F.broadcast(large), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # large: BUCKETS / UNEVEN rows at most
    dealt = spread.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = F.pmod(F.xxhash64("word"), F.col("blocks")) == F.col("block")
    return dealt.select("bucket", "block", "word", "n", "place", home.alias("home")).repartition(max(1, buckets // BUCKETS_A_TASK), "bucket", "block").groupBy("bucket", "block").applyInArrow(_near(held), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: from each (word, form) along the forms to the last. Reach doubles with each round; forms must not lead in a circle."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        told = cut(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if told.where("moved").isEmpty():
            return told.select("word", "root")
        now = told.select("word", "root")


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of the distinct words (word, n).

    The form is the near word of largest n, ties to the smallest in code-point order, if that n is at least `times` the
    word's; else form and form_n are null. Root follows the forms to the last. No words give no rows.
    """
    words = cut(words)
    told = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    both = told.unionByName(near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n")).repartition("word").dropDuplicates(["word", "near"])
    best: Column = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), F.col("near"))))
    joined = both.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    fit = -F.col("best.minus") >= times * F.col("n")
    formed = cut(joined.select("word", F.when(fit, F.col("best.near")).alias("form"), "n", "n_near", F.when(fit, -F.col("best.minus")).alias("form_n")))
    led = roots(formed.where("form is not null"))
    return formed.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
