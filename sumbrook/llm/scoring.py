"""Language-model scores of texts by a weighted backoff automaton over word n-grams.

States are the histories of up to ORDER - 1 words that training has seen, and the begin of a text. A state has an arc
for every word that followed it there, with the smoothed log-probability and the state that the word leads to, and a
failure arc to the history that is one word shorter, with the log of the weight that smoothing leaves to it. The
empty history has an arc for every word. A text is traversed once from left to right: the state is carried from word
to word, and a word without an arc follows failure arcs, paying for each, until it finds one.

No task holds the whole automaton. Texts are dealt to blocks of bounded size; a block asks for the counts of its own
n-grams (each once), buckets of the hash space add the blocks' counts up and answer each block, and the block then
builds the part of the automaton that its texts can reach. A row from a block to a bucket holds the n-grams that
they share, so there are never more rows than n-grams asked for.

Words are known by 64-bit hashes, longer n-grams by as many leading bits as keep the expected share of those that
share a name with another one below 2 ** -SPARE_BITS; such n-grams are counted together.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, small_batches

ORDER = 3
#: Added to each count of the unigrams.
PRIOR = 0.1
#: A history of one, two and more words that was seen c times is taken to have about c ** GROWTH different successors;
#: DISCOUNT of each goes to the shorter history. Expecting fewer successors of longer ones tells repeated texts apart.
GROWTH = (0.9, 0.7)
DISCOUNT = 0.8
#: Bytes of text that a block, and a bucket's share of the n-grams, stand for.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
#: See above.
SPARE_BITS = 16
_PIECE = 1 << 20

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = 0x9E3779B97F4A7C15
_END, _BEGIN = np.uint64(0x5D1F2C3B4A596877), np.uint64(0x1F83D9ABFB41BD6B)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    step = np.full(n, pow(_ODD, -1, 1 << 64) if inverse else _ODD, np.uint64)
    step[:1] = 1
    return np.multiply.accumulate(step)


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of text begin and a 64-bit hash of each."""
    of = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[of].astype(np.int8), prepend=1, append=1))
    begin, end = edge[::2], edge[1::2]
    room = max(_PIECE, 1 << len(of).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[of] * _powers(room, False)[: len(of)])))
    return begin, _mix((sums[end] - sums[begin]) * _powers(room, True)[begin] + (end - begin).astype(np.uint64))


def tokens(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all documents, each with its end, and how many tokens each document has."""
    parts, counts, at = [], [], 0
    while at < len(documents):
        upto, held = at, 0
        while upto < len(documents) and (upto == at or held + len(documents[upto]) < _PIECE):
            held += len(documents[upto]) + 1
            upto += 1
        own = documents[at:upto]
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))
        begin, hashes = _words(b"\n".join(own).lower())
        of = np.searchsorted(begins, begin, "right") - 1
        n = np.bincount(of, minlength=len(own)) + 1
        out = np.full(len(hashes) + len(own), _END, np.uint64)
        out[np.arange(len(hashes)) + of] = hashes
        parts.append(out)
        counts.append(n)
        at = upto
    return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Grams:
    """The n-grams that end at each token of some documents, by order; distinct ones, in the order of their names.

    A text begins with one mark, so its first token ends a unigram and a bigram, the second a trigram too, and so on.
    which is -1 where no n-gram of the order ends. sample is a place where each distinct one ends.
    """

    def __init__(self, documents: list[bytes], order: int, bits: int = 64):
        hashes, self.counts = tokens(documents)
        self.begins = np.cumsum(self.counts) - self.counts
        place = np.arange(len(hashes)) - np.repeat(self.begins, self.counts)
        self.distinct, self.which, self.sample, now = [], [], [], hashes
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate((now[:1], now[:-1]))
                now = _mix(np.where(place == 0, _BEGIN, before) * np.uint64(_ODD) + hashes + np.uint64(k))
            at = np.flatnonzero(place >= k - 2)
            names = now[at] >> np.uint64(64 - bits) if k > 1 else now[at]
            distinct, sample, which = np.unique(names, return_index=True, return_inverse=True)
            all_which = np.full(len(hashes), -1, np.int32)
            all_which[at] = which
            self.distinct.append(distinct)
            self.sample.append(at[sample])
            self.which.append(all_which)


class Automaton:
    """The states and arcs that the texts of a block can reach.

    State 0 is the empty history, state 1 the begin of a text; then come the n-grams of each order below the highest.
    An arc is known by its state and word together: its key is state times words plus word.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], begun: int, base: np.ndarray, levels: list[float]):
        order, self.grams = len(counts), grams
        self.words = max(1, len(counts[0]))
        first = np.cumsum([2, *(len(c) for c in counts[:-1])])  # of each order's states
        n_states = int(first[-1])
        seen = np.concatenate(([0, begun], *counts[:-1])).astype(np.int64)
        self.shorter, left = np.zeros(n_states, np.int64), np.ones(n_states)
        left[1] = weight_left(seen[1:2], levels, 1)[0] if order > 1 else 1.0
        every = np.arange(len(base))
        smoothed, keys, logs = [base], [every], [np.log10(base)]
        targets = [np.where(counts[0] > 0, first[0] + every, 0) if order > 1 else every * 0]
        for k in range(2, order + 1):
            at, c = grams.sample[k - 1], counts[k - 1]
            inner = grams.which[k - 2][at]  # the (k - 1)-gram that ends at the same place
            history = np.where(np.isin(at, grams.begins), 1, first[k - 2] + grams.which[k - 2][at - 1])
            own = slice(first[k - 2], first[k - 1] if k < order else None)
            left[own] = weight_left(counts[k - 2], levels, k - 1)
            if k > 2:
                self.shorter[own] = first[k - 3] + grams.which[k - 3][grams.sample[k - 2]]
            share = c / np.maximum(seen[history], 1)
            smoothed.append((1 - left[history]) * share + left[history] * smoothed[-1][inner])
            arc = c > 0
            keys.append(history[arc] * self.words + grams.which[0][at[arc]])
            logs.append(np.log10(smoothed[-1][arc]))
            targets.append(first[k - 1] + np.flatnonzero(arc) if k < order else first[k - 2] + inner[arc])
        self.failure = np.log10(left)
        del smoothed, left, seen
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        self.keys, self.logs = keys[by], np.concatenate(logs)[by]
        self.targets = np.concatenate([t.astype(np.int32) for t in targets])[by]

    def traverse(self) -> np.ndarray:
        """The log-probability of each text: one step of all texts that still run at a time, the longest first."""
        sizes = self.grams.counts
        by = np.argsort(-sizes, kind="stable")
        word, begins, longest = self.grams.which[0], self.grams.begins[by], sizes[by]
        state, score = np.ones(len(sizes), np.int64), np.zeros(len(sizes))
        steps = int(longest[0]) if len(sizes) else 0
        live = np.searchsorted(-longest, -np.arange(steps), "left")
        for t in range(steps):
            n = live[t]
            said, todo = word[begins[:n] + t], np.arange(n)
            while len(todo):
                key = state[todo] * self.words + said[todo]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[arc] == key
                found, arc = todo[hit], arc[hit]
                score[found] += self.logs[arc]
                state[found] = self.targets[arc]
                todo = todo[~hit]
                score[todo] += self.failure[state[todo]]
                state[todo] = self.shorter[state[todo]]
        out = np.empty_like(score)
        out[by] = score
        return out


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes; the planes of small numbers are short and compress well."""
    values = values.astype("<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        held = np.frombuffer(planes, np.uint8).reshape(-1, n)
        out[:, : len(held)] = held.T
    return out.reshape(-1).view("<u8")


def _rows(columns: dict[str, list], types: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in types})


_ASKED = [("block", pa.int64()), ("k", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())]
_TOLD = [("block", pa.int64()), ("k", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("types", pa.int64()), ("total", pa.int64()), ("power", pa.float64())]


def _edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)


def _documents(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").to_pylist()]


def _ask(order: int, buckets: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        grams = Grams(_documents(table), order, bits)
        known = np.repeat(table.column("train").to_numpy(), grams.counts)
        block, out = table.column("block")[0].as_py(), {k: [] for k, _ in _ASKED}
        for k in range(order):
            distinct, ends = grams.distinct[k], grams.which[k] >= 0
            n = np.bincount(grams.which[k][ends], known[ends], len(distinct)).astype(np.int64)
            cuts = np.searchsorted(distinct, _edges(buckets, bits if k else 64))
            used = np.flatnonzero(np.diff(cuts, append=len(distinct)))  # no row for what a bucket hasn't got
            for bucket, a, b in zip(used.tolist(), cuts[used].tolist(), [*cuts[used[1:]].tolist(), len(distinct)], strict=True):
                steps = np.diff(distinct[a:b], prepend=np.uint64(0))
                for key, value in zip(out, (block, k + 1, bucket, b - a, distinct[a : a + 1].tobytes() + _pack(steps[1:]), _pack(n[a:b])), strict=True):
                    out[key].append(value)
        return _rows(out, _ASKED)

    return run


def _names(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(blob[:8], "<u8"), _unpack(blob[8:], n - 1))), dtype=np.uint64)


def _growth(k: int) -> float:
    return GROWTH[min(k, len(GROWTH)) - 1]


def _answer():
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        growth = _growth(rows["k"][0])
        sizes = rows["n"]
        distinct, which = np.unique(np.concatenate([_names(h, n) for h, n in zip(rows["names"], sizes, strict=True)]), return_inverse=True)
        counts = np.concatenate([_unpack(c, n) for c, n in zip(rows["counts"], sizes, strict=True)])
        total = np.bincount(which, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum(sizes)
        told = [_pack(total[which[e - n : e]]) for n, e in zip(sizes, ends, strict=True)]
        m, seen = len(sizes), total[total > 0]
        only = lambda x, none: [x, *[none] * (m - 1)]
        return _rows({"block": rows["block"], "k": rows["k"], "bucket": rows["bucket"], "n": sizes, "counts": told, "types": only(len(seen), 0), "total": only(int(seen.sum()), 0), "power": only(float((seen.astype(float) ** growth).sum()), 0.0)}, _TOLD)

    return run


def weight_left(seen: np.ndarray, levels: list[float], k: int) -> np.ndarray:
    """What a history of k words that was seen so often leaves to the shorter one: all if it was never seen."""
    often = np.maximum(seen, 1).astype(float)
    return np.where(seen > 0, np.clip(levels[k] * often ** (_growth(k) - 1), 1e-6, 0.999), 1.0)


def _score(order: int, bits: int, total: int, types: int, levels: list[float]):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        out = {c: docs.column(c) for c in ("doc_id", "train")}
        grams = Grams(_documents(docs), order, bits)
        rows = told.select(["k", "bucket", "n", "counts"]).sort_by([("k", "ascending"), ("bucket", "ascending")]).to_pydict()
        counts = [np.zeros(0, np.int64)] * order
        for k in range(1, order + 1):
            parts = [_unpack(c, n) for c, n, o in zip(rows["counts"], rows["n"], rows["k"], strict=True) if o == k]
            counts[k - 1] = np.concatenate(parts).astype(np.int64) if parts else counts[k - 1]
        base = (counts[0] + PRIOR) / (total + PRIOR * (types + 1))
        begun = int(counts[0][grams.which[0][grams.counts[0] - 1]]) if len(grams.counts) else 0  # each text learned from has one end
        add = lambda x: np.add.reduceat(x[grams.which[0]], grams.begins) if len(grams.begins) else x[:0]
        score = Automaton(grams, counts, begun, base, levels).traverse()
        return pa.table({**out, "n_tokens": pa.array(grams.counts, pa.int64()), "n_known": pa.array(add((counts[0] > 0).astype(np.int64)), pa.int64()), "base_score": add(np.log10(base)), "score": score})

    return run


def score_texts(docs: DataFrame, train, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10) of each row; learns where the column `train` is true.

    Null and blank texts are one end token. Repeated rows each count and come back. Without training rows every
    token has the same probability, 1. No documents give no rows. Columns other than doc_id and text are not read.
    Texts of any length stay whole: a text longer than a block is a block.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    bits = min(64, int(size).bit_length() + SPARE_BITS)  # there are fewer n-grams of an order than bytes
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_ask(order, buckets, bits), "block long, k int, bucket long, n long, names binary, counts binary")
    told = cut(asked.groupBy("bucket", "k").applyInArrow(_answer(), "block long, k int, bucket long, n long, counts binary, types long, total long, power double"))
    sums = {r.k: r for r in told.groupBy("k").agg(F.sum("types").alias("types"), F.sum("total").alias("total"), F.sum("power").alias("power")).collect()}  # a row for each order
    total, types = (sums[1].total, sums[1].types) if sums else (0, 0)
    levels = [0.0, *(DISCOUNT * sums[k].types / max(sums[k - 1].power, 1.0) if k in sums else 0.0 for k in range(2, order + 1))]
    scored = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(order, bits, total, types, levels), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))


def held_out(col):
    return remainder(col, 10) == 0
