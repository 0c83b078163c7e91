"""Language of whole texts: script ranges narrow the candidates, Viterbi labels the words' spans.

A word's score for a language is the naive Bayes log-likelihood of its character n-grams (hashed to a bounded table).
Scripts that a language never showed in training rule it out for that word. Viterbi then finds the best sequence of
languages over a document's words, where each change costs a penalty; runs of equal labels are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, small_batches, texts, unit_hash

#: At most about so many labelled documents are learned from, whole; chosen by a hash of their id.
SAMPLE = 10_000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Log-likelihood that a change of language costs.
PENALTY = 12.0
#: A word's score counts at most so much for or against a language.
WORD_LIMIT = 12.0
#: A language may use a script if it makes up this share of its letters in training.
SCRIPT_SHARE = 0.001
UNKNOWN = "und"
#: A document is in a language that fits this share of its letters, by label and by script; the pipeline rejects others.
FITS = 0.4
#: Bytes of text that are labelled at once; a worker needs some fifty times as much memory.
PIECE = 3 << 20

# fixed values: first code points of script ranges (Unicode blocks) and the script of each
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00]
SCRIPTS = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "indic", "thai", "other", "georgian", "hangul", "latin", "greek", "other", "hiragana", "katakana", "other", "han", "other", "hangul", "other", "han", "other"]
SCRIPT_NAMES = list(dict.fromkeys(SCRIPTS))


@cache
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its script's number and whether it is a letter."""
    every = np.arange(0x110000)
    numbers = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS], np.int64)
    return numbers[np.searchsorted(SCRIPT_STARTS, every, "right") - 1], np.fromiter((chr(x).isalpha() for x in every), bool, len(every))


class Words:
    """The distinct words of some texts: their code points, letters, scripts and n-gram buckets."""

    def __init__(self, documents: list[bytes]):
        found = [t.decode("utf8", "replace").lower().split() for t in documents]
        self.counts = np.array([len(x) for x in found], np.int64)
        flat = [w for x in found for w in x]
        codes, self.words = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
        self.codes = codes.astype(np.int64)
        padded = "".join(f" {w} " for w in self.words)
        self.points = np.frombuffer(padded.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        self.sizes = np.array([len(w) + 2 for w in self.words], np.int64)
        self.word = np.repeat(np.arange(len(self.words)), self.sizes)
        script_of, is_letter = _code_points()
        self.script, self.letter = script_of[self.points], is_letter[self.points]
        self.letters = np.bincount(self.word, self.letter, len(self.words)).astype(np.int64)

    def main_script(self) -> np.ndarray:
        """The script of most letters of each word."""
        main = np.zeros((len(self.words), len(SCRIPT_NAMES)), np.int64)
        np.add.at(main, (self.word[self.letter], self.script[self.letter]), 1)
        return main.argmax(1)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the word and the bucket of each n-gram. What is not a letter counts as a space."""
        points = np.where(self.letter, self.points, 32)
        for n in ORDERS:
            if len(points) < n:
                continue
            mixed = np.zeros(len(points) - n + 1, np.uint64)
            for k in range(n):
                mixed = (mixed + points[k : len(points) - n + 1 + k].astype(np.uint64) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            inside = (self.word[: len(mixed)] == self.word[n - 1 :]) & (points[: len(mixed)] + points[n - 1 :] != 64)
            yield self.word[: len(mixed)][inside], (mixed[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", PIECE):
        found, langs = Words(texts(batch, "text")), np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        which, names = pd.factorize(langs)
        of_word = np.repeat(which, found.counts)
        parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in range(len(names)):
            times = np.bincount(found.codes[of_word == i], minlength=len(found.words))
            for word, bucket in found.grams():
                parts.append((i, bucket, times[word]))
            parts.append((i, BUCKETS + found.script[found.letter], times[found.word[found.letter]]))
        for i, bucket, n in parts:
            total = np.bincount(bucket, n, BUCKETS + len(SCRIPT_NAMES)).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Log-likelihoods by bucket and language; the scripts that each language uses."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:, :BUCKETS] + 0.05, counts[:, BUCKETS:]
        logs = np.log(grams / grams.sum(1, keepdims=True)) if len(langs) else grams
        self.logs = (logs - logs.mean(0)).T.astype(np.float32) if len(langs) else logs.T
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)

    def emissions(self, found: Words) -> np.ndarray:
        total = np.zeros((len(found.words), len(self.langs)), np.float32)
        for word, bucket in found.grams():
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word, self.logs[bucket, k], len(found.words))
        total = np.clip(total - total.max(1, keepdims=True), -WORD_LIMIT, 0) if self.langs else total
        able = self.uses[:, found.main_script()].T if len(found.words) else np.zeros((0, len(self.langs)), bool)
        total = np.where(able | ~able.any(1, keepdims=True), total, -4 * WORD_LIMIT)  # no language uses it: no news
        total[found.letters == 0] = 0
        return total

    def labels(self, documents: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words of the documents and the language number of each word, by Viterbi in step over all documents."""
        found = Words(documents)
        if not self.langs:
            return found, np.zeros(len(found.codes), np.int16)
        emit, states = self.emissions(found)[found.codes], len(self.langs)
        by = np.argsort(-found.counts, kind="stable")  # longest first: those that still run at a step come first
        sizes, rank = found.counts[by], np.argsort(by, kind="stable")
        steps = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(steps), "left")
        start = np.concatenate(([0], np.cumsum(live)))
        step = np.arange(len(found.codes)) - np.repeat(np.concatenate(([0], np.cumsum(found.counts)))[:-1], found.counts)
        place = start[step] + np.repeat(rank, found.counts)  # of each word, ordered by step and document
        staged = np.empty_like(emit)
        staged[place] = emit
        best, jumped = np.zeros(len(emit), np.int16), np.zeros((len(emit), states), bool)
        score = np.zeros((len(sizes), states), emit.dtype)
        for t in range(steps):
            n, o = live[t], start[t]
            now = score[:n]
            if t:
                best[o : o + n] = now.argmax(1)
                change = now.max(1, keepdims=True) - PENALTY
                np.greater(change, now, out=jumped[o : o + n])
                np.maximum(now, change, out=now)
            now += staged[o : o + n]
        state = score.argmax(1)
        chosen, flat, count = np.zeros(len(emit), np.int16), jumped.ravel(), np.arange(len(sizes)) * states
        for t in range(steps - 1, -1, -1):
            n, o = live[t], start[t]
            own = state[:n]
            chosen[o : o + n] = own
            if t:
                np.copyto(own, best[o : o + n], where=flat[o * states + count[:n] + own])
        out = chosen[place]
        return found, out

    def predict(self, documents: list[bytes]) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]], list[float]]:
        """For each document its language, that language's share of the letters, the spans (first word, end, language),
        and the share of the letters that have the language's label in a script that it uses."""
        found, label = self.labels(documents)
        letters = found.letters[found.codes].astype(float)
        able = np.zeros(len(label), bool)
        if len(self.langs) and len(label):
            able = self.uses[label, found.main_script()[found.codes]]
        names, shares, spans, fits, begin = [], [], [], [], 0
        for n in found.counts:
            own, weight = label[begin : begin + n], letters[begin : begin + n]
            held = np.bincount(own, weight, len(self.langs)) if n else np.zeros(len(self.langs))
            if not len(self.langs) or not held.sum():
                names.append(UNKNOWN), shares.append(0.0), spans.append([]), fits.append(0.0)
            else:
                best = int(held.argmax())
                names.append(self.langs[best]), shares.append(float(held[best] / held.sum()))
                fits.append(float((weight * (able[begin : begin + n] & (own == best))).sum() / held.sum()))
                edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(n)]
                spans.append([(a, b, self.langs[own[a]]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
            begin += n
        return names, shares, spans, fits


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the text and lang of docs; rows without either are left out. `sample` bounds the rows, in expectation."""
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null")
    n = known.count()
    chosen = known.where(unit_hash(F.lit("language"), F.col("doc_id")) * max(n, 1) < sample).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    summed = chosen.mapInArrow(_learn, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(summed.lang.unique())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    counts[summed.lang.map(langs.index).to_numpy(np.int64), summed.bucket.to_numpy(np.int64)] = summed.n
    return Model(langs, counts)


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the letters), spans (first word, end, language) of each row.

    Null texts and texts without a letter are `und` with score 0 and no spans; so is everything if nothing was learned.
    Repeated rows each come back, ties between languages go to the first by name, only doc_id and text are read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each learned language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            names, shares, spans, _ = held.value.predict(texts(batch, "text"))
            of = [[dict(zip(("begin", "end", "lang"), s, strict=True)) for s in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(of, _SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<begin:long,end:long,lang:string>>")


def keep_known(docs: DataFrame, model: Model, fits: float = FITS) -> DataFrame:
    """The rows of docs whose text is in a learned language, unchanged.

    At least `fits` of the letters must have the predicted language's label, in a script that this language uses:
    texts in other scripts, texts of several languages without a main one, and those that `identify` calls `und` go.
    Rows pass through in one step, without a join. Where nothing could be learned, every text with a letter stays.
    """
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            names, _, _, share = held.value.predict(texts(batch, "text"))
            yield batch.filter(pa.array([n != UNKNOWN and s >= fits for n, s in zip(names, share, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(col: Column) -> Column:
    return remainder(col, 3) == 1
