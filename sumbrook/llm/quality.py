"""Document quality by Bradley-Terry ranking on pairs of a good and a bad document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, slices, small_batches, texts, unit_hash

#: At most about so many labelled documents are learned from, whole; chosen by a hash of their id.
SAMPLE = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: The score from which a document is predicted good.
THRESHOLD = 0.7
RIDGE = 1e-2
SEED = 7

NAMES = ("log words", "word length", "distinct words", "most frequent word", "repeated neighbours", "capitals", "digits", "bars", "symbols", "end marks", "commas", "other marks", "blanks", "line length", "distinct lines", "not ASCII", "short words", "marked words")
_SYMBOLS = list(b"!#$%&*@^~=+<>")
_OTHER = list(b"\"'()/:;?[]\\_`{}-")


def features(text: bytes) -> list[float]:
    """Bounded numbers that describe the whole text; zeros if it has no word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    seen, lines = Counter(words), text.split(b"\n")
    of, size = np.bincount(np.frombuffer(text, np.uint8), minlength=256), len(text)
    lengths = np.fromiter(map(len, words), np.int64, n)
    letters = max(1, int(of[65:91].sum() + of[97:123].sum() + of[128:].sum()))
    return [
        float(np.log1p(n) / 10),
        min(3.0, float(lengths.mean()) / 10),
        len(seen) / n,
        max(seen.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        float(of[65:91].sum()) / letters,
        float(of[48:58].sum()) / size,
        min(1.0, float(of[124]) / n),
        min(1.0, float(of[_SYMBOLS].sum()) / n),
        min(1.0, float(of[46]) / n),
        min(1.0, float(of[44]) / n),
        min(1.0, float(of[_OTHER].sum()) / n),
        float(of[32] + of[9:14].sum()) / size,
        float(np.log1p(n / len(lines)) / 10),
        len(set(lines)) / len(lines),
        float(of[128:].sum()) / size,
        float((lengths <= 3).mean()),
        min(1.0, float(of[33:48].sum() + of[58:65].sum()) / n),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in texts(batch, "text")], pa.list_(pa.float64()))], ["doc_id", "features"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, features of each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_features, "doc_id long, features array<double>")


class Ranking:
    """Weights of the standardised features and their squares; a raw score's place relative to the threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, threshold: float = THRESHOLD):
        self.threshold = threshold
        wide = self._wide(x)
        self.mean = wide.mean(0) if len(x) else np.zeros(2 * len(NAMES))
        spread = wide.std(0) if len(x) else np.ones(2 * len(NAMES))
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        self.weight = np.zeros(wide.shape[1])
        self.cut = 0.0
        if good.all() or not good.any():  # nothing to compare: all are as likely good as what was seen
            likely = min(max((good.sum() + 1) / (len(good) + 2), 0.01), 0.99)
            self.cut = float(np.log(threshold / (1 - threshold)) - np.log(likely / (1 - likely)))
            return
        z, draw = (wide - self.mean) / self.spread, np.random.default_rng(SEED)
        better, worse = (draw.choice(np.flatnonzero(good == g), pairs) for g in (True, False))
        gap = z[better] - z[worse]
        for _ in range(25):  # Newton steps on the mean logistic loss of the differences
            p = 1 / (1 + np.exp(np.clip(gap @ self.weight, -30, 30)))
            slope = RIDGE * self.weight - gap.T @ p / pairs
            curve = (gap * (p * (1 - p))[:, None]).T @ gap / pairs + RIDGE * np.eye(len(self.weight))
            step = np.linalg.solve(curve, slope)
            self.weight -= step
            if abs(step).max() < 1e-8:
                break
        self.cut = float(np.quantile(z @ self.weight, 1 - good.mean()))  # so many lie below as are labelled bad; train() takes all labelled rows

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(NAMES))
        return np.hstack((x, x * x))

    def raw(self, features: Column) -> Column:
        n, w = len(NAMES), self.weight / self.spread
        line, bend = (F.array(*(F.lit(float(v)) for v in part)) for part in (w[:n], w[n:]))
        parts = F.zip_with(F.zip_with(features, line, lambda x, a: F.struct(x.alias("x"), a.alias("a"))), bend, lambda s, b: s.x * (s.a + b * s.x))
        return F.aggregate(parts, F.lit(float(-(w @ self.mean))), lambda a, b: a + b)

    def score(self, features: Column) -> Column:
        """0 to 1; the threshold where the raw score is at its quantile."""
        shift = self.cut - float(np.log(self.threshold / (1 - self.threshold)))
        return 1 / (1 + F.exp(-(self.raw(features) - F.lit(shift))))


def train(described: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learn from labels (doc_id, quality). Null and contradictory labels and documents without text rows are left out.

    `sample` bounds the labelled documents that the weights are fitted on, in expectation; the threshold is taken from all
    of them. A document that is repeated counts once.
    """
    known = labels.where("doc_id is not null and quality is not null")
    n = known.count()

    def agreed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high and low in (0, 1)")

    chosen = known.where(unit_hash(F.lit("quality"), F.col("doc_id")) * max(n, 1) < sample)
    rows = described.join(agreed(chosen), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("low").alias("good")).toPandas().sort_values("doc_id")
    x = np.array(rows.features.tolist(), float).reshape(-1, len(NAMES))
    model = Ranking(x, rows.good.to_numpy() == 1)
    if not model.weight.any():
        return model
    # the threshold is of all labelled rows: as many lie below it as are labelled bad
    scored = cut(described.select("doc_id", model.raw(F.col("features")).alias("raw")).join(agreed(known), "doc_id").groupBy("doc_id").agg(F.min("raw").alias("raw"), F.min("low").alias("low")))
    bad = scored.agg(F.avg((F.col("low") == 0).cast("double"))).first()[0]
    model.cut = float(scored.agg(F.percentile_approx("raw", F.lit(float(bad)), 100_000)).first()[0])
    return model


def rank_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of each row of docs. Null and blank texts are scored by their features, all zero.

    Repeated rows each come back, equal texts have equal scores, no documents give no rows, without usable labels all
    scores are equal. Only doc_id and text of docs are read, doc_id and quality of labels.
    """
    described = cut(describe(docs))
    model = train(described, labels, sample)
    scored = described.select("doc_id", model.score(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(col: Column) -> Column:
    return remainder(col, 4) == 2
