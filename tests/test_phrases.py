"""Many phrases blanked in one pass against a plain search from left to right."""

import random

import pytest
from pyspark.sql import functions as F

from sumbrook.functions import phrases


def plain(text, listed):
    out, at, n = [], 0, 0
    by_length = sorted({p for p in listed if p}, key=len, reverse=True)
    while at < len(text):
        hit = next((p for p in by_length if text.startswith(p, at)), None)
        out.append(" " if hit else text[at])
        at, n = at + (len(hit) if hit else 1), n + bool(hit)
    return "".join(out), n


def test_ten_thousand_phrases_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 500)
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcё") for _ in range(n))
    listed = [word(rng.randint(1, 9)) for _ in range(10_000)] + ["", None]
    listed = [p for p in listed if p is None or len(p) != 1 or p == "ё"]
    texts = [(i, word(rng.randint(0, 200)) + " x" * rng.randint(0, 3)) for i in range(60)] + [(60, None), (61, ""), (7, "ё" * 4000)]
    got = phrases.mask_phrases(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in listed], "phrase string"), "id").collect()
    want = sorted((i, None if t is None else plain(t, listed)[0], 0 if t is None else plain(t, listed)[1]) for i, t in texts)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bounds_and_empty_lists(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b")], "id long, text string")
    none = spark.createDataFrame([], "phrase string")
    assert [tuple(r) for r in phrases.mask_phrases(texts, none, "id").collect()] == [(1, "a b", 0)]
    assert phrases.mask_phrases(texts.limit(0), texts.select(F.col("text").alias("phrase")), "id").count() == 0
    monkeypatch.setattr(phrases, "MOST", 0)
    with pytest.raises(ValueError, match="too many"):
        phrases.mask_phrases(texts, texts.select(F.col("text").alias("phrase")), "id")
