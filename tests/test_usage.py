"""Accounts between resets, in batch and over a stream, and the bootstrap from blocks, against plain versions."""

import math
import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumbrook.operators import evalstats, usage
from sumbrook.streaming.usage import spent_at_resets

SCHEMA = "n long, who string, at timestamp, kind string, read long, wrote long"


def log(rng, rows):
    at = lambda: f"2026-01-0{rng.randint(1, 3)} {rng.randint(0, 23):02d}:{rng.randint(0, 3):02d}:00"
    return [(i, rng.choice(["a", "b", None]), at(), rng.choice(["call", "call", "call", "reset", None]), rng.choice([None, 3, 10]), rng.randint(0, 5)) for i in range(rows)]


def plain(rows):
    open_, out = {}, []
    for n, who, at, kind, read, wrote in sorted(rows, key=lambda r: (r[2], r[0])):
        now = open_.setdefault(who, [0, 0, 0, 0])
        if kind == "reset":
            out.append((who, *now, now[2] + now[3], True))
            open_[who] = [now[0] + 1, 0, 0, 0]
        else:
            now[1:] = [now[1] + 1, now[2] + (read or 0), now[3] + wrote]
    return sorted(out + [(who, *now, now[2] + now[3], False) for who, now in open_.items() if now[1]], key=str)


@pytest.fixture(scope="module")
def calls(spark):
    rows = log(random.Random(3), 400)
    return rows, spark.createDataFrame([(r[0], r[1], None, *r[3:]) for r in rows], SCHEMA).drop("at").join(spark.createDataFrame([(r[0], r[2]) for r in rows], "n long, at string").withColumn("at", F.to_timestamp("at")), "n")


@pytest.mark.parametrize("slot", ["hour", "day", "year"])
def test_spent_between_resets(calls, slot):
    rows, df = calls
    got = usage.spent(df, "who", "at", "n", F.col("kind") == "reset", F.col("read"), F.col("wrote"), slot)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert usage.spent(df.limit(0), "who", "at", "n", F.col("kind") == "reset", F.col("read"), F.col("wrote")).count() == 0


def test_spent_over_a_stream(spark, calls, tmp_path):
    rows, df = calls
    cuts = ["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-04"]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.where(F.col("at").between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp") - F.expr("interval 1 second"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = spent_at_resets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "who", "at", "n", F.col("kind") == "reset", F.col("read"), F.col("wrote"))
        run = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)  # state goes on from trigger to trigger
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == [r[:-1] for r in plain(rows) if r[-1]]


def test_bootstrap_from_blocks_equals_one_plain_pass(spark):
    rng = np.random.default_rng(1)
    cases = [(i, float(x)) for i, x in enumerate(rng.normal(0.3, 1, 300))]
    df = spark.createDataFrame(cases, "case_id long, diff double")
    samples, seed, blocks = 200, 5, math.ceil(300 / 64)
    got = evalstats.bootstrap(df, samples, seed, 0.1, 64).first()
    of = dict(df.select("case_id", F.pmod(F.xxhash64("case_id"), F.lit(blocks)).alias("b")).collect())
    held = [[d for i, d in cases if of[i] == b] for b in range(blocks)]
    means = []
    for s in range(samples):
        draws = [evalstats._drawn([0, *accumulate(map(len, held))], s, b, seed) for b in range(blocks)]
        assert sum(draws) == 300
        means.append(sum(np.array(h)[np.random.default_rng((seed, s, b)).integers(0, len(h), n)].sum() for b, (h, n) in enumerate(zip(held, draws, strict=True))) / 300)
    means.sort()
    assert (got.n, got.low, got.high) == (300, pytest.approx(means[10]), pytest.approx(means[190]))
    plain_means = np.sort([rng.choice([d for _, d in cases], 300).mean() for _ in range(2000)])
    assert got.low == pytest.approx(plain_means[100], abs=0.05) and got.high == pytest.approx(plain_means[1900], abs=0.05)
    assert evalstats.bootstrap(df.limit(0), samples).count() == 0


def test_bootstrap_draws_shared_values_with_their_counts(spark, monkeypatch):
    """However many cases share a value, no case is drawn alone; rare values beside them are, and the interval is that of plain draws."""
    monkeypatch.setattr(evalstats, "BLOCK_VALUES", 4)
    rng, seen = np.random.default_rng(3), []
    plain = np.concatenate([np.repeat([-2.0, -1.0, 0.0, 0.5, 1.0, 3.0, 4.0], [200, 300, 16, 900, 400, 40, 15]), rng.normal(0, 1, 129)])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(plain)], "case_id long, diff double")
    keep = evalstats._resampled
    monkeypatch.setattr(evalstats, "_resampled", lambda ends, samples, seed: seen.append(ends) or keep(ends, samples, seed))
    got = evalstats.bootstrap(df, 2000, 5, 0.1, 100).first()
    assert seen[0][2] == 144 and seen[0][-1] == got.n == 2000 and len(seen[0]) == 5  # 129 cases and 15 of too rare a value, then six values
    means = np.sort([rng.choice(plain, 2000).mean() for _ in range(4000)])
    assert got.mean == pytest.approx(plain.mean()) and (got.low, got.high) == (pytest.approx(means[200], abs=0.008), pytest.approx(means[3800], abs=0.008))
    same = evalstats.bootstrap(df.where("diff = 0.5"), 500).first()
    assert (same.mean, same.low, same.high, same.n) == (0.5, 0.5, 0.5, 900)


def test_draws_are_spread_as_the_blocks_are():
    sizes, samples = [10, 0, 70, 20], 3000
    drawn = np.array([[evalstats._drawn([0, *accumulate(sizes)], s, b, 1) for b in range(4)] for s in range(samples)])
    assert (drawn.sum(1) == 100).all() and (drawn[:, 1] == 0).all()
    share, spread = drawn.mean(0) / 100, drawn.std(0)
    assert share == pytest.approx([0.1, 0, 0.7, 0.2], abs=0.01) and spread == pytest.approx([3, 0, 21**0.5, 4], abs=0.3)
