"""Many queries in one job against one search for each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumbrook.errors import AnalyticsError
from sumbrook.operators import retrieval, search_many


def test_many_queries_equal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(search_many, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search_many, "INDEX_ROWS", 50)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(1).tolist(), "abc"[i % 3]) for i in range(300)] + [(300, [0.0] * 5, "a"), (301, None, "a"), (302, [1.0, None, 1.0, 1.0, 1.0], "b"), (303, [1.0], "c"), (304, [float("nan")] * 5, "a")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, s string")
    index = search_many.with_norms(df.where("chunk_id <> 303"), "chunk_id", scope=F.col("s")).repartition(3)
    asked = search_many.with_norms(df.where("chunk_id % 15 = 0 or chunk_id = 303"), "chunk_id", scope=F.when(F.col("chunk_id") % 30 == 0, F.col("s")))
    got = search_many.search_many(index, asked, 4)
    held = {r.key: r for r in asked.collect() if len(r.v) == 5}
    by = {}
    for r in got.collect():
        by.setdefault((r.query, r.scope), []).append((r["rank"], r.key, r.score, r.relevant))
    assert set(by) == {(q, s) for q, r in held.items() for s in ([r.scope] if r.scope else "abc")}
    fine = index.select("key", "scope", F.col("v").alias("embedding"))
    for (q, s), found in sorted(by.items())[::9]:
        want = retrieval.search(fine.where(F.col("scope") == s), held[q].v, 4, key="key").collect()
        assert sorted(found) == [(i, r.key, r.score, r.relevant) for i, r in enumerate(want, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "rangepartitioning" not in plan


def test_edges(spark):
    one = search_many.with_norms(spark.createDataFrame([(1, [1.0, 0.0])], "k long, embedding array<double>"), "k")
    assert [tuple(r) for r in search_many.search_many(one, one, 9).collect()] == [(1, "", 1, 1, 1.0, True)]
    assert search_many.search_many(one, one.limit(0)).count() == 0 and search_many.search_many(one.limit(0), one).count() == 0
    with pytest.raises(AnalyticsError):
        search_many.search_many(one, one, 0)
