"""An index that is changed by content hash: what is written, what readers see, and what an interrupted job leaves."""

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import StoreError
from sumbrook.sources.index import ChunkIndex


def chunked(documents):
    return documents.select("document_id", F.posexplode(F.split("text", " ")).alias("chunk_index", "text"))


@pytest.fixture
def place(tmp_path):
    return tmp_path / "index"


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "document_id string, text string")


def told(index):
    found = index.chunks()
    return {} if found is None else {r.document_id: r.words for r in found.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c.text), " ").alias("words")).collect()}


def test_only_what_changed_is_written(spark, place):
    index = ChunkIndex(spark, place.as_uri(), chunked, 4)
    assert index.chunks() is None and index.documents().count() == 0 and index.delete(docs(spark, a="x")) == 0
    texts = {f"d{i}": f"some words {i}" for i in range(20)}
    assert index.upsert(docs(spark, **texts)) == 20 and told(index) == texts
    files = lambda: sorted(str(p) for p in place.rglob("*"))
    before = files()
    assert index.upsert(docs(spark, **texts)) == 0 and files() == before  # nothing is written
    assert index.upsert(docs(spark, d3="other words", d99="new")) == 2
    assert told(index) == texts | {"d3": "other words", "d99": "new"}
    generations = index._manifest()["generations"]
    assert len(set(generations.values())) == 2 and index.documents().count() == 21
    assert index.delete(docs(spark, d3="", gone="")) == 1
    changed = {b for b, g in index._manifest()["generations"].items() if g != generations[b]}
    assert len(changed) == 1 and told(index) == {k: v for k, v in texts.items() if k != "d3"} | {"d99": "new"}
    assert index.clean() and told(index)["d99"] == "new" and ChunkIndex(spark, place.as_uri(), chunked, 9).buckets == 4


def test_an_interrupted_job_leaves_the_old_index_and_is_made_good(spark, place, monkeypatch):
    index = ChunkIndex(spark, place.as_uri(), chunked, 2)
    index.upsert(docs(spark, a="one", b="two"))
    commit = index._commit
    monkeypatch.setattr(index, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.upsert(docs(spark, a="three"))
    assert told(ChunkIndex(spark, place.as_uri(), chunked)) == {"a": "one", "b": "two"}
    monkeypatch.setattr(index, "_commit", commit)
    assert index.upsert(docs(spark, a="three")) == 1 and told(index) == {"a": "three", "b": "two"}
    assert any(name.startswith("chunks/") for name in index.clean()) and told(index) == {"a": "three", "b": "two"}


def test_two_writers_at_once(spark, place):
    index = ChunkIndex(spark, place.as_uri(), chunked, 2)
    index.upsert(docs(spark, a="one"))
    before = index._manifest()
    index.upsert(docs(spark, a="two"))
    with pytest.raises(StoreError):
        index._commit(before, before["generations"])
    assert told(index) == {"a": "two"}


def test_documents_without_text(spark, place):
    index = ChunkIndex(spark, place.as_uri(), chunked, 2)
    assert index.upsert(docs(spark, a=None, b="")) == 2 and index.upsert(docs(spark, a="", b=None)) == 0
    assert index.delete(docs(spark, a="", b="")) == 2 and told(index) == {} and index.documents().count() == 0
