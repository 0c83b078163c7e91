"""The pipeline's stages against plain versions of what each decides on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sumbrook.llm import language
from sumbrook.llm.common import cut

from .test_operators import ODD, SCHEMA, check_shards, plain_components, plain_fingerprint, plain_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    kept.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        kept.append(docs.collect())
    return kept


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    assert all(list(rows[0].asDict()) == COLUMNS for rows in stages[:-1])


def test_language_stage_keeps_what_a_learned_language_fits(spark, sf_dir, stages):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names, _, _, fits = model.predict([(r.text or "").encode() for r in stages[0]])
    assert ids(stages[1]) == sorted(r.doc_id for r, n, f in zip(stages[0], names, fits, strict=True) if n != "und" and f >= language.FITS)
    assert len(stages[1]) >= 0.95 * sum(any(c.isalpha() for c in r.text or "") for r in stages[0])


def test_language_stage_rejects_other_scripts_and_jumbles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    strange = spark.createDataFrame([(-1, "καλημέρα κόσμε τι κάνεις σήμερα", None, "s", 1), (-2, "今日は良い天気ですね", None, "s", 1), (-3, "123 456", None, "s", 1), (-4, None, "en", "s", 1)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(strange), sf_dir)
    assert kept.where("doc_id < 0").count() == 0


def test_one_document_of_each_group_stays(stages):
    fps = {r.doc_id: plain_fingerprint(r.text) for r in stages[1]}
    root, least = plain_components(fps.values()), {}
    for doc_id in sorted(fps):
        least.setdefault(root[fps[doc_id]], doc_id)
    assert ids(stages[2]) == sorted(least.values())


def test_contaminated_documents_go(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {x[0] for x in plain_hits([(r.doc_id, r.text) for r in stages[2]], items) if x[5]}
    assert bad and ids(stages[3]) == sorted(r.doc_id for r in stages[2] if r.doc_id not in bad)


def test_mix_repeats_documents_by_source(stages):
    before, times = {r.doc_id: r for r in stages[3]}, Counter(r.doc_id for r in stages[4])
    assert set(times) <= set(before) and max(times.values()) == 2 and all(before[r.doc_id] == r for r in stages[4])
    size, taken = defaultdict(int), defaultdict(int)
    for r in stages[3]:
        size[r.source] += len(r.text.encode().split())
    for r in stages[4]:
        taken[r.source] += len(r.text.encode().split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05) and all(taken[s] <= 2 * size[s] for s in size)


def test_shards_of_the_mix(stages):
    check_shards(stages[5])
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=str) == sorted(map(tuple, stages[5]), key=str)


def test_odd_and_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "the cat sat")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = cut(stage(spark, docs, str(tmp_path)))
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
        left = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
        assert left > 0 if rows else left == 0
