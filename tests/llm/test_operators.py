"""Each operator against a plain version, and its edge cases on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sumbrook.llm import chat, components, decontaminate, fixity, language, mixing, neighbours, quality, queries, scoring, sharding, simhash

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size int, g string"
ODD = [
    (1, None, None, None, 0, "x", 1, "g"), (2, "", "en", "s", 0, "x", 1, "g"), (3, " \t\n ", "en", "s", 3, None, None, None), (4, "the cat sat on the mat and so on", "en", None, 1, "x", 1, "g"),
    (5, "the cat sat on the mat and so on", None, "t", 1, "x", 1, "g"), (5, "the cat sat on the mat and so on", None, "t", 1, "x", 1, "g"), (None, "Überall ÄÖÜ 日本語 текст", "de", "t", 1, "x", 1, "g"),
    (7, "1234 5678 !!", "en", "u", 1, "x", 1, "g"), (8, "word " * 40_000, "en", "u", 1, "x", 1, "g"), (9, "one", "en", "s", 1, "x", 1, "g"), (10, "der hund und die katze", "de", "t", 1, "x", 1, "g"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def keyed(df):
    return {r[0]: r for r in df.collect()}


# --- language-model scores


def plain_scores(rows, train, order=3):
    """Walks the texts word by word through dictionaries: the longest known history first, then down its failure arcs."""
    texts = [(r, [t.lower() for t in BLANK.findall((r.text or "").encode())] + [None]) for r in rows]
    counts = [Counter() for _ in range(order)]
    for r, t in texts:
        if train(r):
            begun = ["^", *t]
            for i in range(1, len(begun)):
                for k in range(min(order, i + 1)):
                    counts[k][tuple(begun[i - k : i + 1])] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    levels = [0] + [scoring.DISCOUNT * len(counts[k]) / max(1, sum(c ** scoring._growth(k) for c in counts[k - 1].values())) for k in range(1, order)]
    seen = lambda h: counts[0][(None,)] if h == ("^",) else counts[len(h) - 1][h]

    def left(h):
        return min(max(levels[len(h)] * seen(h) ** (scoring._growth(len(h)) - 1), 1e-6), 0.999) if seen(h) else 1

    def smoothed(h, w):
        if not h:
            return (counts[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (1 - left(h)) * counts[len(h)][(*h, w)] / max(1, seen(h)) + left(h) * smoothed(h[1:], w)

    out = []
    for r, t in texts:
        base, score, state = 0, 0, ("^",)
        for w in t:
            base += math.log10(smoothed((), w))
            while state and not counts[len(state)][(*state, w)]:
                score += math.log10(left(state))
                state = state[1:]
            score += math.log10(smoothed(state, w))
            state = (*state, w)[-(order - 1) :] if counts[0][(w,)] else ()
        out.append((r.doc_id, len(t), sum(counts[0][(w,)] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_traversal(spark, documents, order):
    docs = spark.createDataFrame(documents)
    got = keyed(scoring.score_texts(docs, ~scoring.held_out(F.col("doc_id")), order=order, block_bytes=100_000, bucket_bytes=70_000).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
    for doc_id, *want in plain_scores(documents, lambda r: zlib.crc32(str(r.doc_id).encode()) % 10 != 0, order):
        assert list(got[doc_id][1:4]) == want[:3]
        assert got[doc_id][4:] == pytest.approx(want[3:], rel=1e-9)


def test_scores_of_odd_rows(spark, odd, none):
    got = scoring.score_texts(odd, F.lit(True)).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert next(r for r in got if r.doc_id == 8).n_tokens == 40_001
    assert scoring.score_texts(none, F.lit(True)).count() == 0
    assert {r.score for r in scoring.score_texts(odd, F.lit(False)).collect()} == {0.0}


def test_held_out_scores_beat_the_base(spark, sf_dir):
    got = queries.op1_backoff_scores(spark, sf_dir).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_probabilities_add_up_to_one():
    texts = [b"a b a c", b"b a", b"a a b", b""]
    grams = scoring.Grams(texts, 3)
    counts = [np.bincount(grams.which[k][grams.which[k] >= 0], minlength=len(grams.distinct[k])) for k in range(3)]
    base = counts[0] / counts[0].sum()
    auto = scoring.Automaton(grams, counts, len(texts), base, [0.0, 0.6, 0.5])
    for state in range(len(auto.failure)):
        if state > 1 and not auto.keys[(auto.keys // auto.words) == state].size:
            continue  # ends of texts lead nowhere
        total = 0.0
        for word in range(auto.words):
            at, log = state, 0.0
            while (hit := np.flatnonzero(auto.keys == at * auto.words + word)).size == 0:
                log += auto.failure[at]
                at = auto.shorter[at]
            total += 10 ** (log + auto.logs[hit[0]])
        assert total == pytest.approx(1)


def test_scores_need_the_failure_arcs_and_the_carried_state():
    texts = [b"a b c a b d", b"b c", b"c a b"]
    grams = scoring.Grams(texts, 3)
    counts = [np.maximum(0, np.bincount(grams.which[k][grams.which[k] >= 0], minlength=len(grams.distinct[k])) - (k > 0)) for k in range(3)]
    base = counts[0] / counts[0].sum()
    auto = scoring.Automaton(grams, counts, 2, base, [0.0, 0.6, 0.5])
    want = auto.traverse()
    for name in ("failure", "shorter", "targets"):
        kept = getattr(auto, name)
        setattr(auto, name, np.zeros_like(kept))
        assert not np.allclose(auto.traverse(), want)
        setattr(auto, name, kept)


# --- neighbours


def plain_neighbours(vectors, queries_, k):
    for q in queries_:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(vectors[q], v, strict=True))), i) for i, v in vectors.items() if i != q)
        yield from ((q, rank, i, d) for rank, (d, i) in enumerate(far[:k], 1))


def test_neighbours_and_odd_vectors(spark):
    draw = random.Random(1)
    vectors = {i: [float(np.float32(draw.gauss(0, 1))) for _ in range(8)] for i in range(60)}
    vectors |= {100 + i: vectors[20] for i in range(15)}
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, [1.0] * 5), (800, None), (None, [1.0] * 8)]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df.withColumn("rank", F.lit("x")).withColumn("a", F.lit(1)), F.col("vec_id") % 20 == 0, recall=1.0).collect())
    want = sorted(plain_neighbours(vectors, [i for i in vectors if i % 20 == 0], 10))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])
    assert neighbours.search(df.where("vec_id >= 900"), F.lit(True)).count() == 0
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.search(df.where("vec_id in (0, 1, 2)"), F.lit(True)).count() == 6  # fewer candidates than k


def recall_of(df, got, ids, x):
    q = np.flatnonzero(ids % 100 == 0)
    far = neighbours._squared(x[q], x)
    far[np.arange(len(q)), q] = np.inf
    want = {(int(ids[i]), int(ids[j])) for i, row in zip(q, far, strict=True) for j in np.argsort(row)[:10]}
    found = {(r.query_id, r.vec_id) for r in got}
    exact = {(r.query_id, r.vec_id): r.score for r in got}
    at = {int(i): n for n, i in enumerate(ids)}
    assert all(s == pytest.approx(math.sqrt(((x[at[a]] - x[at[b]]) ** 2).sum())) for (a, b), s in exact.items())
    return len(found & want) / len(want)


def test_neighbours_of_the_table(spark):
    rows = neighbours.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    got = queries.op2_multi_index(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10 * (ids % 100 == 0).sum() and recall_of(spark, got, ids, x) >= 0.9


def test_neighbours_recall_and_heap_order(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert recall_of(spark, neighbours.search(df, F.col("vec_id") % 100 == 0).collect(), np.arange(3000), x.astype(float)) >= 0.9
    half = recall_of(spark, neighbours.search(df, F.col("vec_id") % 100 == 0, recall=0.5).collect(), np.arange(3000), x.astype(float))
    assert 0.35 < half < 0.75  # the cells decide what is found
    book = neighbours.Codebook(x.astype(float), 16)
    order = book.visit(x[0].astype(float), np.ones((16, 16), int), 256)
    a, b = neighbours._squared(x[:1, :8].astype(float), book.first)[0], neighbours._squared(x[:1, 8:].astype(float), book.second)[0]
    sums = [a[i] + b[j] for i, j in order]
    assert len(set(order)) == 256 and sums == sorted(sums)


# --- sharding


def check_shards(rows, shards=40):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_are_even_and_keep_groups(spark, documents):
    rows = sharding.shard_documents(spark.createDataFrame(documents)).collect()
    check_shards(rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents)
    texts, at = {r.doc_id: r.text for r in documents}, defaultdict(set)
    for r in rows:
        at[texts[r.doc_id]].add(r.shard)
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows"
    assert all(len(s) == 1 for s in at.values())


@pytest.mark.parametrize("copies", [0, 100, 300])
def test_shards_with_a_hot_group(spark, copies):
    rows = [(i, "copy" if i < copies else f"text {i // 3}") for i in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=7).collect()
    check_shards(got, 7)
    least = -(-copies // (300 // 7))
    # here every document is linked, so small groups hold part of the large one's homes
    assert not copies or len({r.shard for r in got if r.doc_id < copies}) <= least + 2


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_documents(odd).collect()
    check_shards(rows)
    assert len(rows) == len(ODD) and next(r for r in rows if r.doc_id == 1).size == 16
    assert sharding.shard_documents(none).count() == 0


# --- language


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op4_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got > 0.93


def test_language_spans_and_scripts(spark):
    draw = random.Random(2)
    pools = {"aa": ["bana", "lama", "sana", "mata"], "bb": ["krost", "blirp", "strund", "wrelk"], "cc": ["мир", "слово", "дом"]}
    rows = [(i, " ".join(draw.choices(pools[k], k=30)), k) for i, k in enumerate(["aa", "bb", "cc"] * 10)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = " ".join(["lama sana bana mata"] * 5 + ["krost strund wrelk blirp"] * 5)
    names, shares, spans, fits = model.predict([text.encode(), "слово krost".encode(), "12 34".encode(), b""])
    assert spans[0] == [(0, 20, "aa"), (20, 40, "bb")] and names[0] == "bb" and shares[0] < 0.7
    assert names[2:] == ["und", "und"] and shares[2:] == [0, 0]
    assert fits[0] == shares[0] and fits[2:] == [0, 0]
    mixed = " ".join(["bana lama sana"] * 8 + ["krost blirp strund"] * 6 + ["мир слово дом"] * 8)
    odd = [(1, "lama sana bana", 7), (2, "γειά σου κόσμε", 7), (3, mixed, 7), (4, "12", 7), (5, None, 7), (6, "слово дом 日", 7)]
    got = language.keep_known(spark.createDataFrame(odd, "doc_id long, text string, n_spans int"), model)
    assert got.columns == ["doc_id", "text", "n_spans"] and sorted(r.doc_id for r in got.collect()) == [1, 6]
    labelled = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [tuple(s) for s in labelled.spans] == spans[0]
    assert not model.uses[model.langs.index("cc"), language.SCRIPT_NAMES.index("latin")]


def plain_viterbi(emit, penalty):
    best, back = emit[0].copy(), []
    for e in emit[1:]:
        top = best.argmax()
        change = best[top] - penalty
        back.append([int(top) if change > best[s] else s for s in range(len(best))])
        best = np.maximum(best, change) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_viterbi_equals_plain(spark, documents):
    model = language.train(spark.createDataFrame(documents))
    texts = [r.text.encode() for r in documents[:40]]
    found, labels = model.labels(texts)
    emit, at = model.emissions(found)[found.codes], 0
    for n in found.counts:
        assert labels[at : at + n].tolist() == plain_viterbi(emit[at : at + n], language.PENALTY)
        at += n


def test_language_of_odd_rows(odd, none):
    rows = language.identify(odd, language.train(odd)).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 7)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(none, empty).count() == 0


# --- quality


def test_quality_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.op5_quality(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (5, 1), (5, 0), (None, 1), (77, 1), (10, 1)], "doc_id long, quality int")
    rows = quality.rank_quality(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 4).score > next(r for r in rows if r.doc_id == 8).score
    assert len({r.score for r in quality.rank_quality(odd, labels.limit(0)).collect()}) == 1
    assert quality.rank_quality(none, labels).count() == 0


def test_quality_score_equals_numpy(spark, documents):
    described = quality.describe(spark.createDataFrame(documents))
    x = np.array([r.features for r in described.collect()])
    good = np.arange(len(x)) % 5 > 0
    model = quality.Ranking(x, good, pairs=2000)
    raw = ((model._wide(x) - model.mean) / model.spread) @ model.weight
    want = 1 / (1 + np.exp(-(raw - model.cut + math.log(0.7 / 0.3))))
    got = [r.s for r in described.select(model.score(F.col("features")).alias("s")).collect()]
    assert got == pytest.approx(want.tolist())
    assert abs((raw >= model.cut).mean() - good.mean()) < 0.02


# --- fixity


def test_fixity_finds_exactly_the_damage(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bad = F.col("page_id").isin(3, 17, 40)
    replica = pages.withColumn("html", F.when(bad, F.concat(F.lit("x"), F.substring("html", 2, 10**6))).otherwise(F.col("html")))
    for files in (1, 3):
        rows = fixity.audit(pages, replica, files).collect()
        assert len(rows) == pages.count() and {r.page_id for r in rows if r.state != "same"} == {3, 17, 40}
        plain = {r.page_id: r for r in rows}
        for r in fixity.records(pages).collect():
            assert plain[r.page_id].digest == hashlib.sha256(r.record).hexdigest() and plain[r.page_id].length == len(r.record)
    by = sorted((r.file, r.seq, r.offset, r.length) for r in rows)
    assert all(b[2] == (a[2] + a[3] if a[0] == b[0] else 0) for a, b in zip(by, by[1:], strict=False))


def test_fixity_of_missing_and_odd_records(spark):
    rows = [(i, f"u{i}", "x" * i) for i in range(40)] + [(None, None, None), (5, "u5", "x" * 5)]
    one = spark.createDataFrame(rows, "page_id long, url string, html string")
    short = one.where("page_id < 39 or page_id is null")
    assert Counter(r.state for r in fixity.audit(one, short, 1).collect()) == {"same": 41, "missing": 1}
    assert Counter(r.state for r in fixity.audit(short, one, 1).collect()) == {"same": 41, "added": 1}
    assert {r.state for r in fixity.audit(one, one, 2).collect()} == {"same"}
    assert fixity.audit(one.limit(0), one.limit(0)).count() == 0
    assert {r.state for r in fixity.audit(one, one.limit(0), 2).collect()} == {"missing"}


def test_fixity_locates_added_and_lost_bytes(spark, sf_dir):
    got = queries.op6_merkle_fixity(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id for r in pages.collect() if r.page_id % 1000 == 17}
    assert len(got) == pages.count() and want and {(r.page_id, r.state) for r in got if r.state != "same"} == {(i, "changed") for i in want}
    ends = {f: min(r.offset for r in got if r.file == f and r.state != "same") for f in {r.file for r in got if r.state != "same"}}
    assert all(r.moved == (r.file in ends and r.offset > ends[r.file]) for r in got)
    lost = [r for r in fixity.audit(pages, pages.where("page_id <> 20"), 1).collect() if r.state != "same"]
    assert [(r.page_id, r.state) for r in lost] == [(20, "missing")]
    new = [r for r in fixity.audit(pages.where("page_id <> 20"), pages, 1).collect() if r.state != "same"]
    assert [(r.page_id, r.state) for r in new] == [(20, "added")]


def test_fixity_of_a_page_that_fills_files(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RECORDS_PER_FILE", 20)
    rows = [(3, "u", "same")] * 150 + [(i, "u", "x" * 50_000 if i == 9 else f"page {i}") for i in range(60)]
    one = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, seq int, file string")
    got = fixity.audit(one, one.where("page_id <> 40")).collect()
    assert len(got) == len(rows) and [(r.page_id, r.state) for r in got if r.state != "same"] == [(40, "missing")]
    assert max(Counter(r.file for r in got).values()) < 60
    changed = one.withColumn("html", F.when(F.col("page_id") == 9, F.concat("html", F.lit("y"))).otherwise(F.col("html")))
    assert [(r.page_id, r.state) for r in fixity.audit(one, changed).collect() if r.state != "same"] == [(9, "changed")]


def test_fixity_reads_only_children_of_what_differs(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(400)], "page_id long, url string, html string")
    replica = pages.withColumn("html", F.when(F.col("page_id") == 123, F.lit("other")).otherwise(F.col("html")))
    mine, theirs = (fixity.cut(fixity._leaf_of(fixity.archive(fixity.records(side), 1))) for side in (pages, replica))
    trees = [fixity.content_tree(side) for side in (mine, theirs)]
    assert [t.count() for t in trees[0]] == [mine.select("leaf").distinct().count(), 16, 1]
    read, below = [], fixity._below
    monkeypatch.setattr(fixity, "_below", lambda level, bad: read.append(below(level, bad).count()) or below(level, bad))
    assert [r.node for r in fixity.compare(*trees).collect()] == [mine.where("page_id = 123").first().leaf]
    assert len(read) == 4 and max(read) <= 16
    del read[:]
    assert fixity.compare(trees[0], trees[0]).count() == 0 and fixity.compare(fixity.offset_tree(mine), fixity.offset_tree(mine)).count() == 0
    assert read == []  # of equal replicas only roots are joined


def test_fixity_moves_no_leaf_for_lost_records(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(400)], "page_id long, url string, html string")
    mine, theirs = (fixity.cut(fixity._leaf_of(fixity.archive(fixity.records(side), 1))) for side in (pages, pages.where("page_id not in (5, 6)")))
    lost = {r.leaf for r in mine.where("page_id in (5, 6)").collect()}
    assert {r.node for r in fixity.compare(fixity.content_tree(mine), fixity.content_tree(theirs)).collect()} == lost
    got = fixity.audit(pages, pages.where("page_id not in (5, 6)"), 1).collect()
    assert {r.page_id for r in got if r.moved} == set(range(7, 400)) and {r.page_id for r in got if r.state != "same"} == {5, 6}


def test_fixity_of_damaged_copies(spark):
    schema = "page_id long, url string, html string"
    one = [(i, "u", "x" * i) for i in range(300)] + [(7, "u", t) for t in "abcde"] + [(None, "u", t) for t in "abc"]
    for old, new in [("a", "z"), ("c", "0"), ("e", "")]:
        other = [(7, "u", new) if r == (7, "u", old) else r for r in one if r != (None, "u", "b")]
        rows = fixity.audit(spark.createDataFrame(one, schema), spark.createDataFrame(other, schema), 1).collect()
        digest = {hashlib.sha256(r.record).hexdigest(): r.record.split(b"\r\n\r\n")[1].decode() for r in fixity.records(spark.createDataFrame(one, schema)).collect()}
        assert len(rows) == len(one) and sorted((r.page_id or 0, r.state, digest[r.digest]) for r in rows if r.state != "same") == [(0, "missing", "b"), (7, "changed", old)]


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows, texts):
    sizes = defaultdict(int)
    for _, source, text in texts:
        sizes[source] += len(BLANK.findall((text or "").encode()))
    want, source_of, taken = plain_targets(sizes), {i: s for i, s, _ in texts}, Counter()
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_mix_meets_targets(spark, documents):
    df = spark.createDataFrame(documents)
    for block in (7, 256):
        rows = mixing.mix(df, block).collect()
        assert len(rows) == len(documents)
        check_mix(rows, [(r.doc_id, r.source, r.text) for r in documents])
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    check_mix(rows, [(r[0], r[3], r[1]) for r in ODD])
    assert mixing.mix(none).count() == 0
    assert {r.target for r in mixing.mix(odd.where("doc_id < 4")).collect()} == {0.0}


def test_permutations(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_shards_draw_their_slots(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 512)
    _, sources, slots = mixing.plan_mix(spark.createDataFrame(documents), 16)
    wants = mixing.wanted(sources, 16)
    drawn, slots_of = mixing.draw(wants, 1, 4).collect(), {r._key: r.slots for r in wants.collect()}
    of, total, before = Counter(), sum(slots_of.values()), Counter()
    for r in sorted(drawn, key=lambda r: r.shard):
        assert r.before == before[r._key]
        before[r._key] += r["count"]
        of[r.shard] += r["count"]
    assert before == slots_of and [of[s] for s in range(len(of))] == [min(512, total - 512 * s) for s in range(len(of))] and len(of) > 5
    # the counts scatter around the shares, as a multinomial draw does
    gaps = [(r["count"] - of[r.shard] * slots_of[r._key] / total) / math.sqrt(of[r.shard] * slots_of[r._key] / total) for r in drawn if of[r.shard] == 512]
    assert 0.5 < np.std(gaps) < 1.5 and max(map(abs, gaps)) < 6
    rows = slots.collect()
    assert Counter((r._key, r.shard) for r in rows) == Counter({(r._key, r.shard): r["count"] for r in drawn})
    assert sorted((r.shard, r.position) for r in rows) == [(s, p) for s in sorted(of) for p in range(of[s])]
    assert max(Counter((r._key, r.block) for r in rows).values()) <= 2


def plain_taken(documents, slots, block, salts):
    """The words that the slots take of each document, whose streams are laid out one by one."""
    chain = lambda text: xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))
    streams, taken = defaultdict(list), Counter()
    for r in documents:
        turn = simhash._signed(chain(str(r.doc_id)))
        streams[r.source].append((turn % salts, turn, r.doc_id, len(BLANK.findall((r.text or "").encode()))))
    for source, docs in streams.items():
        stream = [doc_id for _, _, doc_id, n in sorted(docs) for _ in range(n)]
        for s in slots:
            if s._key == "=" + source:
                taken.update(stream[s.block * block : s.block * block + s.words])
    return taken


@pytest.mark.parametrize("block", [16, 256])
def test_taken_words_equal_a_plain_version(spark, documents, block):
    df = spark.createDataFrame(documents)
    want = plain_taken(documents, mixing.plan_mix(df, block)[2].collect(), block, 2048)
    assert {r.doc_id: r.taken for r in mixing.mix(df, block).collect()} == {r.doc_id: want[r.doc_id] for r in documents}


def test_packed_slots_hold_the_mix(spark, documents):
    df = spark.createDataFrame(documents)
    placed, sources, slots = mixing.plan_mix(df, 16)
    rows, size = mixing.packed(placed, sources, slots, 16).collect(), {r.doc_id: len(BLANK.findall((r.text or "").encode())) for r in documents}
    assert len(rows) == slots.count()
    held, words, source_of = Counter(), Counter(), {r.doc_id: r.source for r in documents}
    for r in rows:
        at = r.block * 16
        for s in r.spans:
            assert 0 <= s.begin < s.end <= size[s.doc_id] and s.start + s.begin == at and source_of[s.doc_id] == r.source
            at += s.end - s.begin
            held[s.doc_id] += s.end - s.begin
        assert at - r.block * 16 == r.words
        words[r.source] += r.words
    assert all(words[r.source] == round(r.target) for r in sources.collect())
    assert all(held[r.doc_id] == r.taken for r in mixing.mix(df, 16).collect())


def test_mixed_documents_of_odd_rows_and_names(odd, none):
    names = ["_times", "_copy", "_words", "_key", "_salt"]
    clash = odd.select("doc_id", "text", "source", *(F.lit(7).alias(n) for n in names))
    got = mixing.mixed_documents(clash)
    assert got.columns == clash.columns and {r.doc_id for r in got.collect()} <= {4, 5, None, 7, 8, 9, 10} and {r._copy for r in got.collect()} == {7}
    assert mixing.mixed_documents(none).count() == 0


def test_mixed_documents_meet_each_target(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(1500, 2500), f"s{i % 6}") for i in range(240)] + [(None, f"{i} " + "v " * 400, "s6") for i in range(60)]
    got, size, kept, longest = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect(), Counter(), Counter(), Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
        longest[source] = max(longest[source], len(text.split()))
    for r in got:
        kept[r.source] += len(r.text.split())
    assert set(Counter(map(tuple, got)).values()) <= {1, 2} and set(map(tuple, got)) <= set(rows)
    assert all(abs(kept[s] - t) <= longest[s] / 2 + 1 for s, t in plain_targets(size).items())


def test_mixed_documents_are_drawn_by_slots(spark, monkeypatch):
    """Documents of a pass that is cut short are those that the source's index permutation draws; shards hold their draws, in order."""
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 64)
    draw = random.Random(7)
    rows = [(i, "w " * draw.randint(5, 60), f"s{i % 3}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    slots, size, times, shards = mixing.mixed_slots(df).collect(), Counter(), Counter(), defaultdict(list)
    for r in slots:
        times[r.c0] += 1
        shards[r.shard].append(r.position)
    assert [len(shards[s]) for s in sorted(shards)] == [min(64, len(slots) - 64 * s) for s in range(-(-len(slots) // 64))] and all(sorted(p) == list(range(len(p))) for p in shards.values())
    for i, text, source, _ in rows:
        size[source] += len(text.split())
    chain = lambda i, text, source: xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(source.encode(), xxhash.xxh64_intdigest(str(i).encode(), xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42))))
    for source, target in plain_targets(size).items():
        turns = [(simhash._signed(chain(i, t, s)), i, len(t.split())) for i, t, s, _ in rows if s == source]
        stream = [(i, n) for _, _, i, n in sorted((t % 2048, t, i, n) for t, i, n in turns)]
        whole, left = divmod(round(target), size[source])
        places = spark.range(100).select(mixing.permuted(F.col("id"), F.lit(100).cast("long"), F.lit("=" + source), F.lit(whole).cast("long"), F.lit(1)).alias("p"), "id").orderBy("id").collect()
        want, start = Counter({i: whole for i, _ in stream}), 0
        for r in places:
            i, n = stream[r.p]
            want[i] += 2 * start + n <= 2 * left
            start += n
        assert {i: times[i] for i, _ in stream} == dict(want)
    ordered = [[x.doc_id for x in part] for part in mixing.mixed_documents(df).rdd.glom().collect()]
    said = [[r.c0 for r in sorted((r for r in slots if r.shard == s), key=lambda r: r.position)] for s in sorted(shards)]
    assert all(any(part[a : a + len(x)] == x for part in ordered for a in range(len(part))) for x in said)


# --- decontamination


def plain_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        t = WORD.findall((text or "").encode().lower())
        for i in range(max(1, len(t) - 12) if t else 0):
            windows[tuple(t[i : i + 13])].add(item)
    for doc_id, text in docs:
        t = WORD.findall((text or "").encode().lower())
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(t) - n + 1):
                if (own := windows.get(tuple(t[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        yield doc_id, len(t), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(t)


def digest(found):
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit, F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated(n_hit, F.col("n_words"))).collect()


@pytest.mark.parametrize("bits", [1 << 24, 1 << 10])  # a full bitmap loses nothing
def test_contamination_equals_plain(spark, sf_dir, documents, bits):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = digest(decontaminate.contamination(spark.createDataFrame(documents), benchmark, bits))
    want = list(plain_hits([(r.doc_id, r.text) for r in documents], [tuple(r) for r in benchmark.collect()]))
    assert sorted(map(tuple, got)) == sorted(want) and any(x[5] for x in want)


def test_contamination_of_odd_rows(spark, odd, none):
    words = "a b c d e f g h i j k l m n o p a b c d e f g h i j k l m n o p".split()
    items = [(1, " ".join(words)), (2, "cat sat"), (3, None), (4, "!!"), (None, "mat AND so"), (2, "cat sat"), (11, "word " * 13), (9, "日本語")]
    docs = odd.union(spark.createDataFrame([(50 + i, " ".join(words[i : i + 20]), None, None, 0, None, 0, None) for i in range(12)], SCHEMA))
    docs = docs.withColumn("key", F.lit("k")).withColumn("said", F.lit(1))
    got = digest(decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    want = list(plain_hits([(r.doc_id, r.text) for r in docs.collect()], items))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.spans or r.items for r in decontaminate.contamination(odd, bench).collect())
    spans = {r.doc_id: [tuple(x) for x in r.spans] for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert spans[4] == [(1, 3), (5, 8)] and spans[8] == [(0, 40_000)] and spans[9] == []
    bad = {i for i, r in zip((r.doc_id for r in docs.collect()), want, strict=True) if r[5]}
    assert Counter(r.doc_id for r in decontaminate.keep_clean(docs, spark.createDataFrame(items, "item_id long, text string")).collect()) == Counter(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    assert decontaminate.contamination(none, bench).count() == 0


# --- chat


def test_chat_round_trip(spark, sf_dir):
    rows, want = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), defaultdict(list)
    for r in rows:
        want[r.conv_id].append((r.turn, r.role, r.text or ""))
    want[-7] = [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")]
    got = queries.op9_reply_trees(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [x[1:] for x in sorted(want[r.conv_id])]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_chars == len(learned) and r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_reply_trees(spark):
    nodes = [(1, 0, None, 0.0), (1, 1, 0, 5.0), (1, 2, 0, 1.0), (1, 3, 1, 1.0), (1, 4, 2, 9.0), (1, 5, 4, 9.0), (1, 6, 99, 0.5), (None, 0, None, 1.0), (2, 0, None, None)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double")
    paths = defaultdict(list)
    for r in sorted(chat.branches(df, None).collect(), key=lambda r: r.at):
        assert r.at == len(paths[r.conv_id, r.branch, r.leaf])
        paths[r.conv_id, r.branch, r.leaf].append(r.node)
    got = sorted(((c, b, p) for (c, b, _), p in paths.items()), key=str)
    assert got == sorted([(1, 1, [0, 2, 4, 5]), (1, 2, [0, 1, 3]), (1, 3, [6]), (None, 1, [0]), (2, 1, [0])], key=str)
    assert chat.branches(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.pointers(spark.createDataFrame([(1, 0, 1, 0.0), (1, 1, 0, 0.0)], df.schema))


def test_reply_trees_of_random_replies(spark):
    draw, nodes = random.Random(9), []
    for conv in range(6):
        nodes += [(conv, i, draw.choice([i - 1, draw.randrange(i)]) if i else None, float(draw.randint(0, 5))) for i in range(draw.randint(1, 40))]
    of, want = {(c, n): (p, s) for c, n, p, s in nodes}, {}
    for conv in range(6):
        parents = {p for c, _, p, _ in nodes if c == conv}
        best = []
        for leaf in (n for c, n, _, _ in nodes if c == conv and n not in parents):
            path, at = [], leaf
            while at is not None:
                path.insert(0, at)
                at = of[conv, at][0]
            best.append((-sum(of[conv, n][1] for n in path) / len(path), -len(path), leaf, path))
        want |= {(conv, b): x[3] for b, x in enumerate(sorted(best)[:3], 1)}
    got = defaultdict(list)
    for r in sorted(chat.branches(spark.createDataFrame(nodes, "conv_id long, node long, parent long, score double"), 3).collect(), key=lambda r: r.at):
        got[r.conv_id, r.branch].append(r.node)
    assert got == want


def test_chat_of_an_empty_table(spark):
    nodes = chat.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.format_paths(nodes, chat.branches(nodes)).count() == 0


def test_chat_of_odd_turns(spark):
    texts = ["", None, "a\\b\\l<h#</turn>\n### user: x", "###", "\\", "line\nline", "x" * 30_000, "ü日本😀:"]
    rows = [(None if i % 2 else 4, i, ["assistant", "user:\n#", None][i % 3], t) for i, t in enumerate(texts)] + [(9, None, "assistant", "z")]
    nodes = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_paths(nodes, chat.branches(nodes)).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for conv in (None, 4, 9):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        got = next(r for r in done if r.conv_id == conv)
        assert [tuple(t) for t in got.turns] == own and got.learned == "".join(t for role, t in own if role == "assistant")


# --- near copies


def plain_fingerprint(text):
    t = [w.lower() for w in BLANK.findall((text or "").encode())]
    h = [xxhash.xxh64_intdigest(b" ".join(t[i : i + 3]), 42) for i in range(max(1, len(t) - 2))] if t else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    values, root = list(set(fps)), {}
    for v in values:
        root[v] = v

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_near_copies_equal_plain(spark, sf_dir, documents):
    got = queries.op10_covering_simhash(spark, sf_dir).collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in documents}
    root, least = plain_components(fps.values()), {}
    for doc_id, fp in sorted(fps.items()):
        least.setdefault(root[fp], doc_id)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp:016x}", least[root[fp]]) for d, fp in fps.items()}
    assert len({r.component_id for r in got}) < len(got)


def test_links_of_random_fingerprints(spark):
    draw, fps = random.Random(4), set()
    while len(fps) < 600:
        x = draw.getrandbits(64)
        for _ in range(draw.randint(1, 8)):
            fps.add(x)
            x ^= sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))) & ((1 << 64) - 1)
    signed = {simhash._signed(x): x for x in fps}
    edges = components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    got = {signed[r.u]: signed[r.root] for r in edges}
    want, groups = plain_components(fps), defaultdict(set)
    for x in fps:
        groups[want[x]].add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_need_every_table(spark, monkeypatch):
    tables = simhash.masks()
    pairs = [(0, (1 << a) | (1 << b)) for a in range(0, 64, 3) for b in range(a + 1, 64, 5)]
    fps = spark.createDataFrame([(simhash._signed(x),) for p in pairs for x in p], "fp long").distinct()
    count = lambda: simhash.links(fps).where("u = 0 or v = 0").count()
    every = components.components(simhash.links(fps)).count()
    assert every == len(pairs)
    monkeypatch.setattr(simhash, "masks", lambda: tables[:1])
    assert components.components(simhash.links(fps)).count() < every and count() < len(pairs)


def test_masks_cover_every_pair():
    masks = simhash.masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m & ((1 << a) | (1 << b)) for m in masks)


def test_near_copies_of_odd_rows(odd, none):
    rows = simhash.near_copies(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 7, 8, 9, 10]
    rows = [(5, "a b c d e", 1, 2), (5, "f g h i j", 1, 2), (5, "a b c d e", 1, 2), (None, "f g h i j", 3, 4), (None, "k l m n o", 3, 4), (None, "k l m n o", 3, 4), (6, "a b c d e", 0, 0)]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one(odd.sparkSession.createDataFrame(order, "doc_id long, text string, _kept int, fp int"))
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4]], key=str)
    assert simhash.near_copies(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {501: 500}
