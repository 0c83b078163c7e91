"""Spelling variants, hard negatives and the secret ledger against plain versions, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumbrook.llm import common, decontaminate, negatives, neighbours, queries, secrets, simhash, variants

from .test_operators import ODD, SCHEMA


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def ledger(spark):
    import uuid

    return f"{common.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


# --- spelling variants


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    """Near words by deletions: two are near if they share a result of one deletion at the same place, or one is the other's."""
    near = {w: set() for w in words}
    by_hole = {}
    for w in words:
        for i in range(len(w)):
            by_hole.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if w[:i] + w[i + 1 :] in near:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for same in by_hole.values():
        for w in same:
            near[w].update(v for v in same if v != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_variants_of_the_table_equal_the_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_vocabulary(rows))
    got = queries.op11_spelling_variants(spark, sf_dir).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(w[0] for w in want.values())


def test_variants_follow_forms_to_the_last_and_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(variants, "BUCKET_ROWS", 16)
    words = {"nation" + "a" * i: 1 for i in range(1, 30)} | {"nations": 40_000, "nationss": 4_000, "nationsss": 400, "aaaaaaa": 3, "aaaaaaaa": 2, "aaaaaaaaa": 30, "ééééééé": 2, "éééééééé": 20, "x" * 5000: 2, "x" * 5001: 25}
    words |= {f"stationz{a}{b}": 2 for a in "abcdefgh" for b in "abcdefghijk"}
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(words)
    assert next(r.root for r in got if r.word == "nationsss") == "nations"


def test_every_near_pair_of_random_words_is_found(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("ab"), rng.integers(7, 11))): int(rng.integers(2, 50)) for _ in range(400)}
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(words)


def test_count_filter_and_limits_decide(monkeypatch):
    """Members of a list that miss the overlap bound, or share grams only at other places, never reach verification."""
    asked = []
    monkeypatch.setattr(variants, "one_edit", lambda u, v: asked.append((u, v)) or True)
    words = ["stationary", "stationery", "stationxyz", "xxstations"]
    order = {w: sorted((int.from_bytes(g.encode(), "big") << 32) | i for i, g in enumerate(variants.grams(w))) for w in words}
    token = (int.from_bytes(b"ion", "big") << 32) | 4
    members = [(i, w, 0, [t for t in order[w] if t > token]) for i, w in enumerate(sorted(words[:3]))]
    list(variants.near_in_list(members, members, 10, 4))
    assert asked == []  # 'ion' is taken as the rarest shared gram; four more must come behind it
    token = min(order["stationary"])
    members = [(i, w, 0, [t for t in order[w] if t > token]) for i, w in enumerate(sorted(words))]
    list(variants.near_in_list(members, members, 10, token & 0xFFFFFFFF))
    assert ("stationary", "stationery") in asked and all("xxstations" not in p for p in asked)


def test_odd_rows_have_words_too(spark, odd, none):
    got = {r.word: r.n for r in variants.vocabulary(odd).collect()}
    assert got == plain_vocabulary([(r[0], r[1]) for r in ODD])
    assert variants.group_variants(variants.vocabulary(none)).count() == 0


# --- hard negatives


def plain_negatives(rows):
    """rows: (vec_id, label, whole vector); None ids come last among ties."""
    last = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    out = []
    for a, (vec_id, label, v) in enumerate(rows):
        if vec_id is None or vec_id % 100:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=True)) for _, _, w in rows]
        by = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-score[i], last(i)))
        for p in [i for i in by if rows[i][1] == label][:5]:
            fit = [i for i in by if rows[i][1] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(vec_id, rows[p][0], rank, rows[i][0], score[p], score[i]) for rank, i in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("block_rows", [16, None])
def test_negatives_equal_all_scores(spark, block_rows, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 300
    rows = [(int(i), int(rng.integers(0, 4)), np.floor(centres[rng.integers(0, 6)] + rng.normal(size=5) * 40).astype(int).tolist()) for i in rng.integers(0, 900, 300) * 10]
    rows += [(100, 1, [7, 7, 7, 7, 7])] * 40 + [(None, 2, [9, 9, 9, 9, 9]), (None, 1, [9, 9, 9, 9, 9]), (200, 1, [0, 0, 0, 0, 0])]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, label long, v array<int>"), F.col("vec_id") % 100 == 0, block_rows=block_rows)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows)


def test_rows_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(100, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.25], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [0.5, 0.2], None), (8, [0.5], 2), (9, [3e38, 1.0], 2), (10, [], 2), (11, [-3e38, 1.0], 2)]
    found = negatives.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, [230, 128]), (2, 2, [128, 64]), (100, 1, [256, 128])]
    got = negatives.mine(found, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, 256 * 230 + 128 * 128, 256 * 128 + 128 * 64)]
    assert negatives.mine(found.where("vec_id is null"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(found, F.col("vec_id") == 77).count() == 0


def test_intervals_hold_every_product_and_prune(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 16)
    rng = np.random.default_rng(1)
    x, y = np.floor(rng.normal(size=(200, 4)) * 100 + 500), np.floor(rng.normal(size=(3000, 4)) * 100)
    labels = np.zeros(200, int), np.arange(3000) % 3
    stack = [(negatives.grow(x, labels[0]), negatives.grow(y, labels[1]))]
    for a, b in stack[:50]:
        scores = x[a.at] @ y[b.at].T
        low, high = negatives.interval(a, b)
        assert low <= scores.min() and scores.max() <= high
        stack += [(p, q) for p in a.children or (a,) for q in b.children or (b,) if a.children or b.children]
    import pyarrow as pa

    table = pa.table({"row": np.arange(200), "label": labels[0], "v": x.astype(int).tolist(), "low": np.full(200, -negatives.FAR), "high": np.full(200, negatives.FAR)})
    asked = negatives.Requests(table, 4)
    scored = negatives.search_block(asked, y, np.arange(1000, 4000), np.arange(3000), labels[1], True, 5)
    assert scored < 0.5 * 200 * 3000  # whole groups of anchors are done with most of the candidates
    for r in (0, 77, 199):
        fit = [i for i in range(3000) if i % 3 == 0]
        best = sorted(((-int(x[r] @ y[i]), i) for i in fit))[:5]
        assert [(s, i) for s, i, _ in asked.best[r]] == best


def test_scores_beyond_doubles_are_exact():
    x = np.array([[2.0**30 + 1, 3.0]])
    assert negatives.inner(x, x)[0, 0] == (2**30 + 1) ** 2 + 9


# --- secrets


def plain_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


HARD = [
    "", None, "token: token = abcdefghijklmnop", "SECRET='0123456789abcdef0123' Passwd  :  \"aaaaaaaaaaaa\"", "x AKIAABCDEFGHIJKLMN AKIAABCDEFGHIJKLM AKIA", "日本 token=ABCDEFGHIJKL 😀 0123456789abcdef", "api_key==abcdefghijklm apikey:=abcdefghijkl",
    "AKIA" * 10, "deadbeef" * 5000, "toKen = Kabcdefghijklmnop", "token = short1, token = " + "a" * 12, "ghp_" + "z" * 36 + " xoxb-1234567890-abc", "token=0123456789abcdef0123456789abcdef",
]


def said(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def test_spans_equal_plain_matching(spark, ledger):
    rows = [(i, i, t) for i, t in enumerate(HARD)] * 2
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, spans long, text string"), ledger, ["doc_id"])
    told = got.select("path.doc_id", secrets.listed(F.col("spans"), secrets.BASE).alias("base"), secrets.listed(F.col("spans"), secrets.RULES).alias("every")).collect()
    assert sorted((r.doc_id, r.base) for r in told) == sorted((i, said(plain_spans(t))) for i, _, t in rows)
    assert {r.every for r in told if r.doc_id == 11} == {"forge:0:40,chat:41:60"}


def test_documents_are_told_with_their_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op13_secret_ledger(spark, sf_dir).collect())
    want = Counter()
    for doc_id, text in rows:
        spans = plain_spans(text)
        kinds = Counter(s[2] for s in spans)
        want[doc_id, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(said(spans).encode()).hexdigest()] += 1
    assert got == want


def test_only_unseen_blobs_and_rule_versions_are_scanned(spark, ledger):
    schema = "path string, text string"
    first = spark.createDataFrame([("a", "token=ABCDEFGHIJKL"), ("b", "nothing"), ("c", "token=ABCDEFGHIJKL")], schema)
    later = first.unionByName(spark.createDataFrame([("d", "AKIAABCDEFGHIJKLMN"), ("e", "nothing")], schema))
    rows = lambda: spark.read.schema(secrets.LEDGER).parquet(ledger)
    spans = lambda df: sorted((r.path.path, [tuple(s) for s in r.spans]) for r in df.collect())
    one = spans(secrets.scan(first, ledger, ["path"]))
    assert one == [("a", [("assign@1", 0, 18)]), ("b", []), ("c", [("assign@1", 0, 18)])] and rows().count() == 2
    assert spans(secrets.scan(first, ledger, ["path"])) == one and rows().count() == 2
    two = secrets.scan(later, ledger, ["path"])
    assert spans(two) == [*one, ("d", [("access@1", 0, 18)]), ("e", [])] and rows().count() == 3
    raised = (secrets.Rule("assign", "token=[A-Z]{5}", version=2), *secrets.RULES[1:])
    assert spans(secrets.scan(later, ledger, ["path"], rules=raised))[0] == ("a", [("assign@2", 0, 11)])
    assert sorted(len(r.scanned) for r in rows().collect()) == [1, 1, 1, 7, 7, 7]  # the new rule-version alone


def test_secrets_of_odd_rows(spark, odd, none, ledger):
    assert sorted(str(r.path.doc_id) for r in secrets.scan(odd, ledger, ["doc_id"]).collect()) == sorted(str(r[0]) for r in ODD)
    assert secrets.scan(none, ledger + "-none", ["doc_id"]).count() == 0


def test_native_plans_have_no_python(spark, odd, ledger):
    plan = secrets.scan(odd, ledger, ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- rows that used to go wrong


def test_repeated_query_rows_have_ranks_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [rows[100], rows[100], rows[7]]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert Counter(r.query_id for r in got) == {0: 10, 100: 30, 200: 10}
    for query in (0, 100, 200):
        own = next(i for i, r in enumerate(rows) if r[0] == query)
        want = sorted((float(np.linalg.norm(np.array(v) - rows[own][1])), i) for at, (i, v) in enumerate(rows) if at != own)[:10]
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])
        times = 3 if query == 100 else 1
        assert [r.vec_id for r in mine] == [i for _, i in want for _ in range(times)] and [r["rank"] for r in mine] == [n for n in range(1, 11) for _ in range(times)]


def test_stages_take_columns_of_any_name_and_type(spark, sf_dir):
    rows = [(1, "a b c d e", "x", ({"k": 1}, 2), [{"m": 2}]), (1, "a b c d e", "y", ({"k": 1}, 2), [{"m": 2}]), (2, None, None, None, None), (3, None, "z", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad string, s struct<m:map<string,int>,n:int>, a array<map<string,int>>").withColumnsRenamed({"a": "key.of"})
    clean = decontaminate.keep_clean(docs, spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 2]
