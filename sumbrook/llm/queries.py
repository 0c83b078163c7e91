"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fixity, language, mixing, negatives, neighbours, quality, scoring, secrets, sharding, simhash, variants
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = scoring.score_texts(docs, ~scoring.held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    found = language.identify(docs, language.train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.held_out(F.col("doc_id"))
    labels = _table(spark, sf_dir, "labels")
    ranked = quality.rank_quality(_table(spark, sf_dir, "documents"), labels.where(~out))
    return ranked.select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica in which the pages whose id leaves 17 modulo 1000 have one more byte at their end."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 1000 == 17, F.concat(F.coalesce("html", F.lit("")), F.lit("~"))).otherwise(F.col("html"))
    return fixity.audit(pages, pages.withColumn("html", damaged))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words, items and the verdict of each document; null and blank texts have none."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], rows.schema)
    nodes = chat.cut(chat.chain(rows.unionByName(extra)))
    formatted = chat.format_paths(nodes, chat.branches(nodes))
    turns = formatted.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.vocabulary(_table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.whole_vectors(_table(spark, sf_dir, "embeddings"))
    swapped = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", swapped), F.col("vec_id") % 100 == 0)


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as first versions: every blob is scanned once and the findings joined back to all documents."""
    found = secrets.scan(_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", ["doc_id"])
    count = lambda r: F.size(F.filter("spans", lambda s: s.rule == r.key)).cast("long").alias(f"n_{r.name}")
    return found.select(F.col("path.doc_id").alias("doc_id"), *map(count, secrets.BASE), F.sha2(secrets.listed(F.col("spans"), secrets.BASE), 256).alias("base_sha256"), secrets.listed(F.col("spans"), secrets.RULES).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_backoff_scores, op2_multi_index, op3_label_sharding, op4_language, op5_quality, op6_merkle_fixity, op7_mixing, op8_decontamination, op9_reply_trees, op10_covering_simhash, op11_spelling_variants, op12_hard_negatives, op13_secret_ledger)
    return {f.__name__: f for f in found}


ORACLE_SQL: dict[str, str] = {
    "op12_hard_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
        )
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", other AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
    """,
    "op13_secret_ledger": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
        ), rules(k, kind, pattern, part, least) AS (
            VALUES (1, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
                   (2, 'access', '()(AKIA[A-Z0-9]+)', 2, 18), (3, 'hex', '()([0-9a-f]{16,})', 2, 16), (4, 'forge', '()(gh[pousr]_[A-Za-z0-9]{36,})', 2, 1), (5, 'chat', '()(xox[abprs]-[A-Za-z0-9-]{10,})', 2, 1),
                   (6, 'jwt', '()(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 2, 1), (7, 'private', '()(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)', 2, 1)
        ), cut AS (
            SELECT r, k, kind, least, regexp_extract_all(text, pattern, 0) AS said, regexp_extract_all(text, pattern, 2) AS part, string_split_regex(text, pattern) AS gaps FROM d, rules WHERE regexp_matches(text, pattern)
        ), each AS (
            SELECT r, k, kind, least, i, length(said[i]) AS size, length(part[i]) AS held, length(gaps[i]) AS gap FROM cut, unnest(range(1, len(said) + 1)) t(i)
        ), placed AS (
            SELECT *, CAST(sum(gap + size) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS upto FROM each
        ), fit AS (
            SELECT r, k, kind, upto - size AS since, kind || ':' || (upto - size) || ':' || upto AS said FROM placed WHERE held >= least
        ), told AS (
            SELECT r, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex,
                   string_agg(said, ',' ORDER BY since, k) FILTER (k <= 3) AS base, string_agg(said, ',' ORDER BY since, k) AS spans FROM fit GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
    """,
    "op9_reply_trees": r"""
        WITH every AS (
            SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), turns AS (
            SELECT *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + length(role) + 14 AS chars FROM every
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
    "op8_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
        ), windows AS (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS said, least(len(w), 13) AS n FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0
        ), places AS (
            SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS said FROM d, (SELECT DISTINCT n FROM windows) l, unnest(range(1, len(w) - n + 2)) t(i)
        ), hits AS (
            SELECT r, i, p.n, item_id FROM places p JOIN windows x ON p.said = x.said AND p.n = x.n
        ), covered AS (
            SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) u(k) GROUP BY r
        ), items AS (
            SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
}
