"""Business context from indexed fragments: definitions, events, citations, upkeep of the index."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE = 500
EVENTS = 2
# fixed values: words of events and of times, for picking sentences
EVENT_WORDS = r"(?iuU)обновлен|инцидент|сбо[йяею]|запуск|акци[яию]|миграц|отключ|внедр|изменен|release|incident|outage|launch|update|migration"
TIME_WORDS = r"(?iuU)\b20\d\d\b|январ|феврал|март|апрел|\bма[йяе]\b|июн|июл|август|сентябр|октябр|ноябр|декабр|квартал|недел|January|February|March|April|May|June|July|August|September|October|November|December|quarter|week"
SENTENCE = r"(?<=[.!?])\s+"


def definition(hits: DataFrame, terms: list[str], require_all: bool = False) -> DataFrame:
    """The first relevant hit (rank, relevant, chunk_id, text) that names one, or all, of the terms, with its quote."""
    named = [F.contains(F.lower("text"), F.lit(t.lower())) for t in terms]
    fits = reduce(and_ if require_all else or_, named)
    return hits.where(F.col("relevant") & fits).orderBy("rank", "chunk_id").limit(1).select("chunk_id", F.substring("text", 1, QUOTE).alias("quote"))


def event_context(hits: DataFrame, used: DataFrame, n: int = EVENTS) -> DataFrame:
    """The first n relevant hits that serve as no definition."""
    return hits.where("relevant").join(used.select("chunk_id"), "chunk_id", "left_anti").orderBy("rank", "chunk_id").limit(n)


def query_hits(hits: DataFrame, only_relevant: bool = True) -> DataFrame:
    """rank, chunk_id, quote, score of the hits of a search, in their order: the relevant ones, or all."""
    kept = hits.where("relevant") if only_relevant else hits
    return kept.select("rank", "chunk_id", F.substring("text", 1, QUOTE).alias("quote"), "score").orderBy("rank", "chunk_id")


def event_sentences(text: Column) -> Column:
    """The sentences that name an event and a time."""
    return F.filter(F.split(text, SENTENCE), lambda s: s.rlike(EVENT_WORDS) & s.rlike(TIME_WORDS))


def citations(insights: DataFrame) -> DataFrame:
    """citation, titles of (title, citations): the insights that cite each fragment."""
    return insights.select("title", F.explode("citations").alias("citation")).groupBy("citation").agg(F.array_sort(F.collect_set("title")).alias("titles"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, datasets of an index."""
    return chunks.agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"), F.count_distinct(F.nullif("dataset_id", F.lit(""))).alias("datasets"))


def without(chunks: DataFrame, document_id: str | None = None, dataset_id: str | None = None) -> DataFrame:
    """The index without a document or a dataset; write it over the partition it came from."""
    gone = F.lit(False)
    if document_id is not None:
        gone |= F.col("document_id").eqNullSafe(document_id)
    if dataset_id is not None:
        gone |= F.col("dataset_id").eqNullSafe(dataset_id)
    return chunks.where(~gone)


def stale_datasets(profiles: DataFrame, indexed: DataFrame) -> DataFrame:
    """Datasets (dataset_id, content_hash) that are not indexed under their present hash."""
    now = indexed.select("dataset_id", "content_hash").distinct()
    return profiles.join(now, ["dataset_id", "content_hash"], "left_anti")


def evidence_kinds(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, kind of (item_id, kind, chunk_id, quote, method): what can't be shown becomes an assumption.

    A document fact needs a quote that stands in its fragment, a computed one a method.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    joined = items.join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id", "left")
    quoted = F.coalesce((F.length(norm(F.col("quote"))) > 0) & F.contains(norm(F.col("_text")), norm(F.col("quote"))), F.lit(False))
    held = F.when(F.col("kind") == "document", quoted).when(F.col("kind") == "computed", F.coalesce(F.length("method") > 0, F.lit(False))).otherwise(True)
    return joined.select("item_id", F.when(held, F.col("kind")).otherwise("assumption").alias("kind"))
