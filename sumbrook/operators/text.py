"""Documents to sentences, chunks and vectors, in one pass over batches of rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalyticsError

MAX_CHARS, OVERLAP = 900, 120
SENTENCE_END = r"(?<=[.!?…])\s+"
DIM = 1024
# fixed values: words that the hash embedding leaves out, and the weights of its features
STOPWORDS = ["и", "в", "во", "на", "по", "с", "со", "к", "о", "об", "от", "для", "из", "за", "не", "что", "как", "это", "the", "of", "a", "an", "is", "are", "to", "in", "on", "for", "and", "or", "by", "what"]
WORD_WEIGHT, STEM_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.8, 0.3

_CHUNKS = "chunk_id string, document_id string, chunk_index int, page int, page_end int, section string, text string"


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: s != "")


def windows(lengths: np.ndarray, room: int, shared: int) -> list[tuple[int, int]]:
    """Greedy windows over items of these lengths: each as long as fits into room, but one item further than the last.

    A window starts with the last items of the one before it, as far as they fit into shared.
    """
    ends = np.concatenate(([0], np.cumsum(lengths)))
    found, low, done = [], 0, 0
    while done < len(lengths):
        done = max(done + 1, int(np.searchsorted(ends, ends[low] + room, "right")) - 1)
        found.append((low, done))
        low = max(low, int(np.searchsorted(ends, ends[done] - shared, "left")))
    return found


def _sentences(text: str, most: int) -> list[str]:
    """The sentences; the words of one that is longer than `most` are put into windows of their own."""
    out = []
    for said in re.split(SENTENCE_END, text):
        words = said.split() if len(said) > most else []
        sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        out += [" ".join(words[a:b]) for a, b in windows(sizes, most + 1, 0)] if words else [said]
    return out


def chunk_paragraphs(paragraphs: list[tuple[int, str]], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first page, last page, text) of the chunks of one section's (page, text).

    All sentences are laid out as one string, each behind the character that parts it from the one before; chunks are
    found from the lengths alone and cut from that string at the end.
    """
    pages, marks, said = [], [], []
    for page, text in paragraphs:
        own = _sentences(text, most)
        said += own
        pages += [page] * len(own)
        marks += ["\n", *" " * (len(own) - 1)]
    laid = "".join(m + s for m, s in zip(marks, said, strict=True))
    sizes = np.fromiter((len(s) + 1 for s in said), np.int64, len(said))
    at = np.concatenate(([0], np.cumsum(sizes)))
    return [(pages[a], pages[b - 1], laid[at[a] + 1 : at[b]]) for a, b in windows(sizes, most, overlap + 1)]


def outline(text: str) -> list[tuple[int, str, int, str]]:
    """(section, its heading, page, line) of plain or Markdown text: lines that begin with # are headings.

    Blank lines and lines that are only a page number go.
    """
    number, heading, out = 0, "", []
    for line in text.split("\n"):
        if re.match(r"#{1,6}\s+\S", line):
            number, heading = number + 1, re.sub(r"^#+\s+|\s+$", "", line)
        elif line.strip() and not re.fullmatch(r"\s*(?:page\s+)?\d{1,4}\s*", line):
            out.append((number, heading, 1, line.strip()))
    return out


def _chunked(found: Iterator[tuple[str, list[tuple[int, str, int, str]]]], most: int, overlap: int) -> pa.RecordBatch:
    out: list[tuple] = []
    for document, rows in found:
        n = 0
        for _, part in groupby(rows, key=lambda r: r[0]):
            own = list(part)
            for page, end, text in chunk_paragraphs([(r[2], r[3]) for r in own], most, overlap):
                out.append((f"{document}-{n:04d}", document, n, page, end, own[0][1], text))
                n += 1
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    columns = list(zip(*out, strict=True)) if out else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _CHUNKS.split(", ")])


def _check(most: int, overlap: int) -> None:
    if not 0 <= overlap < most:
        raise AnalyticsError("Chunking needs 0 <= overlap < most.")


def chunk_texts(documents: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, document_id, chunk_index, page, page_end, section, text of documents (document_id, text).

    Texts are plain or Markdown, as outline reads them. Sections are never mixed. Rows pass through in batches, without a
    shuffle; null texts give no chunk.
    """
    _check(most, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            yield _chunked(((i, outline(t or "")) for i, t in zip(ids, texts, strict=True)), most, overlap)

    return documents.select("document_id", "text").mapInArrow(run, _CHUNKS)


def chunk_documents(paragraphs: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """The same of paragraphs (document_id, section_index, section, seq, page, text), such as a reader of pages gives.

    A document's paragraphs are brought together by one shuffle: it is the unit that is chunked.
    """
    _check(most, overlap)
    row = F.struct("section_index", "seq", "section", "page", "text")
    documents = paragraphs.groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (c.to_pylist() for c in batch.columns)
            yield _chunked(((i, [(r["section_index"], r["section"], r["page"], r["text"]) for r in own]) for i, own in zip(ids, rows, strict=True)), most, overlap)

    return documents.mapInArrow(run, _CHUNKS)


def html_text(html: Column) -> Column:
    """All text of a page as Markdown lines: a line for each block or cell, headings behind #; scripts, styles and tags go."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "), r"\s+", " ")
    headed = F.regexp_replace(plain, r"(?i)<h[1-6]\b[^>]*>", "\n# ")
    blocks = F.regexp_replace(headed, r"(?i)</?(?:h[1-6]|p|div|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|caption|pre|blockquote|section|article|header|footer|main|nav|aside|figure|figcaption|form|title|body|br|hr)\b[^>]*>", "\n")

    def line(part: Column) -> Column:
        text = F.trim(F.regexp_replace(F.regexp_replace(part, "(?s)<[^>]*>", " "), " +", " "))
        for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(mark), F.lit(char))
        return text

    return F.array_join(F.filter(F.transform(F.split(blocks, "\n"), line), lambda x: ~x.isin("", "#")), "\n")


def _trigrams(s: str) -> list[str]:
    return ["".join(x) for x in zip(s, s[1:], s[2:], strict=False)]


def _features(tokens: list[str]) -> pd.DataFrame:
    """token (its number), place and weight of every feature; each distinct feature is hashed once."""
    parts = [(i, t, WORD_WEIGHT) for i, t in enumerate(tokens)]
    parts += [(i, f"~{t[:5]}", STEM_WEIGHT) for i, t in enumerate(tokens) if len(t) > 5]
    parts += [(i, tri, TRIGRAM_WEIGHT) for i, t in enumerate(tokens) if len(t) > 3 for tri in _trigrams(f"#{t}#")]
    found = pd.DataFrame(parts, columns=["token", "feature", "weight"])
    codes, distinct = pd.factorize(found.feature)
    digests = np.array([list(hashlib.blake2b(f.encode(), digest_size=8).digest()) for f in distinct], np.int64).reshape(-1, 8)
    places = digests[:, :4] @ (1 << (8 * np.arange(4))) % DIM
    return pd.DataFrame({"token": found.token, "place": places[codes], "weight": found.weight * np.where(digests[:, 4] & 1, 1.0, -1.0)[codes]})


def hash_vectors(texts: pd.Series) -> np.ndarray:
    """The offline embedding of each text: words, five-letter stems and trigrams, signed and hashed to DIM places, of length 1."""
    said = texts.fillna("").str.lower().str.replace("ё", "е").str.findall("[a-zа-я0-9]+")
    flat = said.reset_index(drop=True).explode().dropna()
    flat = flat[~flat.isin(STOPWORDS)]
    out = np.zeros((len(texts), DIM))
    if len(flat):
        codes, distinct = pd.factorize(flat)
        of = _features(list(distinct)).merge(pd.DataFrame({"token": codes, "row": flat.index}), on="token")
        out = np.bincount(of.row * DIM + of.place, of.weight, out.size).reshape(out.shape)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1.0)


def hash_vector(text: str) -> list[float]:
    return hash_vectors(pd.Series([text])).tolist()[0]


def embed(texts: Column) -> Column:
    """The hash vectors of a text column, in Arrow batches; null texts have the zero vector."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(hash_vectors(batch).astype(np.float32)), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(texts)


def embedding_text(section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws("\n", section, text)).otherwise(text)
