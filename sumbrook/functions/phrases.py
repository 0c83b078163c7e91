"""Masking of many phrases at once: one automaton over all of them reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases, and characters of all phrases, that one automaton may hold; it is broadcast.
MOST, MOST_CHARS = 1_000_000, 64 << 20
#: Bytes of texts that a batch is cut to.
BATCH_BYTES = 4 << 20
BLANK = " "


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(p, len(p))
    found.make_automaton()
    return found


def spans(text: str, held: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Where phrases stand: the leftmost one and of those that begin there the longest, then on behind it."""
    longest: dict[int, int] = {}
    for last, size in held.iter(text):
        begin = last - size + 1
        longest[begin] = max(size, longest.get(begin, 0))
    out, behind = [], 0
    for begin in sorted(longest):
        if begin >= behind:
            behind = begin + longest[begin]
            out.append((begin, behind))
    return out


def blanked(text: str, found: list[tuple[int, int]]) -> str:
    """The text with a blank for each span."""
    parts, at = [], 0
    for begin, end in found:
        parts += [text[at:begin], BLANK]
        at = end
    return "".join([*parts, text[at:]])


def pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each piece holds about `most` bytes of a text column; a longer text comes alone."""
    begin = held = 0
    sizes = [len(x) if x else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()]
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(begin)


def mask_phrases(texts: DataFrame, phrases: DataFrame, key: str, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """key, masked, found (how many phrases were blanked) of each row: leftmost phrases go first, of those at one place the longest.

    phrases are read once, made distinct and broadcast as one automaton; more than MOST of them, or MOST_CHARS characters in all, are refused. Empty
    and null phrases are none; a null text stays null with found 0. Repeated rows each come back.
    """
    spark = texts.sparkSession
    listed = phrases.where(F.length(phrase) > 0).select(F.col(phrase).alias("p")).distinct()
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    if size.n > MOST or size.chars > MOST_CHARS:
        raise ValueError(f"{size.n} phrases of {size.chars} characters are too many for one automaton.")
    held = spark.sparkContext.broadcast(automaton([r.p for r in listed.collect()])) if size.n else None  # within MOST and MOST_CHARS
    rows = texts.select(F.col(key).alias(key), F.col(text).alias("masked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for b in batches for piece in pieces(b, 1)):
            said = batch.column(1).to_pylist()
            found = [spans(t, held.value) if t else [] for t in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else blanked(t, s) for t, s in zip(said, found, strict=True)], pa.string()), pa.array([len(s) for s in found], pa.int64())], [key, "masked", "found"])

    if held is None:
        return rows.withColumn("found", F.lit(0).cast("long"))
    return rows.mapInArrow(run, rows.withColumn("found", F.lit(0).cast("long")).schema)
