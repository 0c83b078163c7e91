"""CSV files read by many tasks, with line ends inside quoted fields.

Whether a line begins a record depends on all quotes before it. So each byte range of the file is first judged under both states that it
may begin in, outside and inside a quoted field, and says in which it ends; going over the ranges once then fixes every range's state. After
that each range is parsed alone. A record that crosses ranges is cut in pieces, which meet by the range where it begins.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptFileError

QUOTE = b'"'
#: Bits of a row's number that count within its range.
ROW_BITS = 36


def ends_inside(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, if it begins so or not. A quote opens a field only as its first character; doubled ones stand for one."""
    at = 0
    while True:
        if not inside:
            while line[at : at + 1] != QUOTE:
                at = line.find(sep, at) + 1
                if not at:
                    return False
            at += 1
        while (close := line.find(QUOTE, at)) >= 0 and line[close + 1 : close + 2] == QUOTE:
            at = close + 2
        if close < 0:
            return True
        at = line.find(sep, close + 1) + 1
        if not at:
            return False
        inside = False


def _lines(spark: SparkSession, path: str, end: str) -> DataFrame:
    """begin (of the byte range) and the lines as they stand, each in the range where it begins."""
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"))


def _by_range(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.Array]]]:
    """The ranges of one task in turn, each with its lines in batches."""

    def parts() -> Iterator[tuple[int, pa.Array]]:
        for batch in batches:
            begins, lines = batch.column(0), batch.column(1)
            at = 0
            for begin, same in groupby(begins.to_pylist()):
                n = sum(1 for _ in same)
                yield begin, lines.slice(at, n)
                at += n

    for begin, group in groupby(parts(), key=lambda p: p[0]):
        yield begin, (lines for _, lines in group)


def _judged(sep: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, parts in _by_range(batches):
            outside, inside, closed, utf8 = False, True, False, True
            for lines in parts:
                for line in lines.filter(pc.match_substring(lines, QUOTE)).to_pylist():
                    outside, inside = ends_inside(line, sep, outside), ends_inside(line, sep, inside)
                    closed = closed or not inside
                try:
                    lines.cast(pa.string())
                except pa.ArrowInvalid:
                    utf8 = False
            yield pa.RecordBatch.from_pylist([{"begin": begin, "outside": outside, "inside": inside, "closed": closed, "utf8": utf8}])

    return run


@dataclass(frozen=True)
class Layout:
    """What the first pass tells of a file. begins: the ranges that begin inside a quoted field, each with the range where that record begins."""

    path: str
    end: str
    sep: str
    encoding: str
    ranges: dict[int, int]
    begins: dict[int, int]


def layout(spark: SparkSession, path: str, sep: str, end: str = "\n", otherwise: str = "cp1251") -> Layout:
    """Fixes the ranges' states and lets all of them vote on the encoding: UTF-8 if every line is, else `otherwise`.

    The driver holds a row for each range, of which a file has its size over spark.sql.files.maxPartitionBytes.
    """
    schema = "begin long, outside boolean, inside boolean, closed boolean, utf8 boolean"
    told = _lines(spark, path, end).mapInArrow(_judged(sep.encode()), schema).orderBy("begin").collect()
    inside, owner, begins = False, 0, {}
    for r in told:
        if inside:
            begins[r.begin] = owner
        if not inside or r.closed:
            owner = r.begin  # an open record at this range's end began in it
        inside = r.inside if inside else r.outside
    if inside:
        raise CorruptFileError(f"{path}: a quoted field is never closed.")
    return Layout(path, end, sep, "utf-8" if all(r.utf8 for r in told) else otherwise, {r.begin: i for i, r in enumerate(told)}, begins)


def _records(lines: Iterable[bytes], of: Layout, inside: bool) -> Iterator[tuple[list[bytes], bool]]:
    """The lines of each record and whether it is closed. If the lines begin inside a field, the first record's beginning is not there."""
    sep, end = of.sep.encode(), of.end.encode()
    held: list[bytes] = []
    for line in lines:
        held.append(line + end)
        if QUOTE in line:
            inside = ends_inside(line, sep, inside)
        if not inside:
            yield held, True
            held = []
    if held:
        yield held, False


def _cells(records: Iterable[list[bytes]], of: Layout) -> Iterator[list[str]]:
    """The fields of whole records; blank lines are none."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader((line.decode(of.encoding) for lines in records for line in lines), delimiter=of.sep)


def _row(cells: list[str], width: int) -> list[str | None]:
    if len(cells) > width:
        raise ValueError(f"Malformed row: {len(cells)} fields where the header has {width}: {cells[:8]}")
    return [c or None for c in cells] + [None] * (width - len(cells))


def _table(rows: list[list], numbers: list[int], width: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * width
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(pa.array(c, pa.string()) for c in columns)], ["row", *(f"c{i}" for i in range(width))])


def _parsed(of: Layout, width: int, batch_rows: int = 10_000):
    """Each range's whole records; of the file's first range all but the header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, parts in _by_range(batches):
            records = _records((line for lines in parts for line in lines.to_pylist()), of, begin in of.begins)
            if begin in of.begins:
                next(records, None)  # the rest of a record that began before
            rows, numbers, base = [], [], of.ranges[begin] << ROW_BITS
            header = of.ranges[begin] == 0
            for n, cells in enumerate(filter(None, _cells((lines for lines, closed in records if closed), of))):
                if header:
                    header = False
                    continue
                rows.append(_row(cells, width))
                numbers.append(base + n)
                if len(rows) == batch_rows:
                    yield _table(rows, numbers, width)
                    rows, numbers = [], []
            yield _table(rows, numbers, width)

    return run


def _pieces(of: Layout):
    """owner (the range in which the record begins), begin and text of the pieces of records that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, parts in _by_range(batches):
            inside, out = begin in of.begins, []
            for i, (lines, closed) in enumerate(_records((line for part in parts for line in part.to_pylist()), of, inside)):
                rest = inside and i == 0
                if rest or not closed:
                    out.append({"owner": of.begins[begin] if rest else begin, "begin": begin, "text": b"".join(lines)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("owner", pa.int64()), ("begin", pa.int64()), ("text", pa.binary())]))

    return run


def _joined(of: Layout, width: int):
    """The record that the pieces of one owner make."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("begin")
        (cells,) = _cells([b"".join(table.column("text").to_pylist()).splitlines(keepends=True)], of)
        last = (of.ranges[table.column("owner")[0].as_py()] + 1 << ROW_BITS) - 1  # behind the other rows of its range
        return pa.Table.from_batches([_table([_row(cells, width)], [last], width)])

    return run


def header(first: bytes, of: Layout) -> list[str] | None:
    """The fields of the first record that isn't blank, if the file's first bytes hold it whole."""
    text = first.removeprefix(b"\xef\xbb\xbf") if of.encoding == "utf-8" else first
    lines = text.split(of.end.encode())
    whole = [lines for lines, closed in _records(lines[:-1], of, False) if closed]
    return next(filter(None, _cells(whole, of)), None)


def read_ranges(spark: SparkSession, of: Layout, names: list[str]) -> DataFrame:
    """row and the columns c0, c1 and on as text: null where a field is empty or a row is short; a longer row fails the read.

    row numbers the rows in the file's order, with gaps.
    """
    schema = ", ".join(["row long", *(f"c{i} string" for i in range(len(names)))])
    rows = _lines(spark, of.path, of.end).mapInArrow(_parsed(of, len(names)), schema)
    if of.begins:
        pieces = _lines(spark, of.path, of.end).mapInArrow(_pieces(of), "owner long, begin long, text binary")
        rows = rows.unionByName(pieces.groupBy("owner").applyInArrow(_joined(of, len(names)), schema))
    return rows
