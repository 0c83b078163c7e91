"""Workbooks: the driver reads a zip's directory and a sheet's first row, tasks stream the sheets.

Files are opened through Hadoop's file systems on the driver and by Spark's own reader in tasks, so any path that Spark reads will do. A path may
name many workbooks of the same columns; each is parsed by a task of its own.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import CorruptFileError
from ..kinds import column_name
from .tables import headers

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes that the driver asks for at a time, and rows of a batch.
ASKED, BATCH_ROWS = 1 << 16, 5000


class HadoopFile(io.RawIOBase):
    """A file of any of Hadoop's file systems, read where it is asked for: a zip's directory costs its last bytes alone."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.getFileStatus(place) if files.exists(place) and files.getFileStatus(place).isFile() else files.globStatus(jvm.org.apache.hadoop.fs.Path(place, "*.xlsx"))[0]
        self._bytes, self._stream, self._length, self._at = jvm.org.apache.commons.io.IOUtils, files.open(found.getPath()), found.getLen(), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._length}[whence]
        return self._at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self._length - self._at))
        if n:
            self._stream.seek(self._at)
            buffer[:n] = bytes(self._bytes.toByteArray(self._stream, n))
            self._at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self._stream.close()
        super().close()


def _book(data: bytes | BinaryIO) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data)


def sheets(data: bytes | BinaryIO) -> dict[str, str]:
    """The sheets in order, each with the part that holds it."""
    try:
        with _book(data) as book:
            read = lambda name: ElementTree.fromstring(book.read(name))
            targets = {r.get("Id"): r.get("Target", "") for r in read("xl/_rels/workbook.xml.rels")}
            return {s.get("name", ""): "xl/" + targets[s.get(_REL)].removeprefix("/xl/") for s in read("xl/workbook.xml").iter(f"{_MAIN}sheet")}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise CorruptFileError(f"Not a workbook: {e}.") from e


def _place(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _streamed(part: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one at a time; what was read is let go."""
    above: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            if above:
                above[-1].remove(element)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if value is None or value.text is None:
        return None
    return shared[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}.get(value.text, value.text) if kind == "b" else value.text


def rows(data: bytes | BinaryIO, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet, the first if none is named, as text. Memory holds one row and the workbook's shared texts."""
    found = sheets(data)
    if not found or sheet is not None and sheet not in found:
        raise CorruptFileError(f"There is no sheet {sheet!r}; there are {', '.join(found)}.")
    with _book(data) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in _streamed(part, f"{_MAIN}si")]
        with book.open(found[sheet if sheet is not None else next(iter(found))]) as part:
            for row in _streamed(part, f"{_MAIN}row"):
                out: list[str | None] = []
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _place(cell.get("r")) if cell.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    out[at] = _cell(cell, shared)
                yield out


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    with io.BufferedReader(HadoopFile(spark, path), ASKED) as file:
        return list(sheets(file))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows below a sheet's first one, which names the columns, as text; longer rows are cut, shorter ones filled with nulls."""
    with io.BufferedReader(HadoopFile(spark, path), ASKED) as file:
        names = headers(next(rows(file, sheet), []))
    width = len(names)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(some: list[list[str | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*some, strict=True) if some else [()] * width)], names)

        for content in (c.as_py() for b in batches for c in b.column(0)):
            held: list[list[str | None]] = []
            for i, row in enumerate(rows(content, sheet)):
                if i:
                    held.append((row + [None] * width)[:width])
                if len(held) == BATCH_ROWS:
                    yield batch(held)
                    held = []
            yield batch(held)

    schema = ", ".join(f"{column_name(n)} string" for n in names)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content").mapInArrow(parsed, schema)
