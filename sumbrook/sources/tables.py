"""Tables from files: sniffing by a file's head, text columns only, cleaned headers and rows."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CorruptFileError, EmptyFileError, NoDataError, UnsupportedFormatError
from ..kinds import column_name
from .csv_ranges import header, layout, read_ranges

HEAD = 4096
DELIMITERS = (",", ";", "\t", "|")
TABLES, IMAGES, PDFS = (".csv", ".xlsx"), (".png", ".jpg", ".jpeg", ".webp"), (".pdf",)
MAX_ROWS, MAX_COLUMNS = 500, 40
CYRILLIC = "cp1251"


def file_kind(name: str) -> str:
    ending = os.path.splitext(name.lower())[1]
    return next((kind for kind, endings in (("table", TABLES), ("image", IMAGES), ("pdf", PDFS)) if ending in endings), "unknown")


def head(spark: SparkSession, path: str, most: int = HEAD) -> tuple[int, bytes]:
    """Length and first bytes of a file, of any size, through Hadoop's file systems."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    length = files.getFileStatus(place).getLen()
    stream = files.open(place)
    try:
        return length, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(most, length)))
    finally:
        stream.close()


def detect_format(name: str, length: int, first: bytes) -> str:
    if file_kind(name) != "table":
        raise UnsupportedFormatError(f"{name}: only {', '.join(TABLES)} are read as tables.")
    if not length:
        raise EmptyFileError(f"{name} is empty.")
    if name.lower().endswith(".xlsx"):
        if not first.startswith(b"PK"):
            raise CorruptFileError(f"{name} is not a workbook.")
        return "xlsx"
    if first.startswith(b"PK") or b"\0" in first and not first.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise CorruptFileError(f"{name} is not text.")
    return "csv"


def encoding(first: bytes) -> str:
    """UTF-16 by its mark; else UTF-8, which all of the file must bear out, or Windows-1251."""
    return "UTF-16" if first.startswith((b"\xff\xfe", b"\xfe\xff")) else "UTF-8"


def delimiter(text: str) -> str:
    line = next((x for x in text.splitlines() if x.strip()), "")
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d))) if any(d in line for d in DELIMITERS) else ","


def headers(names: list[str | None]) -> list[str]:
    """Trimmed names; blanks become Unnamed: i, repeats get _2, _3 and on."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = (name or "").strip() or f"Unnamed: {i}"
        found, n = base, 1
        while found in out:
            n += 1
            found = f"{base}_{n}"
        out.append(found)
    return out


def clean_frame(df: DataFrame, row: str | None = None) -> DataFrame:
    """Trimmed headers, no rows or unnamed columns that are empty; a table without rows or columns is an error. row: a column that doesn't count."""
    named = df.toDF(*headers(df.columns))
    blank = [c for c in named.columns if re.fullmatch(r"Unnamed: \d+", c)]
    if blank:
        filled = named.agg(*(F.count(F.nullif(F.trim(F.col(column_name(c)).cast("string")), F.lit(""))).alias(str(i)) for i, c in enumerate(blank))).first()
        named = named.drop(*(c for i, c in enumerate(blank) if not filled[i]))
    data = [c for c in named.columns if c != row]
    kept = named.na.drop(how="all", subset=data) if data else named
    if not data or kept.isEmpty():
        raise NoDataError("The table has no data.")
    return kept


def read_csv(spark: SparkSession, path: str, row: str | None = None) -> DataFrame:
    """All columns as text, by as many tasks as the file has splits. A row longer than the header is an error, a shorter one is filled with nulls.

    Quoted fields may hold line ends. UTF-8 or, if any line of the file isn't that, Windows-1251; a file in UTF-16 is read by one
    task. row: the name of a column that numbers the rows in the file's order; not for UTF-16.
    """
    length, first = head(spark, path)
    detect_format(path, length, first)
    if encoding(first) == "UTF-16":
        sep = delimiter(first.decode("UTF-16", "ignore"))
        df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", "UTF-16").option("mode", "FAILFAST").option("multiLine", True).csv(path)
        return clean_frame(df.toDF(*("" if c == f"_c{i}" else c for i, c in enumerate(df.columns))))  # Spark's name of a blank header
    sep = delimiter(first.decode("latin-1").removeprefix("ï»¿"))  # delimiters are the same in both encodings
    of = layout(spark, path, sep, "\r" if b"\r" in first and b"\n" not in first else "\n", CYRILLIC)
    names = None
    while (names := header(first if len(first) < length else first + of.end.encode(), of)) is None and len(first) < length:
        first = head(spark, path, 16 * len(first))[1]  # a header of many columns
    if names is None:
        raise NoDataError("The table has no data.")
    found = headers(names)
    rows = read_ranges(spark, of, found)
    return clean_frame(rows.select(*([F.col("row").alias(row)] if row else []), *(F.col(f"c{i}").alias(n) for i, n in enumerate(found))), row)


def read_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    length, first = head(spark, path)
    if detect_format(path, length, first) == "csv":
        return read_csv(spark, path)
    from .xlsx import read_xlsx

    return clean_frame(read_xlsx(spark, path, sheet))


def from_cells(spark: SparkSession, names: list[str], rows: list[list[str | None]]) -> tuple[DataFrame, list[str]]:
    """A recognised table of cells (500 x 40 at most): ragged rows are padded or cut with a warning, blanks are null."""
    if len(rows) > MAX_ROWS or len(names) > MAX_COLUMNS:
        raise UnsupportedFormatError(f"At most {MAX_ROWS} rows and {MAX_COLUMNS} columns.")
    width, warnings = len(names), []
    ragged = sum(len(r) != width for r in rows)
    if ragged:
        warnings.append(f"{ragged} rows did not have {width} cells; they were padded or cut.")
    schema = ", ".join(f"{column_name(n)} string" for n in headers(list(names)))
    cells = [[(c.strip() or None) if c is not None else None for c in (list(r) + [None] * width)[:width]] for r in rows]
    return clean_frame(spark.createDataFrame(cells, schema)), warnings
