"""CSV read range by range against a plain reader of the whole file."""

import csv
import io
import random

import pytest

from sumbrook.errors import CorruptFileError, NoDataError
from sumbrook.sources import csv_ranges, tables


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    yield lambda n: [spark.conf.set(name, str(v)) for name, v in zip(names, (n, n, 1), strict=True)]
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain(data: str, sep: str):
    rows = [r for r in csv.reader(io.StringIO(data, newline=""), delimiter=sep) if r]
    return rows[0], [tuple((c or None) for c in r) + (None,) * (len(rows[0]) - len(r)) for r in rows[1:] if any(r)]


def written(rng, rows, sep, end):
    fields = ["plain", "", "two words", "a\nb", 'said "x"', f"with{sep}mark", "\r\nends\r\n", "ёж", "x" * 300, '5" pipe', "end\n\n\n"]
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end)
    writer.writerow(["id", "said", "more\nlines"])
    for i in range(rows):
        writer.writerow([i, rng.choice(fields), rng.choice(fields)])
        if rng.random() < 0.05:
            out.write(end)
        if rng.random() < 0.1:
            out.write(f'{i}{sep}5" pipe{end}')  # a quote inside a field that isn't quoted, and a short row
    return out.getvalue()


@pytest.mark.parametrize(("size", "sep", "end"), [(60, ",", "\n"), (251, ";", "\r\n"), (4000, "\t", "\n"), (1 << 20, "|", "\n")])
def test_ranges_of_any_size_give_the_same_rows(spark, tmp_path, small_ranges, size, sep, end):
    data = written(random.Random(size), min(400, size // 2), sep, end)
    path = tmp_path / "t.csv"
    path.write_bytes(data.encode())
    small_ranges(size)
    df = tables.read_csv(spark, str(path), "_row")
    names, rows = plain(data, sep)
    assert df.columns == ["_row", *names] and [tuple(r)[1:] for r in df.orderBy("_row").collect()] == rows
    of = csv_ranges.layout(spark, str(path), sep)
    assert len(of.ranges) >= min(10, len(data) // size // 2) and (size > 300 or len(of.begins) > 0)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    line = '{},"first\nsecond ""x"", third",' + "y" * 500 + "\n"
    with path.open("w") as f:
        f.write("id,said,pad\n" + "".join(line.format(i) for i in range(30_000)))
    small_ranges(1 << 20)
    df = tables.read_csv(spark, str(path))
    assert df.rdd.getNumPartitions() >= 15
    assert df.selectExpr("count(*)", "sum(id)", "count_if(said = 'first\\nsecond \"x\", third')", "min(length(pad))").first() == (30_000, 29_999 * 15_000, 30_000, 500)


def test_a_field_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line with a, comma\n" * 60
    data = f'a,b\n1,"{long}"\n2,"x"\n3,"{long}""{long}"\n'
    path = tmp_path / "t.csv"
    path.write_text(data)
    small_ranges(100)
    assert [tuple(r) for r in tables.read_csv(spark, str(path), "_row").orderBy("_row").select("a", "b").collect()] == [("1", long), ("2", "x"), ("3", f'{long}"{long}')]


def test_an_encoding_is_told_by_the_whole_file(spark, tmp_path, small_ranges):
    rows = [f"{i},plain" for i in range(2000)] + ["2000,Алматы"]
    path = tmp_path / "t.csv"
    path.write_bytes("\n".join(["id,city", *rows]).encode("cp1251"))
    small_ranges(2000)
    assert tables.read_csv(spark, str(path)).where("id = 2000").first().city == "Алматы"
    path.write_bytes("\n".join(["﻿id,city", *rows]).encode())
    assert tables.read_csv(spark, str(path)).where("id = 2000").first().city == "Алматы"


def test_line_ends_of_old_files_and_faulty_ones(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a,b\r1,2\r3,4\r")
    assert [tuple(r) for r in tables.read_csv(spark, str(path)).collect()] == [("1", "2"), ("3", "4")]
    path.write_bytes(b'a,b\n1,"2\n3,4\n')
    with pytest.raises(CorruptFileError):
        tables.read_csv(spark, str(path))
    path.write_bytes(b"\n\n")
    with pytest.raises(NoDataError):
        tables.read_csv(spark, str(path))
    path.write_bytes(b"a" * 9000 + b",b\n1,2")
    assert tables.read_csv(spark, str(path)).columns == ["a" * 9000, "b"]


@pytest.mark.parametrize(
    ("line", "inside", "want"),
    [(b"a,b", False, False), (b"a,b", True, True), (b'"a', False, True), (b'a" b', False, False), (b'x"', True, False), (b'""', True, True), (b'"a""', False, True), (b'","', False, False), (b'","', True, True), (b'",""', True, False), (b"", True, True)],
)
def test_states_of_lines(line, inside, want):
    assert csv_ranges.ends_inside(line, b",", inside) is want
