"""Sources, type inference, profiles, personal data, store."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sumbrook.errors import CorruptFileError, DatasetNotFoundError, EmptyFileError, NoDataError, UnsupportedFormatError
from sumbrook.functions import parsing, pii
from sumbrook.functions.descriptions import synonyms
from sumbrook.kinds import Kind, kinds
from sumbrook.operators import profile
from sumbrook.plans import report, steps
from sumbrook.plans.query import calculate_metric
from sumbrook.plans.summary import summarise
from sumbrook.sources import tables
from sumbrook.sources.store import DatasetStore


@pytest.mark.parametrize("code,mark", [("utf-8", b"\xef\xbb\xbf"), ("utf-8", b""), ("cp1251", b""), ("utf-16-le", b"\xff\xfe")])
@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv(spark, tmp_path, code, mark, sep):
    lines = [sep.join(x) for x in (["Месяц ", "Сумма", ""], ["2026-01", "1 001.5", ""], ["", "", ""], ["2026-02", "7", ""])]
    path = tmp_path / "t.csv"
    path.write_bytes(mark + "\n".join(lines).encode(code))
    df = tables.read_csv(spark, str(path))
    assert df.columns == ["Месяц", "Сумма"] and [tuple(r) for r in df.collect()] == [("2026-01", "1 001.5"), ("2026-02", "7")]


def test_csv_refusals(spark, tmp_path):
    for name, data, error in (("a.csv", b"", EmptyFileError), ("a.txt", b"x", UnsupportedFormatError), ("b.csv", b"PK\3\4", CorruptFileError), ("c.csv", b"a\0b", CorruptFileError), ("d.xlsx", b"no", CorruptFileError), ("e.csv", b"a,b\n", NoDataError)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(error):
            tables.read_table(spark, str(tmp_path / name))
    (tmp_path / "f.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed|MALFORMED"):
        tables.read_csv(spark, str(tmp_path / "f.csv")).collect()


def test_workbook(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row><row><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    parts = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>a</t></si></sst>',
        "xl/worksheets/sheet1.xml": sheet,
    }
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "w.xlsx"), "One").collect()] == [("a", "5"), (None, "true")]
    from sumbrook.sources.xlsx import sheets

    assert list(sheets((tmp_path / "w.xlsx").read_bytes())) == ["One"]


def _workbook(path, sheets):
    """A workbook of sheets (name, rows of texts), texts shared."""
    texts = list(dict.fromkeys(c for _, rows in sheets for row in rows for c in row if c is not None))
    cells = lambda r, row: "".join(f'<c r="{chr(65 + i)}{r}" t="s"><v>{texts.index(c)}</v></c>' for i, c in enumerate(row) if c is not None)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in texts) + "</sst>")
        for i, (_, rows) in enumerate(sheets):
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_workbooks_are_streamed_by_tasks(spark, tmp_path, monkeypatch):
    from sumbrook.sources import xlsx

    monkeypatch.setattr(xlsx, "BATCH_ROWS", 100)
    many = [["id", "said"], *([str(i), f"text {i % 7}"] for i in range(1050))]
    _workbook(tmp_path / "a.xlsx", [("One", many), ("Two", [["x"], ["1"], [None], ["3"]])])
    _workbook(tmp_path / "b.xlsx", [("One", many[:1] + many[5:8]), ("Two", [["x"]])])
    path = "file://" + str(tmp_path / "a.xlsx")
    assert xlsx.sheet_names(spark, path) == ["One", "Two"]
    assert [tuple(r) for r in xlsx.read_xlsx(spark, path).collect()] == [tuple(r) for r in many[1:]]
    assert [r.x for r in tables.read_table(spark, path, "Two").collect()] == ["1", "3"]
    both = xlsx.read_xlsx(spark, str(tmp_path), "One")
    assert both.count() == 1053 and "bytes" not in both._jdf.queryExecution().toString()
    with pytest.raises(CorruptFileError):
        xlsx.read_xlsx(spark, path, "Three")


def test_recognised_cells(spark):
    df, warnings = tables.from_cells(spark, ["a", "a", ""], [["1", "2"], ["3", "4", "5", "6"]])
    assert df.columns == ["a", "a_2", "Unnamed: 2"] and [tuple(r) for r in df.collect()] == [("1", "2", None), ("3", "4", "5")] and "2 rows" in warnings[0]


def test_numbers_booleans_dates(spark):
    said = ["1 001,5", "1,000.25", "$ 12%", "1,234,567", "abc", "n/a", "1d", "NaN", "-.5", " 7 ", "1.234.567"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in said], "s string").select(parsing.parse_numeric(F.col("s")).alias("v")).collect()]
    assert got == [1001.5, 1000.25, 12.0, None, None, None, None, None, -0.5, 7.0, None]
    said = ["Да", "нет", "1.0", "0", "maybe", "-"]
    assert [r.v for r in spark.createDataFrame([(x,) for x in said], "s string").select(parsing.parse_boolean(F.col("s")).alias("v")).collect()] == [True, False, True, False, None, None]
    said = ["2026-3-1", "31.02.2026", "x"]
    got = [r.v for r in spark.createDataFrame([(x,) for x in said], "s string").select(parsing.parse_mixed_datetime(F.col("s")).alias("v")).collect()]
    assert str(got[0]) == "2026-03-01 00:00:00" and got[1:] == [None, None]


def test_detection_and_typing(spark):
    rows = [(i, f"1 00{i % 10},5", f"{i % 28 + 1:02d}.03.2026", f"2026-{i % 12 + 1:02d}", "AB"[i % 2], f"text {i}", ["да", "нет"][i % 2], str(i), None, f"2026-03-{i % 28 + 1:02d} 10:00:00") for i in range(20)]
    rows[3] = (3, "abc", *rows[3][2:])
    df = spark.createDataFrame(rows, "_row long, amount string, dmy string, ym string, cat string, free string, flag string, count string, empty string, stamp string")
    found = parsing.detect(df)
    assert {c: k for c, (k, _) in found.items()} == {"amount": "numeric", "dmy": "datetime", "ym": "datetime", "cat": "categorical", "free": "text", "flag": "boolean", "count": "numeric", "empty": "text", "stamp": "datetime"}
    assert found["ym"][1] == "yyyy-M" and found["stamp"][1] == "yyyy-M-d H:m:s"
    typed = parsing.typed(df, found)
    assert dict(typed.dtypes)["count"] == "bigint" and dict(typed.dtypes)["amount"] == "double" and kinds(typed)["free"] is Kind.TEXT
    stats = {r["column"]: r for r in profile.column_stats(typed.drop("_row")).collect()}
    assert stats["amount"].missing == 0 and stats["empty"].missing == 20 and stats["count"].median == 9.5
    assert typed.where("amount__invalid").count() == 1


def test_profile_and_quality(spark):
    df = spark.createDataFrame([("a", 1, "k"), ("a", 1, "k"), ("b", None, "k"), (None, None, "k"), (None, None, "k")], "x string, n long, fixed string")
    assert profile.duplicate_rows(df).first().duplicates == 2
    issues = {(r.issue, r.column): r.severity for r in profile.quality_issues(profile.column_stats(df), profile.duplicate_rows(df)).collect()}
    assert issues == {("missing_values", "x"): "warning", ("missing_values", "n"): "error", ("constant_column", "n"): "info", ("constant_column", "fixed"): "info", ("duplicate_rows", None): "warning"}
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    assert [(r.value, r["count"]) for r in profile.top_values(numbered, ["x"], "_row").orderBy("rank").collect()] == [("a", 2), ("b", 1)]
    assert profile.column_stats(df.limit(1)).where("column = 'n'").first()["std"] is None


def test_personal_data(spark):
    said = {"a.b@mail.org": True, "+7 (701) 555-12-34": True, "87015551234": True, "4111 1111 1111 1111": True, "4111 1111 1111 1112": False, "2026-01-01": False, "1234567890": False, "12345": False}
    got = {r.s: r.p for r in spark.createDataFrame([(x,) for x in said], "s string").select("s", pii.is_personal(F.col("s")).alias("p")).collect()}
    assert got == said
    df = spark.createDataFrame([(0, "a@b.org", "x", "1"), (1, "c@d.org", "y", "2")], "_row long, contact string, note string, full_name string")
    assert pii.sensitive_columns(df, "_row") == {"full_name": "name", "contact": "values"}


def test_summary_plan_and_report(spark):
    rows = [(f"2026-0{m}-01", r, 10 * m + i, 1) for m in range(1, 5) for i, r in enumerate(["North", "South"])]
    df = spark.createDataFrame(rows, "Month string, Region string, Revenue_KZT long, Orders long").withColumn("Month", F.col("Month").cast("timestamp_ntz"))
    summary = summarise(df)
    assert summary.measures == ["Revenue_KZT", "Orders"] and summary.dimensions == ["Month", "Region"] and summary.duplicates == 0
    plan, open_ = steps.rules_plan(steps.candidates(summary))
    assert [(s.metric, s.group_by, s.chart) for s in plan] == [("sum:Revenue_KZT", ("Month",), "line"), ("sum:Revenue_KZT", ("Region",), "bar")] and not open_
    done = steps.run_plan(df, [*plan, steps.Step("sum:nope")], summary)
    assert len(done.results) == 2 and "nope" in done.warnings[0]
    facts = {r.fact: (r.value, r.of) for r in steps.step_facts(df, plan[0], summary).collect()}
    assert facts["change"][0] == 60 and facts["periods"] == (4.0, None)
    text = report.markdown("Sales", summary, [r for _, r in done.results], report.narrative(facts, "Revenue", "KZT"))
    assert "| 2026-01 | 21 KZT | 2 |" in text and "Revenue rose by 60 KZT" in text
    assert report.basic_kpis(summary)[0] == ("Rows", "8") and report.number_text(1234567.0, "KZT") == "1,23 m KZT"
    assert "количество транзакций" in synonyms("TransactionCount") and "успешные транзакции" in synonyms("success_cnt")


def test_store(spark, tmp_path):
    store = DatasetStore(spark, f"file://{tmp_path}/store")
    assert store.list().count() == 0
    df = spark.createDataFrame([(1, "a")], "n long, x string").select(F.col("n").alias("n", metadata={"kind": "categorical"}), "x")
    one = store.save(df, "one.csv", {"rows": 1})
    assert store.get(one)["profile"] == {"rows": 1} and [r.n for r in store.load(one).collect()] == [1] and kinds(store.load(one))["n"] is Kind.CATEGORICAL
    assert [r.dataset_id for r in store.list().collect()] == [one]
    store.delete(one)
    for bad in (one, "nope", "../../etc"):
        with pytest.raises(DatasetNotFoundError):
            store.get(bad)


def test_calculates_on_typed_text(spark):
    df = spark.createDataFrame([(0, "1,5", "A"), (1, "2,5", "B"), (2, "x", "B"), (3, "4", "A"), (4, "1", "A")], "_row long, v string, g string")
    typed = parsing.typed(df, parsing.detect(df))
    assert [g.value for g in calculate_metric(typed.drop("_row"), "sum:v", ["g"]).rows] == [6.5, 2.5]


def test_result_files(spark, tmp_path):
    import hashlib

    from sumbrook.sources.results import file_digests, write_json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    assert [(r.length, r.sha256) for r in file_digests(spark, str(tmp_path / "in")).collect()] == [(3, hashlib.sha256(b"abc").hexdigest())]
    write_json(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "out"), "d")
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("a", "b", "input_sha256").collect()] == [(1, None, "d")]
