"""What may be written, how packages are made, typed cells, bounds, cultures, findings and their reasons, progress."""

import gzip
import io
import tarfile
import time
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsieve.api import export, open_workbook
from tabsieve.errors import EngineError, LimitError, WriteError
from tabsieve.functions import readings as R
from tabsieve.functions.cultures import culture, known
from tabsieve.operators.extract import compile_plan
from tabsieve.operators.profile import AnalysisOptions, analyze
from tabsieve.plans import schema as S
from tabsieve.plans.mapping import Binding, Plan, by_header
from tabsieve.plans.precheck import ARGUMENTS, REASONS, precheck
from tabsieve.progress import Cancelled, Run, watched
from tabsieve.sinks.csv import CsvOptions, refusals
from tabsieve.sinks.package import Package, crc32_combined, piece
from tabsieve.sinks.workbooks import SheetOut, Style, sheet_of, write_ods, write_xlsx
from tabsieve.sources.dialect import detect_delimiter
from tabsieve.sources.files import open_file
from tests.test_files import _package

DATE_STYLE = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'


def typed(spark, tmp_path, rows):
    """Cells as a workbook types them, imported under a culture whose separators are the other way round."""
    names = ("count", "amount", "signed", "active", "note")
    head = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCDE", names, strict=True)) + "</row>"
    (tmp_path / "t.xlsx").write_bytes(_package(head + rows, styles=DATE_STYLE, strings="<si><t>shared</t></si>"))
    schema = S.Schema(tuple(S.Field(n, t) for n, t in zip(names, ("Integer", "Decimal", "Date", "Boolean", "Text"), strict=True)))
    f = open_workbook(spark, str(tmp_path / "t.xlsx"))
    return f, f.extract(f.plan(schema, "de-DE"), schema)


def test_typed_cells_are_not_read_through_the_culture(spark, tmp_path):
    f, x = typed(spark, tmp_path, '<row r="2"><c r="A2"><v>42</v></c><c r="B2"><v>1234.567</v></c><c r="C2" s="1"><v>45000</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><v>7.25</v></c></row><row r="3"><c r="C3" t="d"><v>2026-09-25T14:30:00</v></c><c r="D3" t="b"><v>0</v></c><c r="E3" t="s"><v>0</v></c></row>')
    a, b = x.accepted().orderBy("row_number").collect()
    assert (a["count"], float(a["amount"]), str(a["signed"]), a["active"], a["note"]) == (42, 1234.567, "2023-03-15 00:00:00", True, "7.25")
    assert (b["count"], b["amount"], str(b["signed"]), b["active"], b["note"]) == (None, None, "2026-09-25 14:30:00", False, "shared")
    p = f.profile()
    assert p["amount"].kinds == {"Number": 1} and p["signed"].kinds == {"Date": 2} and p["note"].kinds == {"Number": 1, "Text": 1}
    assert p["amount"].hypotheses[0].type == "Decimal" and p["count"].hypotheses[0].type == "Integer" and p.name == "S"


@pytest.mark.parametrize("value", ["42.5", "1E+30", "9223372036854775808"])
def test_numbers_that_are_no_integers(spark, tmp_path, value):
    _, x = typed(spark, tmp_path, f'<row r="2"><c r="A2"><v>{value}</v></c><c r="B2"><v>1</v></c></row>')
    assert [(e["field_name"], e["code"]) for e in x.rejected().collect()] == [("count", "value.type-mismatch")]


def test_typed_columns_are_native_too(spark):
    df = spark.createDataFrame([(1, 1234.567, 5)], "row_number long, price double, n int")
    schema = S.Schema((S.Field("price", "Decimal"), S.Field("n", "Decimal")))
    r = compile_plan(df, by_header(["price", "n"], schema, "de-DE"), schema).accepted().first()
    assert (float(r["price"]), int(r["n"])) == (1234.567, 5)


@pytest.mark.parametrize("names", [[" a"], ["a "], [""], ["a", "A"], ["a\x07"], []])
def test_headers_that_would_not_read_back(spark, tmp_path, names):
    df = spark.range(1).select(F.col("id").alias("row"), *[F.lit(1).alias(n) for n in names]) if len(set(map(str.lower, names))) == len(names) else spark.createDataFrame([(0, 1, 1)], ["row", *names])
    for name in ("x.xlsx", "x.ods", "x.zip"):
        with pytest.raises(WriteError):
            export(str(tmp_path / name), [SheetOut("S", df, "row")])
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("name", ["History", "hISTORY", "a\tb", "a\x01", "x" * 32, "a:b"])
def test_sheet_names(spark, tmp_path, name):
    with pytest.raises(WriteError):
        write_xlsx(str(tmp_path / "x.xlsx"), [SheetOut(name, spark.range(1).select("id", F.lit(1).alias("a")), "id")])


@pytest.mark.parametrize(("value", "code"), [("double('nan')", "write.not-finite"), ("double('infinity')", "write.not-finite"), ("0.1D + 0.2D", "write.precision-loss"), ("1e29D", "write.precision-loss"), ("1e-40D", "write.precision-loss"), ("9007199254740993L", "write.precision-loss"), ("'a\\u0001'", "write.invalid-character"), ("'\\uFFFE'", "write.invalid-character"), ("repeat('x', 32768)", "write.text-too-long"), ("timestamp_ntz'1899-12-31'", "write.date-out-of-range")])
def test_values_that_would_not_read_back(spark, tmp_path, value, code):
    df = spark.sql(f"select 1L as n, 1.5D as ok, {value} as v")
    for write in (write_xlsx, write_ods):
        if code == "write.date-out-of-range" and write is write_ods:
            continue
        with pytest.raises(WriteError) as e:
            write(str(tmp_path / "x"), [SheetOut("S", df, "n")])
        assert (e.value.code, e.value.arguments["column"]) == (code, "v")
    if code in ("write.not-finite", "write.invalid-character"):
        assert [r["code"] for r in refusals(df, "n").collect()] == [code]


def test_numbers_and_times_survive(spark, tmp_path):
    df = spark.sql("select 1L as n, 123456789012345D as a, 1.0E-7D as b, cast(12345.678 as decimal(20,5)) as c, timestamp_ntz'2038-01-19 23:59:59.999999' as d, date'1900-01-01' as e")
    for name in ("x.xlsx", "x.ods"):
        assert export(str(tmp_path / name), [SheetOut("S", df, "n")]) == {"S": 1}
        c = open_workbook(spark, str(tmp_path / name)).rows().where("row_number = 2").first()["cells"]
        assert [x["num"] for x in c[:3]] == [123456789012345.0, 1e-7, 12345.678]
        assert str(c[3]["date"]) == "2038-01-19 23:59:59.999000" and str(c[4]["date"]) == "1900-01-01 00:00:00"  # cut, never rounded


def test_ods_styles_layout_and_merges(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, 7, "hot", "a"), (2, 0.5, 8, None, "b  c"), (3, 1.0, 9, "x", None)], "n long, share double, v long, how string, t string")
    sheet = SheetOut("S'1", df, "n", freeze_rows=1, freeze_columns=2, auto_filter=True, header_style=Style(bold=True, align="center"), styles={"share": Style(number_format='#,##0.0#%" net"', border=True)}, rules={"v": "how"}, named={"hot": Style(fill="#f00", wrap=True, color="#00f", italic=True)}, widths={"v": 30}, merges=[(2, 1, 2, 2), (1, 0, 1, 2)])
    write_ods(str(tmp_path / "x.ods"), [sheet])
    with zipfile.ZipFile(tmp_path / "x.ods") as z:
        assert z.testzip() is None and z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        content, styles, settings = (z.read(f"{x}.xml").decode() for x in ("content", "styles", "settings"))
    assert 'office:value-type="percentage" office:value="0.25"' in content and content.count("<table:covered-table-cell/>") == 4
    assert 'table:number-columns-spanned="2" table:number-rows-spanned="2"' in content and "table:display-filter-buttons" in content and "$'S''1'.A1:" in content
    for part in ('number:decimal-places="2" number:min-decimal-places="1" number:min-integer-digits="1" number:grouping="true"', "<number:text>%</number:text><number:text> net</number:text>", 'fo:background-color="#FF0000"', 'fo:wrap-option="wrap"', 'fo:font-style="italic"', 'fo:color="#0000FF"', 'fo:text-align="center"', "fo:border="):
        assert part in styles, part
    assert ">HorizontalSplitMode" not in settings and 'config:name="HorizontalSplitPosition" config:type="int">2<' in settings and 'config:name="VerticalSplitPosition" config:type="int">1<' in settings
    rows = open_workbook(spark, str(tmp_path / "x.ods")).rows().orderBy("row_number").collect()
    assert [[c and c["text"] for c in r["cells"]] for r in rows] == [["share", None, "t"], ["0.25", "7"], ["0.5"], ["1", "9"]]


def test_packages_are_sound_and_reproducible(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit("text <&> "), "id").alias("t"))
    for name in ("a.xlsx", "b.xlsx"):
        write_xlsx(str(tmp_path / name), [SheetOut("S", df, "n")])
    assert (tmp_path / "a.xlsx").read_bytes() == (tmp_path / "b.xlsx").read_bytes()
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.testzip() is None and all(i.date_time == (1980, 1, 1, 0, 0, 0) for i in z.infolist())
    write_xlsx("file://" + str(tmp_path / "sub" / "c.xlsx"), [SheetOut("S", df, "n")])  # through Spark's file systems
    assert (tmp_path / "sub" / "c.xlsx").read_bytes() == (tmp_path / "a.xlsx").read_bytes()


def test_pieces_make_one_stream():
    parts = [b"", b"a" * 1000, bytes(range(256)) * 9, b"z"]
    crc, n = 0, 0
    out = io.BytesIO()
    p = Package(out, 6)
    p.stream("x", [piece(b, 1) if i % 2 else b for i, b in enumerate(parts)])
    p.add("y", "stored", stored=True)
    p.finish()
    for b in parts:
        crc, n = crc32_combined(crc, zlib.crc32(b), len(b)), n + len(b)
    assert crc == zlib.crc32(b"".join(parts))
    with zipfile.ZipFile(out) as z:
        assert z.read("x") == b"".join(parts) and z.read("y") == b"stored" and z.testzip() is None


def test_rows_and_batches_from_the_driver(spark, tmp_path):
    sheets = [sheet_of(spark, "tuples", [(1, "x"), (2, None)], ["a", "b"]), sheet_of(spark, "dicts", [{"a": 1.5}]), sheet_of(spark, "batches", [pa.table({"a": [1, 2], "b": ["p", "q"]}), pa.table({"a": [3], "b": ["r"]})])]
    assert export(str(tmp_path / "x.xlsx"), sheets) == {"tuples": 2, "dicts": 1, "batches": 3}
    rows = open_workbook(spark, str(tmp_path / "x.xlsx")).rows(2).orderBy("row_number").collect()
    assert [[c["text"] for c in r["cells"]] for r in rows] == [["a", "b"], ["1", "p"], ["2", "q"], ["3", "r"]]


def test_unusual_sheets_go_through_a_parser(spark):
    rows = '<row r="1"><c r="A1"><v>1</v></c><!-- note --><c r="B1" t="str"><f>x</f><v>a&amp;b</v></c></row><row><c><v>2</v></c></row>'
    plain = '<row r="1" spans="1:2"><c r="A1" s="0"><v>1</v></c><c r="B1" t="str"><f>x</f><v>a&amp;b</v></c></row><row r="9"/><row r="10"><c r="B10" t="inlineStr"><is><t xml:space="preserve"> &#228;&lt; </t></is></c><c r="C10" t="e"><v>#N/A</v></c><c r="D10"><v>NaN</v></c></row>'
    assert [[c.text for c in r] for _, r in open_file(_package(rows)).rows()] == [["1", "a&b"], ["2"]]
    got = list(open_file(_package(plain)).rows())
    assert [n for n, _ in got] == [1, 9, 10] and [[(c.kind, c.text) for c in r] for _, r in got] == [[("Number", "1"), ("Text", "a&b")], [], [("Empty", None), ("Text", "ä<"), ("Error", "#N/A"), ("Text", "NaN")]]


def test_delimiters_with_an_odd_number_of_quotes():
    cut = 'id;note\n1;"a, b\n2, c, d"\n2;"cut, off, he'
    assert detect_delimiter(cut) == (";", "Detected")  # whole records decide
    stray = 'id;size\n1;5"\n2;6\n3;7\n'
    assert detect_delimiter(stray) == (";", "Detected")
    assert detect_delimiter('a,b\n\n\n\n1,2\n') == (",", "Detected") and detect_delimiter("title\na;b,c\nd;e\nf;g,h,i\n") == (";", "Detected")


def test_bounds(spark):
    bomb = gzip.compress(b"a" * 3_000_000)
    with pytest.raises(LimitError):
        open_file(bomb, max_unpacked_bytes=1_000_000)
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        for i in range(3):
            info = tarfile.TarInfo(f"{i}.csv")
            info.size = 400_000
            f.addfile(info, io.BytesIO(b"a;b\n" * 100_000))
    assert [s.source for s in open_file(t.getvalue()).sheets] == ["0.csv", "1.csv", "2.csv"] and sum(1 for _ in open_file(t.getvalue()).rows(2)) == 100_000
    for bound in ({"max_archive_bytes": 500_000}, {"max_entries": 2}, {"max_unpacked_bytes": 300_000}):
        with pytest.raises(LimitError):
            open_file(t.getvalue(), **bound)
    for bound in ({"max_columns": 2}, {"max_field_chars": 3}):
        with pytest.raises(LimitError):
            list(open_file(b"a,b,c\nlong,b,c\n", **bound).rows())
    with pytest.raises(ValueError):
        open_file(b"a", max_rows=1)
    assert [len(r) for _, r in open_file(b'a,"b\nc\nd",e\n', max_quoted_lines=1).rows()] == [2, 1, 2]
    # two members, and zeros after them
    assert [r[0].text for _, r in open_file(gzip.compress(b"a\n") + gzip.compress(b"b\n") + b"\0" * 100).rows()] == ["a", "b"]


def test_ods_errors(spark):
    def ods(cells):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
            z.writestr("content.xml", f'<o:d xmlns:o="office" xmlns:t="table" xmlns:x="text" xmlns:c="urn:org:extension"><t:table t:name="S"><t:table-row>{cells}</t:table-row></t:table></o:d>')
        return open_file(out.getvalue())

    got = next(ods('<t:table-cell o:value-type="string" o:string-value="" c:value-type="error"><x:p>#DIV/0!</x:p></t:table-cell><t:table-cell o:value-type="float" o:value="2"/>').rows())[1]
    assert [(c.kind, c.text) for c in got] == [("Error", "#DIV/0!"), ("Number", "2")]


def test_cultures_of_the_platform(spark):
    one = lambda name, text, read: spark.createDataFrame([(text,)], "t string").select(read(F.col("t"), culture(name)).cast("string")).first()[0]
    for name, text, value in (("de-AT", "1 234,5", "1234.5"), ("fr-CH", "1 234,5", "1234.5"), ("pt-BR", "1.234,5", "1234.5"), ("sv-SE", "1 234,5", "1234.5"), ("ja-JP", "1,234.5", "1234.5"), ("en-IN", "12,345.5", "12345.5")):
        assert float(one(name, text, R.decimal)) == float(value), name
    for name, text in (("pl-PL", "17 września 1992"), ("hu-HU", "1992. 09. 17."), ("tr-TR", "17 Eylül 1992"), ("sv-SE", "17 september 1992"), ("cs-CZ", "17. září 1992"), ("fr-FR", "17 septembre 1992"), ("pt-BR", "17/09/1992")):
        assert one(name, text, R.date) == "1992-09-17 00:00:00", name
    assert known("xx-XX") is None and known("de") is None and known("") is not None and culture("DE-at").name == "de-AT"


def test_patterns_end_in_linear_time(spark):
    slow = S.pattern("(a+)+b?")
    df = spark.createDataFrame([(1, "a" * 40 + "!"), (2, "a" * 40)], "n long, t string")
    began = time.time()
    assert {r["n"]: r["ok"] for r in df.select("n", slow.check(F.col("t"), F.col("t")).alias("ok")).collect()} == {1: False, 2: True}
    assert time.time() - began < 20
    assert not S._may_explode("Customer#[0-9]{9}") and not S._may_explode("(ab|cd)[0-9]+") and S._may_explode("(a|aa)+") and S._may_explode("([a-z]+ ?)*")
    with pytest.raises(ValueError):
        S.pattern("(a+")


def test_findings_name_their_reasons(spark):
    def found(columns, schema, options=None, plan=lambda p: p, **kw):
        df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` string" for c in columns))
        p = analyze(df, F.monotonically_increasing_id(), options or AnalysisOptions(cultures=("",)))
        return {(f.severity, f.code, f.field, f.rows, f.bound, f.arguments.get("reason")): f for f in precheck(spark, plan(by_header(list(columns), schema, **kw)), schema, p).findings}

    nothing = lambda p: Plan(tuple(Binding(b.column, b.header, b.field, ("-",)) for b in p.bindings), p.culture)
    a = {"a": ["-", "-", "-"]}
    assert set(found(a, S.Schema((S.Field("a").require().must_be_unique(),)), plan=nothing)) == {("Blocking", "value.required", "a", 3, "Exact", "every-value-is-nothing"), ("Blocking", "value.not-unique", "a", None, "Exact", "spelled-as-nothing")}
    b = {"a": ["x", None, "y"], "b": ["1", "2", "3"]}
    assert set(found(b, S.Schema((S.Field("a").require().must_be_unique(),)))) == {("Warning", "value.required", "a", 1, "AtMost", "empty-cells"), ("Warning", "value.not-unique", "a", 1, "AtMost", "empty-cells")}
    assert ("Warning", "value.required", "a", 1, "Unknown", "empty-cells") in found(b, S.Schema((S.Field("a").require(),)), plan=nothing)
    both = S.Schema((S.Field("a").require(), S.Field("b")))
    assert ("Warning", "value.required", "a", 1, "AtLeast", "empty-cells") in found(b, both, plan=nothing) and ("Warning", "value.required", "a", 1, "Exact", "empty-cells") in found(b, both)
    c = found({"a": ["x", "y", None], "b": ["1", "2", "3"]}, S.Schema((S.Field("a").with_rules(S.allowed_values(["z"])), S.Field("b", "Integer").with_rules(S.min_value(9)))))
    assert set(c) == {("Warning", "value.not-allowed", "a", 2, "Exact", "values-fail"), ("Blocking", "value.out-of-range", "b", 3, "Exact", "no-row-can-satisfy")}
    f = c["Blocking", "value.out-of-range", "b", 3, "Exact", "no-row-can-satisfy"]
    assert (f.examples, f.arguments["failingCount"], f.arguments["judgedCount"], f.column) == (("1", "2", "3"), "3", "3", 1)
    d = found({"a": [str(i) for i in range(30)]}, S.Schema((S.Field("a", "Decimal").with_rules(S.min_value(9)),)), AnalysisOptions(cultures=("",), retained_distinct_values=10), culture="de-DE")
    assert set(d) == {("Undetermined", "value.out-of-range", "a", None, "Exact", "too-many-distinct"), ("Undetermined", "value.type-mismatch", "a", None, "Exact", "not-profiled")}
    for x in (c, d):
        assert all(set(f.arguments) <= set(ARGUMENTS) and f.arguments.get("reason", REASONS[0]) in REASONS for f in x.values())


def test_a_changed_sheet_stops_the_check(spark, tmp_path):
    export(str(tmp_path / "x.xlsx"), [sheet_of(spark, "one", [(1,)], ["a"])])
    p = open_workbook(spark, str(tmp_path / "x.xlsx")).profile()
    schema = S.Schema((S.Field("a"),))
    plan = by_header(["a"], schema, sheet_name="two")
    assert [(f.code, f.arguments) for f in precheck(spark, plan, schema, p).findings] == [("structure.sheet-changed", {"sheetIndex": "0"})]


def test_progress_and_cancellation(spark):
    told = []
    assert watched(spark, lambda: spark.range(0, 4_000_000, 1, 16).selectExpr("sum(id % 7)").first()[0], told.append, every=0.05) > 0
    assert told[-1].share == 1.0 and all(a.share <= b.share for a, b in zip(told, told[1:], strict=False))
    run = Run(spark, lambda: spark.range(0, 400, 1, 400).mapInArrow(lambda bs: [(time.sleep(0.5), b)[1] for b in bs], "id long").count())
    time.sleep(3)
    run.cancel()
    with pytest.raises(Cancelled):
        run.result()
    with pytest.raises(EngineError):
        watched(spark, lambda: (_ for _ in ()).throw(LimitError("limit.exceeded")))


def test_csv_delimiters():
    assert CsvOptions(culture="de-DE").resolved() == ";" and CsvOptions().resolved() == ","
    for bad in ('"', "\n", "ab", "x"):
        with pytest.raises(WriteError):
            CsvOptions(delimiter=bad).resolved()
