"""Csv reading and repair, workbooks, archives, and exports that read back."""

import gzip
import io
import tarfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsieve.errors import FormatError, WriteError
from tabsieve.sinks.csv import CsvOptions, checked, csv_bytes, quoted, write_csv
from tabsieve.sinks.workbooks import SheetOut, Style, write_ods, write_xlsx, write_zip_of_csv
from tabsieve.sources.dialect import Dialect, detect_dialect, detect_format
from tabsieve.sources.files import open_file
from tabsieve.sources.records import Repairs, records
from tabsieve.sources.scan import catalog, scan, scan_plain_csv, table
from tabsieve.sources.workbooks import column_index, from_duration, shows_a_date, unescaped


def cells(data, **options):
    f = open_file(data, "x", **options)
    return [[c.text for c in row] for _, row in f.rows(0)], f


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        ("Name;Stadt\nMüller;Köln\n".encode(), [["Name", "Stadt"], ["Müller", "Köln"]]),
        ("﻿Name;Stadt\nMüller;Köln\n".encode(), [["Name", "Stadt"], ["Müller", "Köln"]]),
        ("Name;Stadt\nMüller;Köln\n".encode("cp1252"), [["Name", "Stadt"], ["Müller", "Köln"]]),
        ("﻿a;b\n1;2\n".encode("utf-16-le"), [["a", "b"], ["1", "2"]]),
        (b"ID;Betrag;Land\n1,00;1.234,56;DEU\n2,00;22693870,00;AUT\n", [["ID", "Betrag", "Land"], ["1,00", "1.234,56", "DEU"], ["2,00", "22693870,00", "AUT"]]),
        (b'"Acme Corporation";"first line\r\nsecond line"\r\n"He said ""hello""";plain\r\n', [["Acme Corporation", "first line\r\nsecond line"], ['He said "hello"', "plain"]]),
        (b"a;b;c\n1;2\n1;2;3;4\n", [["a", "b", "c"], ["1", "2"], ["1", "2", "3", "4"]]),
        (b'ID;Street\n1;10 N. "K" St.\n2;100 21"st AVE\n', [["ID", "Street"], ["1", '10 N. "K" St.'], ["2", '100 21"st AVE']]),
        (b'ID;Street\n1;"C" Road\n2;"77 Main St, Suite 4"\n', [["ID", "Street"], ["1", "C Road"], ["2", "77 Main St, Suite 4"]]),
    ],
)
def test_csv(data, expected):
    assert cells(data)[0] == expected


def test_stray_quotes():
    d = Dialect("utf-8", ";")
    r = Repairs()
    rows = list(records('id;name;size;city;note\n1;pipe;";Bonn;a\n2;hose;";Ulm;b\n3;tap;half;Ulm;c\n', d, r))
    assert len(rows) == 4 and rows[1][2] == '"' and r.stray > 0
    for text, n in (('id;name;address;city;note\n1;A;"Road 1\nBack";Bonn;a\n2;B;R;U;b\n', 3), ('id;name;address;city;note\n1;A;R;B;"first; second\nthird; fourth"\n2;B;R;U;b\n', 3), ('id;name;note\n1;A;"first; second\nthird; fourth"\n2;B;b\n', 3)):
        r = Repairs()
        assert len(list(records(text, d, r))) == n and r.clean
    r = Repairs()
    assert len(list(records('id;size;note\n1;big;"never closed\n2;small;b\n', d, r))) == 3 and r.unterminated == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from('ab",;\n\r\t '), max_size=6), min_size=3, max_size=3), min_size=1, max_size=6))
def test_csv_round_trip(rows):
    def field(v):
        return '"' + v.replace('"', '""') + '"'

    text = "h1,h2,h3\r\n" + "".join(",".join(field(v) for v in r) + "\r\n" for r in rows)
    assert list(records(text, Dialect("utf-8", ",")))[1:] == rows


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from('a",;\n\r'), max_size=40))
def test_mangled_csv_never_fails(text):
    list(records(text, Dialect("utf-8", ",")))


def test_detection():
    assert detect_format(gzip.compress(b"a")) == "Gzip" and detect_format(b"a,b\n") == "Csv"
    assert detect_dialect(b"x\n", True)[0].delimiter == ";"
    assert detect_dialect(b"a,b\n1,2\n", True, delimiter="|")[0].delimiter_source == "Specified"
    for bad in (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest", b"<?xml version='1.0'?><a/>", bytes(range(255)) * 8):
        with pytest.raises(FormatError):
            open_file(bad)
    with pytest.raises(FormatError) as e:
        open_file(gzip.compress(b"a,b\n" * 99)[:-6])
    assert e.value.code == "format.truncated"
    with pytest.raises(FormatError):
        open_file(gzip.compress(gzip.compress(b"a")))


def test_archives():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for name, data in (("b.csv", b"x,y\n1,2\n"), ("a.csv", b"p;q\n"), (".hidden", b"h"), ("in.zip", z.getvalue() or b"PK\x05\x06" + bytes(18)), ("d.gz", gzip.compress(b"a")), ("old.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")):
            f.writestr(name, data)
    f = open_file(z.getvalue())
    assert [s.source for s in f.sheets] == ["a.csv", "b.csv"]
    assert {(s.path, s.reason) for s in f.skipped} == {("in.zip", "NestedArchive"), ("d.gz", "Compressed"), ("old.xls", "LegacyWorkbook")}
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        i = tarfile.TarInfo("a.csv")
        i.size = 4
        f.addfile(i, io.BytesIO(b"a,b\n"))
    for data in (t.getvalue(), gzip.compress(t.getvalue())):
        assert [[c.text for c in r] for _, r in open_file(data).rows(0)] == [["a", "b"]]
    with pytest.raises(FormatError):
        open_file(t.getvalue()[:1024])


def _package(sheet, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", parts.get("workbook", '<workbook xmlns="m"><sheets><sheet name="S" sheetId="1"/></sheets></workbook>'))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{sheet}</sheetData></worksheet>')
        if "strings" in parts:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="m">{parts["strings"]}</sst>')
        if "styles" in parts:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="m">{parts["styles"]}</styleSheet>')
    return out.getvalue()


def test_xlsx_cells():
    rows, f = cells(_package('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="inlineStr"><is><r><t>Two</t></r><r><t> runs</t></r></is></c><c r="E2" t="s"><v>9</v></c></row><row r="5"><c r="B5" s="1"><v>44927</v></c><c r="C5"><v>2.5</v></c><c r="D5" t="str"><v>a_x0041_b</v></c></row>', strings="<si><r><t>Hello</t></r><r><t> World</t></r><rPh><t>x</t></rPh></si>", styles='<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'))
    assert rows == [["Hello World", None, "true", "Two runs"], [None, "2023-01-01", "2.5", "aAb"]]
    assert [n for n, _ in f.rows(0)] == [2, 5]
    rows, _ = cells(_package('<row><c s="0"><v>43465</v></c></row>', workbook='<workbook xmlns="m"><workbookPr date1904="1"/><sheets><sheet name="S" sheetId="1"/></sheets></workbook>', styles='<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="170"/></cellXfs>'))
    assert rows == [["2023-01-01"]]
    assert column_index("XFD1") == 16383 and unescaped("_x000D_") == "\r" and not shows_a_date('0.0"d"') and shows_a_date("[h]:mm")
    with pytest.raises(FormatError):
        open_file(b"PK\x03\x04 not a package")


def test_durations():
    assert str(from_duration("PT1H2M3.5S")) == "1899-12-31 01:02:03.500000" and str(from_duration("P1DT1H")) == "1899-12-31 01:00:00"
    assert from_duration("-PT1H") is None and from_duration("PT") is None


@pytest.fixture(scope="module")
def sample(spark):
    return spark.sql("select 1L as n, 'a;\"b' as t, 1.5D as x, timestamp_ntz'2024-01-02 03:04:05' as d, true as b union all select 2L, 'line\nbreak', null, timestamp_ntz'1900-01-05', false union all select 3L, 'p  q_x0041_', -2e-7D, null, null")


def test_exports_read_back(spark, sample, tmp_path):
    p = str(tmp_path)
    write_xlsx(f"{p}/a.xlsx", [SheetOut("S", sample, "n", freeze_rows=1, auto_filter=True, header_style=Style(bold=True, fill="FFEE00"), merges=[(2, 0, 1, 2)])])
    write_ods(f"{p}/a.ods", [SheetOut("S", sample, "n")])
    write_zip_of_csv(f"{p}/a.zip", [SheetOut("S", sample, "n")])
    write_csv(sample, f"{p}/csv", "n")
    expected = [["a;\"b", "1.5", "2024-01-02T03:04:05", "true"], ["line\nbreak", None, "1900-01-05", "false"], ["p  q_x0041_", None, None, None]]
    for name in ("a.xlsx", "a.ods", "a.zip", "csv/part*"):
        rows = [[None if c is None else c["text"] for c in r["cells"]] for r in scan(spark, f"{p}/{name}").orderBy("row_number").collect()]
        assert rows[0] == ["t", "x", "d", "b"], name
        for got, want in zip(rows[1:], expected, strict=True):
            got = got + [None] * (4 - len(got))
            assert got[0] == want[0] and got[2:] == want[2:] and (got[1] == want[1] or float(got[1]) == -2e-7), name
    assert table(scan(spark, f"{p}/a.xlsx")).columns == ["row_number", "t", "x", "d", "b"]
    assert catalog(spark, f"{p}/a.zip").first()["rows"] == 4


def test_refusals(spark, sample, tmp_path):
    lines = spark.createDataFrame([(1, "x\n" * 101)], "n long, t string")
    with pytest.raises(WriteError) as e:
        checked(lines, "n")
    assert e.value.code == "write.too-many-lines"
    early = spark.sql("select 1L as n, timestamp_ntz'1850-01-01' as d")
    with pytest.raises(WriteError):
        write_xlsx(str(tmp_path / "x.xlsx"), [SheetOut("S", early, "n")])
    assert not list(tmp_path.iterdir())
    for name in ("", "a/b", "x" * 32, "'q"):
        with pytest.raises(WriteError):
            write_ods(str(tmp_path / "x.ods"), [SheetOut(name, sample, "n")])
    with pytest.raises(WriteError):
        write_zip_of_csv(str(tmp_path / "x.zip"), [SheetOut("con", sample, "n")])


def test_csv_options(spark, sample):
    text = b"".join(csv_bytes(sample.select("n", "t", "x"), "n", CsvOptions(culture="de-DE", byte_order_mark=False))).decode()
    assert text.startswith('t;x\r\n"a;""b";"1,5"\r\n')
    got = spark.createDataFrame([("a,b",), ("x",), (None,)], "t string").select(quoted(F.col("t"), ";").alias("q")).collect()
    assert [r[0] for r in got] == ['"a,b"', "x", ""]


def test_plain_csv_is_split(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a;b\n" + "".join(f"{i};x\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = scan_plain_csv(spark, str(tmp_path / "p.csv"))
        rows = df.orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_number"] for r in rows] == list(range(1, 5002)) and rows[4000]["cells"] == ["3999", "x"]
    (tmp_path / "q.csv").write_text('a;"b"\n')
    with pytest.raises(ValueError):
        scan_plain_csv(spark, str(tmp_path / "q.csv"))


def test_formats():
    from tabsieve.sinks.formats import color, date_format, number_format

    for ok in ("0", "#,##0.00", '"EUR "#,##0.0#%', "00"):
        assert number_format(ok) == ok
    for bad in ("", "0#", "0.#0", ",0", "0,", "x", "0." + "0" * 31):
        with pytest.raises(ValueError):
            number_format(bad)
    assert date_format("hh:mm") == ["hh", ":", "minutes"] and date_format("yyyy-mm-dd")[2] == "mm" and date_format("m:ss")[0] == "minute"
    for bad in ("", "q", '"x"'):
        with pytest.raises(ValueError):
            date_format(bad)
    assert color("#fa0") == "FFAA00" and color("00ff00") == "00FF00"
    with pytest.raises(ValueError):
        Style(fill="red")


def test_style_rules(spark, tmp_path):
    df = spark.createDataFrame([(1, 5, "hot"), (2, 6, None)], "n long, v long, how string")
    write_xlsx(str(tmp_path / "r.xlsx"), [SheetOut("S", df, "n", rules={"v": "how"}, named={"hot": Style(fill="#f00")})])
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "FFFF0000" in z.read("xl/styles.xml").decode() and 's="3"><v>5<' in sheet and 's="0"><v>6<' in sheet
