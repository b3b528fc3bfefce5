"""Tables dealt to workbooks alike, and the pattern readers of their rows."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from tabsieve import queries_files
from tabsieve.api import export_files, open_workbook
from tabsieve.errors import EngineError, StructureError
from tabsieve.plans import schema as S
from tabsieve.sinks import workbooks
from tabsieve.sinks.workbooks import SheetOut, dealt
from tabsieve.sources.scan import catalog
from tabsieve.sources.workbooks import Ods

SF = "/root/testdata/sf0.001"
URN = "urn:oasis:names:tc:opendocument:xmlns:"
HEAD = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {" ".join(f"xmlns:{p}=\"{URN}{p}:1.0\"" for p in ("office", "table", "text", "style"))}><office:automatic-styles><style:style style:name="h" style:family="table"><style:table-properties table:display="false"/></style:style></office:automatic-styles><office:body><office:spreadsheet>'
TAIL = "</office:spreadsheet></office:body></office:document-content>"


def _ods(content: str) -> Ods:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", content)
    return Ods(z.getvalue())


def _sql(name: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    return sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries_files.SQL[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["typed_ods", "typed_workbook", "workbook_profile"])
def test_larger_tables_are_dealt_to_workbooks(spark, monkeypatch, name):
    """1,500 orders and sheets of at most 1,000 rows."""
    monkeypatch.setattr(queries_files, "BOOK_ROWS", 400)
    monkeypatch.setattr(workbooks, "MAX_ROWS", 1000)
    df = queries_files.QUERIES[name](spark, SF)
    assert sorted((tuple(r) for r in df.collect()), key=str) == _sql(name, df.columns)


def test_dealt_counts_rows(spark):
    """Null, repeated and distant keys: no frame is larger, no row is lost, frames follow in order."""
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id") * 7_000_000_000).alias("k"), "id")
    parts, held = dealt(df, "k", 300)
    rows = [p.collect() for p in parts]
    held.unpersist()
    assert [len(r) for r in rows] == [300, 300, 300, 100]
    assert sorted(r["id"] for p in rows for r in p) == list(range(1000))
    keys = [[-1 if r["k"] is None else r["k"] for r in p] for p in rows]
    assert all(max(a) <= min(b) for a, b in zip(keys, keys[1:], strict=False))


def test_files_alike_share_their_headers(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "n long, x string")
    files = {f"{tmp_path}/{i}.xlsx": [SheetOut("s", one if i else one.withColumnRenamed("x", "y"), "n")] for i in range(3)}
    assert export_files(spark, files) == {path: {"s": 2} for path in files}
    schema = S.Schema((S.Field("x"),))
    f = open_workbook(spark, [p for p in files if not p.endswith("0.xlsx")])
    assert sorted(r["x"] for r in f.extract(f.plan(schema), schema).accepted().collect()) == ["a", "a", "b", "b"]
    f = open_workbook(spark, list(files))
    with pytest.raises(StructureError):
        f.profile()
    with pytest.raises(StructureError):
        f.plan(schema)
    assert [r["rows"] for r in catalog(spark, list(files)).collect()] == [3, 3, 3]
    assert [r["rows"] for r in catalog(spark, list(files), False).collect()] == [None] * 3


CELLS = [
    '<table:table-cell office:value-type="float" office:value="1.50"/><table:table-cell/>',
    '<table:table-cell table:number-columns-repeated="3"/><table:table-cell office:value-type="percentage" office:value="0.5"><text:p>50%</text:p></table:table-cell>',
    '<table:table-cell table:number-columns-spanned="2" office:value-type="string"><text:p>a &lt;&amp;&gt;  ö</text:p></table:table-cell><table:covered-table-cell/><table:table-cell office:value-type="boolean" office:boolean-value="true"/>',
    '<table:table-cell office:value-type="string"><text:p>a<text:s text:c="2"/>b</text:p><text:p>c</text:p></table:table-cell>',
    '<table:table-cell office:value-type="date" office:date-value="2024-02-29" table:number-columns-repeated="2"/><table:table-cell office:value-type="float" office:value="1e999"><text:p>much</text:p></table:table-cell>',
    '\n <table:table-cell office:value-type="float" office:value="7"/>\n',
    '<table:table-cell office:value-type="string" office:string-value="x&#10;y"><text:p>x</text:p></table:table-cell>',
]


def _table(name: str, more: str = "") -> str:
    rows = "".join(f"<table:table-row{' table:number-rows-repeated=\"2\"' if i == 2 else ''}>{c}</table:table-row>" for i, c in enumerate(CELLS))
    return f'<table:table table:name="{name}"{more}><table:table-column/><table:table-header-rows>{rows}</table:table-header-rows><table:table-row/>{rows}<table:table-row table:number-rows-repeated="1000"/></table:table>'


def test_ods_patterns_read_what_the_parser_reads():
    book = _ods(HEAD + _table("one") + _table("two &amp; 2", ' table:style-name="h"') + '<table:table table:name="none"/>' + TAIL)
    assert book._plain and [(s.name, s.visibility) for s in book.sheets] == [("one", "Visible"), ("two & 2", "Hidden"), ("none", "Visible")]
    for i in range(3):
        assert list(book.rows(i)) == list(book._parsed_rows(i)) == list(book._plain_rows(i))
    assert len(list(book.rows(0))) == 16 and not list(book.rows(2))


@pytest.mark.parametrize("inner", ["<!-- <table:table-row> -->", '<table:table-row><table:table-cell><table:table table:name="in"><table:table-row/></table:table></table:table-cell></table:table-row>', "<![CDATA[x]]>"])
def test_ods_of_other_forms_goes_through_the_parser(inner):
    book = _ods(HEAD + _table("one") + f'<table:table table:name="two">{inner}<table:table-row>{CELLS[0]}</table:table-row></table:table>' + TAIL)
    assert not book._plain and [s.name for s in book.sheets] == ["one", "two"]
    assert [c.num for _, r in book.rows(1) for c in r] == [1.5]


@pytest.mark.parametrize("cut", [len(HEAD) // 2, len(HEAD) + 40, -1])
def test_ods_that_ends_early_is_an_error(cut):
    with pytest.raises(EngineError):
        _ods((HEAD + _table("one") + TAIL)[:cut])
