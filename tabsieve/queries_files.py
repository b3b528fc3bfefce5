"""Registered queries that write files of the test tables, read them back, and their DuckDB SQL over the tables."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import export, export_files, open_workbook
from .operators.profile import AnalysisOptions
from .plans import schema as S
from .scratch import new_path, put_bytes
from .sinks.csv import CsvOptions, refusals
from .sinks.workbooks import SheetOut, Style, dealt
from .sources.scan import catalog, scan

SHEET_ROWS = 1_000_000  # of one sheet; larger tables are dealt to as many sheets as they need
BOOK_ROWS = 250_000  # of one workbook, which one task reads; larger tables are dealt to as many workbooks as they need
BOOK_PARTITIONS = 4


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sheets(df: DataFrame, row: str, name: str, **layout) -> list[SheetOut]:
    k = max(1, -(-df.count() // SHEET_ROWS))
    part = F.pmod(F.col(row), F.lit(k))
    return [SheetOut(f"{name}{i}", df if k == 1 else df.where(part == i), row, **layout) for i in range(k)]


def _books(spark: SparkSession, df: DataFrame, row: str, file: str, **layout) -> str:
    """Writes df in order of row as workbooks of one sheet and BOOK_ROWS rows, however its keys lie: their folder."""
    name, _, ending = file.partition(".")
    folder = new_path(spark, name)
    if df.count() <= BOOK_ROWS:
        export(f"{folder}/0.{ending}", [SheetOut(name, df, row, **layout)])
        return folder
    parts, held = dealt(df, row, BOOK_ROWS)
    try:
        export_files(spark, {f"{folder}/{i}.{ending}": [SheetOut(name, part, row, partitions=BOOK_PARTITIONS, **layout)] for i, part in enumerate(parts)})
    finally:
        held.unpersist()
    return folder


def _orders(spark, sf):
    """Orders with a native cell of every kind."""
    o = _t(spark, sf, "orders")
    return o.select("o_orderkey", F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("price"), F.col("o_orderdate").cast("timestamp_ntz").alias("day"), F.col("o_orderpriority").startswith("1").alias("urgent"), F.concat("o_orderpriority", F.lit(" <&> ö")).alias("note"))


ORDERS = S.Schema((S.Field("key", "Integer").require(), S.Field("price", "Decimal"), S.Field("day", "Date"), S.Field("urgent", "Boolean"), S.Field("note")))


def _extracted(spark, path, schema, culture, **options):
    f = open_workbook(spark, path, **options)
    return f.extract(f.plan(schema, culture), schema).accepted().drop("row_number")


def typed_workbook(spark, sf):
    """Orders written as workbooks and imported under a culture that would misread their numbers as text."""
    path = _books(spark, _orders(spark, sf), "o_orderkey", "orders.xlsx", header_style=Style(bold=True), styles={"price": Style(number_format="#,##0.00")}, freeze_rows=1, auto_filter=True)
    x = _extracted(spark, path, ORDERS, "de-DE")
    return x.select("key", F.col("price").cast("double").alias("price"), F.date_format("day", "yyyy-MM-dd").alias("day"), "urgent", "note")


def typed_ods(spark, sf):
    """The same by OpenDocument sheets with styles, merges and filters."""
    path = _books(spark, _orders(spark, sf), "o_orderkey", "orders.ods", styles={"price": Style(number_format="#,##0.00", align="right")}, freeze_rows=1, auto_filter=True, merges=[(1, 3, 1, 2)])
    x = _extracted_by_position(spark, path)
    return x


def _extracted_by_position(spark, path):
    """Cells as the file types them: the header's second merged cell is covered, so columns are taken by position."""
    rows = scan(spark, path).where("row_number > 1")
    c = lambda i: F.get("cells", i)
    return rows.select(c(0)["num"].cast("long").alias("key"), c(1)["num"].alias("price"), F.date_format(c(2)["date"], "yyyy-MM-dd").alias("day"), (c(3)["text"] == "true").alias("urgent"), c(4)["text"].alias("note"))


_ORDERS_SQL = "SELECT o_orderkey AS key, round(o_totalprice, 2) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority LIKE '1%' AS urgent, o_orderpriority || ' <&> ö' AS note FROM orders"


def workbook_profile(spark, sf):
    """Kinds, readings and first hypothesis of every column of workbooks alike."""
    df = _orders(spark, sf).withColumn("note", F.when(F.col("key") % 3 != 0, F.col("note")))
    path = _books(spark, df, "o_orderkey", "orders.xlsx")
    p = open_workbook(spark, path).profile(analysis=AnalysisOptions(cultures=("", "de-DE")))
    rows = [(c.header, c.non_empty, c.empty, c.distinct, c.is_unique, *(c.kinds.get(k, 0) for k in ("Text", "Number", "Date", "Boolean")), c.readings[1].integers, c.readings[1].decimals, c.readings[1].dates, c.booleans, c.hypotheses[0].type, float(c.hypotheses[0].confidence)) for c in p.columns]
    return spark.createDataFrame(rows, "column_name string, non_empty long, empty long, distinct_count long, is_unique boolean, text long, number long, date long, boolean long, integers long, decimals long, dates long, booleans long, first_type string, confidence double")


WORKBOOK_PROFILE_SQL = """
WITH o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS p, o_orderdate AS d, o_orderpriority LIKE '1%' AS u, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS n FROM orders)
SELECT 'key' AS column_name, count(*) AS non_empty, 0::BIGINT AS empty, count(DISTINCT k) AS distinct_count, count(DISTINCT k) = count(*) AS is_unique, 0::BIGINT AS text, count(*) AS number, 0::BIGINT AS date, 0::BIGINT AS boolean, count(*) AS integers, 0::BIGINT AS decimals, 0::BIGINT AS dates, 0::BIGINT AS booleans, 'Integer' AS first_type, 1.0::DOUBLE AS confidence FROM o
UNION ALL SELECT 'price', count(*), 0, count(DISTINCT p), count(DISTINCT p) = count(*), 0, count(*), 0, 0, count(*) FILTER (WHERE p = floor(p)), count(*) FILTER (WHERE p <> floor(p)), 0, 0, 'Decimal', 1.0 FROM o
UNION ALL SELECT 'day', count(*), 0, count(DISTINCT d), count(DISTINCT d) = count(*), 0, 0, count(*), 0, 0, 0, count(*), 0, 'Date', 1.0 FROM o
UNION ALL SELECT 'urgent', count(*), 0, count(DISTINCT u), count(DISTINCT u) = count(*), 0, 0, 0, count(*), 0, 0, 0, count(*), 'Boolean', 1.0 FROM o
UNION ALL SELECT 'note', count(n), count(*) - count(n), count(DISTINCT n), false, count(n), 0, 0, 0, 0, 0, 0, 0, 'Text', 1.0 FROM o"""


def _small(spark, sf):
    n = _t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"), (F.col("n_nationkey") / 4).alias("quarter"))
    r = _t(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("code"))
    return n, r


def zip_of_csv(spark, sf):
    """Suppliers and nations as an archive of German csv sheets, read back as one workbook."""
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("balance"))
    path = new_path(spark, "both.zip")
    export(path, [*_sheets(s, "s_suppkey", "suppliers"), SheetOut("nations", _small(spark, sf)[0], "n_nationkey")], CsvOptions(culture="de-DE"))
    return _cells_read(scan(spark, path))


def _cells_read(rows):
    texts = F.transform("cells", lambda c: F.coalesce(c["text"], F.lit("")))
    return rows.select("source", "row_number", F.array_join(texts, "|").alias("cells"))


def _plain(x: str) -> str:
    """DuckDB: a number's text without trailing zeros, with a comma."""
    return f"replace(regexp_replace(regexp_replace(({x})::DECIMAL(18,2)::VARCHAR, '0+$', ''), '[.]$', ''), '.', ',')"


ZIP_SQL = f"""
SELECT 'nations.csv' AS source, 1::BIGINT AS row_number, 'name|quarter' AS cells
UNION ALL SELECT 'suppliers0.csv', 1, 's_name|balance'
UNION ALL SELECT 'nations.csv', 1 + row_number() OVER (ORDER BY n_nationkey), n_name || '|' || {_plain("n_nationkey / 4")} FROM nation
UNION ALL SELECT 'suppliers0.csv', 1 + row_number() OVER (ORDER BY s_suppkey), s_name || '|' || {_plain("round(s_acctbal, 2)")} FROM supplier"""


def _texts(spark, sf) -> dict[str, str]:
    """Nations and regions (25 and 5 rows) as csv."""
    n, r = _small(spark, sf)
    return {name: "".join(f"{x}\r\n" for x in (";".join(df.columns), *(";".join(map(str, row)) for row in df.orderBy(df.columns[0]).collect()))) for name, df in (("nations.csv", n), ("regions.csv", r))}


def packed_files(spark, sf):
    """The same csv plain, gzipped, in a zip, a tar and a gzipped tar, under names that tell nothing."""
    texts = _texts(spark, sf)
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for name, text in texts.items():
            f.writestr(name, text)
    with tarfile.open(fileobj=t, mode="w", format=tarfile.PAX_FORMAT) as f:
        for name, text in texts.items():
            i = tarfile.TarInfo("long/" * 30 + name)
            i.size = len(text.encode())
            f.addfile(i, io.BytesIO(text.encode()))
    out = None
    for kind, data in (("csv", texts["nations.csv"].encode()), ("gzip", gzip.compress(texts["nations.csv"].encode())), ("zip", z.getvalue()), ("tar", t.getvalue()), ("tar.gz", gzip.compress(t.getvalue()))):
        one = scan(spark, put_bytes(spark, "file", data)).select(F.lit(kind).alias("kind"), F.substring_index("source", "/", -1).alias("source"), "row_number", F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("cells"))
        out = one if out is None else out.unionByName(one)
    return out


PACKED_SQL = """
WITH n AS (SELECT 1 AS row_number, 'n_nationkey|name|quarter' AS cells UNION ALL SELECT 1 + row_number() OVER (ORDER BY n_nationkey), n_nationkey || '|' || n_name || '|' || (n_nationkey / 4)::DOUBLE FROM nation),
r AS (SELECT 1 AS row_number, 'r_regionkey|name|code' AS cells UNION ALL SELECT 1 + row_number() OVER (ORDER BY r_regionkey), r_regionkey || '|' || r_name || '|' || r_regionkey FROM region)
SELECT k AS kind, NULL::VARCHAR AS source, row_number::BIGINT AS row_number, cells FROM n, (VALUES ('csv'), ('gzip')) x(k)
UNION ALL SELECT k, 'nations.csv', row_number, cells FROM n, (VALUES ('zip'), ('tar'), ('tar.gz')) x(k)
UNION ALL SELECT k, 'regions.csv', row_number, cells FROM r, (VALUES ('zip'), ('tar'), ('tar.gz')) x(k)"""


def file_catalog(spark, sf):
    """What files are, by their bytes: format, encoding, delimiter, rows; and what an archive leaves out, and why."""
    texts = _texts(spark, sf)
    nations = texts["nations.csv"].replace("name", "Länge")
    z = io.BytesIO()
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as f:
        f.writestr("x.csv", "a;b\n")
    with zipfile.ZipFile(z, "w") as f:
        for name, data in (("a.csv", texts["regions.csv"]), (".hidden", "h"), ("__MACOSX/a.csv", "h"), ("in.zip", inner.getvalue()), ("in.gz", gzip.compress(b"a")), ("old", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("page", "<?xml version='1.0'?><a/>"), ("noise", b"\0\1\2\0\3" * 99)):
            f.writestr(name, data)
    files = {
        "utf-8 with mark": b"\xef\xbb\xbf" + nations.encode(),
        "utf-8": nations.encode(),
        "windows": nations.encode("cp1252"),
        "utf-16 little": b"\xff\xfe" + nations.encode("utf-16-le"),
        "utf-16 big, no mark": nations.replace("Länge", "name").encode("utf-16-be"),
        "commas": nations.replace(";", ",").encode(),
        "tabs": nations.replace(";", "\t").encode(),
        "gzip": gzip.compress(nations.encode()),
        "stray quote": nations.replace("NATION_3", '"NATION_3').encode(),
        "archive": z.getvalue(),
        "legacy": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
        "truncated": gzip.compress(nations.encode())[:-9],
    }
    out = None
    for name, data in files.items():
        one = catalog(spark, put_bytes(spark, "file", data)).select(F.lit(name).alias("file"), "source", "format", "encoding", "delimiter", "rows", "stray_quotes", "unterminated_quotes", "skipped")
        out = one if out is None else out.unionByName(one)
    return out


FILE_CATALOG_SQL = """
WITH n AS (SELECT count(*) + 1 AS rows FROM nation), r AS (SELECT count(*) + 1 AS rows FROM region)
SELECT file, NULL::VARCHAR AS source, 'Csv' AS format, encoding, delimiter, n.rows, 0::BIGINT AS stray_quotes, u::BIGINT AS unterminated_quotes, NULL::VARCHAR AS skipped
FROM n, (VALUES ('utf-8 with mark', 'utf-8', ';', 0), ('utf-8', 'utf-8', ';', 0), ('windows', 'cp1252', ';', 0), ('utf-16 little', 'utf-16-le', ';', 0), ('utf-16 big, no mark', 'utf-16-be', ';', 0), ('commas', 'utf-8', ',', 0), ('tabs', 'utf-8', chr(9), 0), ('gzip', 'utf-8', ';', 0), ('stray quote', 'utf-8', ';', 1)) x(file, encoding, delimiter, u)
UNION ALL SELECT 'archive', 'a.csv', 'Csv', 'utf-8', ';', r.rows, 0, 0, NULL FROM r
UNION ALL SELECT 'archive', s, NULL, NULL, NULL, NULL, NULL, NULL, w FROM (VALUES ('in.zip', 'NestedArchive'), ('in.gz', 'Compressed'), ('old', 'LegacyWorkbook'), ('page', 'XmlDocument'), ('noise', 'Binary')) x(s, w)
UNION ALL SELECT f, NULL, NULL, NULL, NULL, NULL, NULL, NULL, w FROM (VALUES ('legacy', 'format.unsupported'), ('truncated', 'format.truncated')) x(f, w)"""


def malformed_csv(spark, sf):
    """Customers written with every kind of bad quoting, in as many files as there are partitions; records as repaired."""
    c, k = _t(spark, sf, "customer"), F.col("c_custkey")
    line = (
        F.when(k % 6 == 0, F.format_string('%d;"%s" Road;10 N. "K" St.;Ulm;a', k, "c_name"))
        .when(k % 6 == 1, F.format_string('%d;%s;";Ulm;b', k, "c_name"))
        .when(k % 6 == 2, F.format_string('%d;%s;"Road 1\nBack";Bonn;c', k, "c_name"))
        .when(k % 6 == 3, F.format_string('%d;"say ""%s"", twice; or so";  padded  ;;d', k, "c_name"))
        .when(k % 6 == 4, F.format_string("%d;%s;short", k, "c_name"))
        .otherwise(F.format_string('%d;%s;21"st AVE;X;e;more', k, "c_name"))
    )
    path = new_path(spark, "customers")
    head = F.concat(F.lit("id;name;street;city;note\n"), "value")
    parts = c.select(line.alias("value"), F.monotonically_increasing_id().alias("i"))
    parts.select(F.when(F.pmod("i", F.lit(1 << 33)) == 0, head).otherwise(F.col("value")).alias("value")).write.text(path)
    rows = scan(spark, path + "/part-*", delimiter=";").where("row_number > 1")
    return rows.select(F.get("cells", 0)["text"].cast("long").alias("id"), F.size("cells").alias("width"), F.array_join(F.transform(F.slice("cells", 2, 16), lambda x: F.coalesce(x["text"], F.lit("-"))), "|").alias("cells"))


MALFORMED_SQL = """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 4 THEN 3 WHEN 5 THEN 6 ELSE 5 END AS width, CASE c_custkey % 6
  WHEN 0 THEN c_name || ' Road|10 N. "K" St.|Ulm|a' WHEN 1 THEN c_name || '|"|Ulm|b' WHEN 2 THEN c_name || '|Road 1' || chr(10) || 'Back|Bonn|c'
  WHEN 3 THEN 'say "' || c_name || '", twice; or so|padded|-|d' WHEN 4 THEN c_name || '|short' ELSE c_name || '|21"st AVE|X|e|more' END AS cells
FROM customer"""


def padded_columns(spark, sf):
    """Rows padded with delimiters: columns reach as far as the header's or a row's last value."""
    n = _t(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows
    text = "\n\nid;name;;;;\n" + "".join(f"{k};{name};;;;\n" if k != 3 else f"{k};{name};late;;;\n;;;;;\n" for k, name in n)
    p = open_workbook(spark, put_bytes(spark, "padded.csv", text.encode())).profile(header_row=2)
    return spark.createDataFrame([(c.index, c.header, p.rows, c.non_empty, c.empty, c.is_unique) for c in p.columns], "column_index int, header string, rows long, non_empty long, empty long, is_unique boolean")


PADDED_SQL = "SELECT i AS column_index, h AS header, n AS rows, CASE i WHEN 2 THEN 1 ELSE n END AS non_empty, CASE i WHEN 2 THEN n - 1 ELSE 0 END AS empty, i <> 2 AS is_unique FROM (SELECT count(*) AS n FROM nation), (VALUES (0, 'id'), (1, 'name'), (2, '')) x(i, h)"


def write_refusals(spark, sf):
    """Values that no csv holds so that they read back, by their codes."""
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    text = F.when(k % 7 == 0, F.repeat(F.lit("x\n"), 101)).when(k % 7 == 1, F.concat(F.lit("bell "), F.chr(F.lit(7)))).when(k % 7 == 2, F.lit("a,b,\nc,d,e")).otherwise(F.lit("plain\nlines"))
    x = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 11 == 1, F.col("o_totalprice") / 3).when(k % 11 == 2, F.lit(1e300)).otherwise(F.col("k100") / 100)
    day = F.when(k % 13 == 0, F.lit("0001-05-05").cast("date")).otherwise(F.lit("1500-01-01").cast("date"))
    df = o.withColumn("k100", F.floor(F.col("o_totalprice") * 100)).select("o_orderkey", text.alias("text"), x.alias("x"), day.alias("day"), F.lit(1).alias("a"), F.lit(2).alias("b"))
    return refusals(df, "o_orderkey").select("row_number", F.col("column").alias("column_name"), "code")


WRITE_REFUSALS_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_totalprice / 3 AS x FROM orders)
SELECT k AS row_number, 'text' AS column_name, CASE k % 7 WHEN 0 THEN 'write.too-many-lines' WHEN 1 THEN 'write.invalid-character' ELSE 'write.ambiguous-line-breaks' END AS code FROM o WHERE k % 7 <= 2
UNION ALL SELECT k, 'x', CASE k % 11 WHEN 0 THEN 'write.not-finite' ELSE 'write.precision-loss' END FROM o WHERE k % 11 IN (0, 2) OR (k % 11 = 1 AND format('{:.14e}', x)::DOUBLE <> x)
UNION ALL SELECT k, 'day', 'write.date-out-of-range' FROM o WHERE k % 13 = 0"""


def plain_csv_split(spark, sf):
    """Line items as csv parts without quotes, each split by Spark into lines."""
    from .sinks.csv import write_csv
    from .sources.scan import scan_plain_csv

    li = _t(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("row"), "l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), "l_shipdate")
    path = new_path(spark, "lines")
    write_csv(li, path, "row", CsvOptions(delimiter=";", byte_order_mark=False))
    cells = scan_plain_csv(spark, path + "/part-*", ";").where("cells[0] != 'l_orderkey'")
    get = lambda i: F.get("cells", F.lit(i))
    return cells.select(get(0).cast("long").alias("l_orderkey"), get(1).cast("int").alias("l_linenumber"), get(2).cast("double").alias("price"), get(3).alias("day"))


QUERIES = {f.__name__: f for f in (typed_workbook, typed_ods, workbook_profile, zip_of_csv, packed_files, file_catalog, malformed_csv, padded_columns, write_refusals, plain_csv_split)}

SQL = {
    "typed_workbook": _ORDERS_SQL,
    "typed_ods": _ORDERS_SQL,
    "workbook_profile": WORKBOOK_PROFILE_SQL,
    "zip_of_csv": ZIP_SQL,
    "packed_files": PACKED_SQL,
    "file_catalog": FILE_CATALOG_SQL,
    "malformed_csv": MALFORMED_SQL,
    "padded_columns": PADDED_SQL,
    "write_refusals": WRITE_REFUSALS_SQL,
    "plain_csv_split": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem",
}
