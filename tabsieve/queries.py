"""Registered queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import readings as R
from .functions.cultures import culture
from .operators import profile as P
from .operators.extract import compile_plan, not_in
from .plans import schema as S
from .plans.mapping import by_header
from .sinks.csv import CsvOptions, lines
from .sources.dialect import Dialect
from .sources.records import records

PROFILED = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "lineitem": "l_orderkey", "events": "event_id"}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(spark, sf, table, columns=None):
    return P.cells(_t(spark, sf, table), PROFILED[table], columns)


def profile_counts(spark, sf):
    """Rows, empties, distinct values and uniqueness of every column."""
    out = None
    for table in ("customer", "orders", "lineitem", "events"):
        df = _t(spark, sf, table)
        rows = df.count()
        one = P.column_facts(P.tally(P.cells(df, PROFILED[table])), rows, ("",)).select(F.lit(table).alias("table_name"), F.col("name").alias("column_name"), "non_empty", F.col("empty").cast("long").alias("empty"), F.col("distinct").alias("distinct_count"), "is_unique")
        out = one if out is None else out.unionByName(one)
    return out


_BY_SECOND = "date_trunc('second', ts)"  # a cell's text holds no fractions


def _counts_sql(table, columns):
    out = []
    for c in columns:
        v = f"nullif(trim({_BY_SECOND if c == 'ts' else c}::VARCHAR), '')"
        out.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({v}) AS non_empty, count(*) - count({v}) AS empty, count(DISTINCT {v}) AS distinct_count, count(DISTINCT {v}) = count(*) AS is_unique FROM {table}")
    return " UNION ALL ".join(out)


COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def _shown(c: str) -> str:
    """DuckDB: a cell's text."""
    return f"strftime({c}, '%Y-%m-%d')" if c.endswith("date") else f"regexp_replace({c}::VARCHAR, '[.]0$', '')" if c.endswith(("price", "bal")) else f"{c}::VARCHAR"


def profile_lengths(spark, sf):
    """Shortest and longest value, in UTF-16 units."""
    t = P.tally(P.cells(_t(spark, sf, "documents"), "doc_id", ["doc_id", "lang", "source", "n_chars", "text"]))
    return P.column_facts(t, 0, ("",)).select(F.col("name").alias("column_name"), "min_length", "max_length")


def profile_number_range(spark, sf):
    t = P.tally(_values(spark, sf, "lineitem")).unionByName(P.tally(_values(spark, sf, "orders")))
    return P.column_facts(t.where("kind = 'Number'"), 0, ("",)).select(F.col("name").alias("column_name"), (F.col("integers_0") + F.col("decimals_0")).alias("numbers"), F.col("min_number_0").cast("double").alias("min_number"), F.col("max_number_0").cast("double").alias("max_number"))


def top_values(spark, sf):
    return P.top_values(P.tally(_values(spark, sf, "orders")), 20).select(F.col("name").alias("column_name"), F.col("place").alias("place"), F.col("text").alias("value"), F.col("n").alias("n"))


def first_samples(spark, sf):
    return P.first_values(_values(spark, sf, "customer"), 10).select(F.col("name").alias("column_name"), "place", "row_number", F.col("text").alias("value"))


def value_tally(spark, sf):
    """All distinct values in order of first appearance, of columns that have few."""
    t = P.tally(_values(spark, sf, "customer"))
    return P.distinct_values(t, 100).select(F.col("name").alias("column_name"), "place", F.col("text").alias("value"), "n")


def rows_with_value_in(spark, sf):
    return P.rows_with_value_in(P.tally(_values(spark, sf, "customer")), "c_mktsegment", ["BUILDING", "MACHINERY"])


def _rendered_orders(spark, sf):
    """Orders with dates written day/month/year and prices in German and in English."""
    o = _t(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    return o.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.concat(F.format_number(whole, 0), F.lit("."), part).alias("english"), F.concat(F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), part).alias("german"), F.concat(whole.cast("string"), F.lit(","), part).alias("plain"))


def parse_counts(spark, sf):
    """What each culture reads of numbers and dates written as text."""
    t = P.tally(P.cells(_rendered_orders(spark, sf), "o_orderkey", ["day", "english", "german", "plain"]))
    f = P.column_facts(t, 0, ("", "de-DE"))
    return f.select(F.col("name").alias("column_name"), *[F.col(f"{x}_{k}").alias(f"{x}_{n}") for k, n in enumerate(("inv", "de")) for x in ("integers", "decimals", "other_separator", "dates", "own_separator")])


_RENDERED_SQL = "WITH o AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS day, round(o_totalprice * 100)::BIGINT AS c FROM orders), r AS (SELECT day, format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS english, replace(format('{:,}', c // 100), ',', '.') || ',' || lpad((c % 100)::VARCHAR, 2, '0') AS german, (c // 100)::VARCHAR || ',' || lpad((c % 100)::VARCHAR, 2, '0') AS plain FROM o) "
PARSE_SQL = _RENDERED_SQL + """
SELECT 'day' AS column_name, 0::BIGINT AS integers_inv, 0::BIGINT AS decimals_inv, 0::BIGINT AS other_separator_inv, count(*) FILTER (WHERE substr(day, 1, 2)::INT <= 12) AS dates_inv, count(*) FILTER (WHERE substr(day, 1, 2)::INT <= 12) AS own_separator_inv, 0::BIGINT AS integers_de, 0::BIGINT AS decimals_de, 0::BIGINT AS other_separator_de, count(*) AS dates_de, 0::BIGINT AS own_separator_de FROM r
UNION ALL SELECT 'english', 0, count(*), 0, 0, 0, 0, 0, count(*) FILTER (WHERE regexp_matches(english, '^[0-9]+[.][0-9]+$')), 0, 0 FROM r
UNION ALL SELECT 'german', 0, 0, count(*) FILTER (WHERE regexp_matches(german, '^[0-9]+,[0-9]+$')), 0, 0, 0, count(*), 0, 0, 0 FROM r
UNION ALL SELECT 'plain', 0, 0, count(*), 0, 0, 0, count(*), 0, 0, 0 FROM r"""


def disagree_dates(spark, sf):
    """Rows that day-first and month-first cultures both read, but as different dates."""
    d = _rendered_orders(spark, sf).select(R.date(F.col("day"), culture("")).alias("a"), R.date(F.col("day"), culture("de-DE")).alias("b"))
    return d.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).alias("rows_read_differently"), F.count_if(F.col("a").isNull()).alias("only_day_first"))


def grouped_numbers(spark, sf):
    r = _rendered_orders(spark, sf)
    return r.select("o_orderkey", R.decimal(F.col("german"), culture("de-DE")).cast("double").alias("de"), R.decimal(F.col("english"), culture("en-US")).cast("double").alias("en"), R.decimal(F.col("english"), culture("de-DE")).isNotNull().alias("english_read_in_german"))


CUSTOMERS = S.Schema(
    (
        S.Field("c_custkey", "Integer").require().with_rules(S.min_value(1)).must_be_unique(),
        S.Field("c_name").require().with_rules(S.min_length(5), S.max_length(18), S.pattern("Customer#[0-9]{9}")),
        S.Field("c_acctbal", "Decimal").with_rules(S.min_value(0), S.max_value(9000)),
        S.Field("c_mktsegment").with_rules(S.allowed_values(["building", "MACHINERY", "AUTOMOBILE"], ignore_case=True), S.exact_length(10)),
    )
)


def _customers(spark, sf):
    c = _t(spark, sf, "customer")
    text = c.select(F.col("c_custkey").alias("row_number"), F.col("c_custkey").cast("string"), "c_name", F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(R.canonical_number(F.col("c_acctbal").cast("decimal(18,2)"))).alias("c_acctbal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    plan = by_header([x for x in text.columns if x != "row_number"], CUSTOMERS)
    return compile_plan(text, plan, CUSTOMERS)


def extract_accept(spark, sf):
    return _customers(spark, sf).accepted().select("row_number", "c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


def extract_reject(spark, sf):
    return _customers(spark, sf).rejected().select("row_number", "field_name", "code", "raw_value")


_CUSTOMER_SQL = "WITH c AS (SELECT c_custkey AS k, c_name AS n, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal::DECIMAL(18,2), 2) END AS b, c_custkey % 7 = 0 AS bad, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS s FROM customer), e AS (SELECT k, 'c_name' AS f, 'value.min-length' AS code, n AS raw FROM c WHERE length(n) < 5 UNION ALL SELECT k, 'c_name', 'value.max-length', n FROM c WHERE length(n) > 18 UNION ALL SELECT k, 'c_name', 'value.pattern', n FROM c WHERE NOT regexp_full_match(n, 'Customer#[0-9]{9}') UNION ALL SELECT k, 'c_custkey', 'value.out-of-range', k::VARCHAR FROM c WHERE k < 1 UNION ALL SELECT k, 'c_acctbal', 'value.type-mismatch', 'n/a' FROM c WHERE bad UNION ALL SELECT k, 'c_acctbal', 'value.out-of-range', CASE WHEN b::VARCHAR LIKE '%.00' THEN left(b::VARCHAR, length(b::VARCHAR) - 3) ELSE rtrim(b::VARCHAR, '0') END FROM c WHERE b < 0 OR b > 9000 UNION ALL SELECT k, 'c_mktsegment', 'value.not-allowed', s FROM c WHERE upper(s) NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') UNION ALL SELECT k, 'c_mktsegment', 'value.exact-length', s FROM c WHERE length(s) <> 10) "


def review_summary(spark, sf):
    return _customers(spark, sf).summary()


def coverage(spark, sf):
    return _customers(spark, sf).coverage().select("field", "filled", "empty", F.col("share").cast("double").alias("share"))


def error_limit(spark, sf):
    """Rows read until the tenth row has failed."""
    return _customers(spark, sf).until_errors(10).select("row_number")


def allowed_values_large(spark, sf):
    """Values that aren't in a set too large for a list: an anti join."""
    parts = _t(spark, sf, "part").where(F.col("p_partkey") % 3 != 0).select("p_partkey")
    return not_in(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey", parts)


LADDER = S.Schema(
    (S.Field("s_suppkey", "Integer"), S.Field("phone"), S.Field("mail").with_rules(S.pattern("[^@]+@.+")), S.Field("street"), S.Field("city")),
    (S.Alternatives("contact", (S.all_of("mail", "mail"), S.ladder("post", S.Level("street", ("street",)), S.Level("city", ("city",)), required=2), S.ladder("call", S.Level("phone", ("phone",)))), unresolved_row_fails=False),),
)


def _ladders(spark, sf):
    k = F.col("s_suppkey")
    s = _t(spark, sf, "supplier").select(k.alias("row_number"), k.cast("string").alias("s_suppkey"), F.when(k % 2 == 0, F.lit("123")).alias("phone"), F.when(k % 3 == 0, F.lit("a@b")).when(k % 5 == 0, F.lit("none")).alias("mail"), F.when(k % 7 < 4, F.lit("Road 1")).alias("street"), F.when(k % 4 == 1, F.lit("Ulm")).alias("city"))
    return compile_plan(s, by_header([c for c in s.columns if c != "row_number"], LADDER), LADDER)


def alternatives_report(spark, sf):
    r = _ladders(spark, sf).alternatives_report("contact")
    return r.select("rows_judged", "unresolved", "group", "rows_needing", "won", F.array_join(F.transform("rows_at_level", lambda x: x.cast("string")), ",").alias("rows_at_level"), "empty", "incomplete", "ignored_invalid_values")


ALTERNATIVES_SQL = """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS phone, s_suppkey % 3 = 0 AS mail, s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0 AS badmail, s_suppkey % 7 < 4 AS street, s_suppkey % 4 = 1 AS city FROM supplier WHERE NOT (s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0)),
g AS (SELECT *, NOT mail AS n1, NOT mail AND NOT (street AND city) AS n2 FROM s)
SELECT count(*) AS rows_judged, count(*) FILTER (WHERE n2 AND NOT phone) AS unresolved, 'mail' AS "group", count(*) AS rows_needing, count(*) FILTER (WHERE mail) AS won, count(*) FILTER (WHERE NOT mail) || ',' || count(*) FILTER (WHERE mail) AS rows_at_level, count(*) FILTER (WHERE NOT mail) AS empty, count(*) FILTER (WHERE NOT mail) AS incomplete, 0::BIGINT AS ignored_invalid_values FROM g
UNION ALL SELECT count(*), count(*) FILTER (WHERE n2 AND NOT phone), 'post', count(*) FILTER (WHERE n1), count(*) FILTER (WHERE n1 AND street AND city), count(*) FILTER (WHERE n1 AND NOT street) || ',' || count(*) FILTER (WHERE n1 AND street AND NOT city) || ',' || count(*) FILTER (WHERE n1 AND street AND city), count(*) FILTER (WHERE n1 AND NOT street AND NOT city), count(*) FILTER (WHERE n1 AND NOT (street AND city)), 0 FROM g
UNION ALL SELECT count(*), count(*) FILTER (WHERE n2 AND NOT phone), 'call', count(*) FILTER (WHERE n2), count(*) FILTER (WHERE n2 AND phone), count(*) FILTER (WHERE n2 AND NOT phone) || ',' || count(*) FILTER (WHERE n2 AND phone), count(*) FILTER (WHERE n2 AND NOT phone), count(*) FILTER (WHERE n2 AND NOT phone), 0 FROM g"""


def checksums(spark, sf):
    """Luhn and mod 97 over codes made of order keys."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("code"))
    return o.select("o_orderkey", R.luhn(F.col("code")).alias("luhn"), R.mod97(F.col("code")).alias("mod97"))


CHECKSUM_SQL = """
WITH o AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') AS code FROM orders), d AS (SELECT o_orderkey, i, substr(code, i::INT, 1)::INT AS x FROM o, range(1, 11) r(i))
SELECT o_orderkey, sum(CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * x > 9 THEN 2 * x - 9 ELSE 2 * x END ELSE x END) % 10 = 0 AS luhn, o_orderkey % 97 = 1 AS mod97 FROM d GROUP BY o_orderkey"""


def excel_serial(spark, sf):
    """Ship dates as serial numbers and back."""
    d = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp_ntz").alias("d")).withColumn("serial", R.to_serial(F.col("d")))
    return d.select("l_orderkey", "l_linenumber", "serial", F.date_format(R.from_serial(F.col("serial")), "yyyy-MM-dd").alias("back"))


def csv_roundtrip(spark, sf):
    """Documents written as csv lines and read back, record by record, however many line breaks they have."""
    docs = _t(spark, sf, "documents").select("doc_id", "lang", "text")
    text = lines(docs, "doc_id", CsvOptions(delimiter=";"))
    dialect = Dialect("utf-8", ";")

    def back(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for v in b.column(1).to_pylist():
                (row,) = records(v, dialect, max_lines=len(v))  # one record, or it fails
                rows.append(row)
            yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "lang", "text"])

    out = text.mapInArrow(back, "doc_id long, lang string, text string")
    return out.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def header_match(spark, sf):
    headers = ["CUST KEY", "c-name", "C.AcctBal", "", "segment"]
    schema = S.Schema((S.Field("custkey", "Integer"), S.Field("c_name"), S.Field("c_acctbal", "Decimal"), S.Field("Segment")))
    return spark.createDataFrame([(b.column, b.header, b.field) for b in by_header(headers, schema).bindings], "column_index long, header string, field_name string")


def hypotheses(spark, sf):
    """Ranked types of the text columns of rendered orders."""
    p = P.analyze(_rendered_orders(spark, sf).drop("o_orderkey").withColumnRenamed("day", "signed"), F.monotonically_increasing_id())
    rows = [(c.header, i + 1, h.type, h.culture or "", float(h.confidence)) for c in p.columns for i, h in enumerate(c.hypotheses)]
    return spark.createDataFrame(rows, "column_name string, place long, type string, culture string, confidence double")


def number_outliers(spark, sf):
    """The first values that don't read as numbers."""
    c = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.col("c_custkey").cast("string")).alias("v"))
    return P.outliers(P.cells(c, "c_custkey", ["v"]), "", 20).select("place", "row_number", F.col("text").alias("value"))


def distinct_names(spark, sf):
    """Normalised names."""
    return _t(spark, sf, "nation").select("n_nationkey", R.normalized_name(F.col("n_name")).alias("name"))


def formula_guard(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", R.guarded(R.canonical_number(F.col("c_acctbal").cast("decimal(18,2)"))).alias("guarded"))


QUERIES = {f.__name__: f for f in (profile_counts, profile_lengths, profile_number_range, top_values, first_samples, value_tally, rows_with_value_in, parse_counts, disagree_dates, grouped_numbers, extract_accept, extract_reject, review_summary, coverage, error_limit, allowed_values_large, alternatives_report, checksums, excel_serial, csv_roundtrip, header_match, hypotheses, number_outliers, distinct_names, formula_guard)}

SQL = {
    "profile_counts": " UNION ALL ".join(_counts_sql(t, c) for t, c in COLUMNS.items()),
    "profile_lengths": " UNION ALL ".join(f"SELECT '{c}' AS column_name, min(length({e}))::INTEGER AS min_length, max(length({e}))::INTEGER AS max_length FROM documents WHERE {e} <> ''" for c in ("doc_id", "lang", "source", "n_chars", "text") for e in [f"regexp_replace(regexp_replace({c}::VARCHAR, '^\\s+', ''), '\\s+$', '')"]),
    "profile_number_range": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS numbers, min({c})::DOUBLE AS min_number, max({c})::DOUBLE AS max_number FROM {t}" for t, cs in COLUMNS.items() if t in ("orders", "lineitem") for c in cs if c.endswith(("key", "number", "price", "quantity", "discount", "tax"))),
    "top_values": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY count(*) DESC, {_shown(c)})::INTEGER AS place, {_shown(c)} AS value, count(*) AS n FROM orders GROUP BY {_shown(c)}) WHERE place <= 20" for c in COLUMNS["orders"]),
    "first_samples": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY c_custkey)::INTEGER AS place, c_custkey::BIGINT AS row_number, {_shown(c)} AS value FROM customer) WHERE place <= 10" for c in COLUMNS["customer"]),
    "value_tally": " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY min(c_custkey))::INTEGER AS place, {_shown(c)} AS value, count(*) AS n FROM customer GROUP BY {_shown(c)}) WHERE (SELECT count(DISTINCT {c}) FROM customer) <= 100" for c in COLUMNS["customer"]),
    "rows_with_value_in": "SELECT count(*) AS rows FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "parse_counts": PARSE_SQL,
    "disagree_dates": "SELECT count(*) FILTER (WHERE day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS rows_read_differently, count(*) FILTER (WHERE day(o_orderdate) > 12) AS only_day_first FROM orders",
    "grouped_numbers": "SELECT o_orderkey, round(o_totalprice * 100)::BIGINT / 100.0 AS de, round(o_totalprice * 100)::BIGINT / 100.0 AS en, false AS english_read_in_german FROM orders",
    "extract_accept": _CUSTOMER_SQL + "SELECT k AS row_number, k AS c_custkey, n AS c_name, b::DOUBLE AS c_acctbal, s AS c_mktsegment FROM c WHERE k NOT IN (SELECT k FROM e)",
    "extract_reject": _CUSTOMER_SQL + "SELECT k AS row_number, f AS field_name, code, raw AS raw_value FROM e",
    "review_summary": _CUSTOMER_SQL + "SELECT (SELECT count(*) FROM c) AS rows_read, (SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM e)) AS rows_produced, 0::BIGINT AS rows_skipped, 0::BIGINT AS rows_with_nothing_mapped, (SELECT count(DISTINCT k) FROM e) AS rows_failed, (SELECT count(*) FROM e) AS error_count, 0::BIGINT AS other_separator_decimals",
    "coverage": _CUSTOMER_SQL + ", g AS (SELECT * FROM c WHERE k NOT IN (SELECT k FROM e)) " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({x}) AS filled, count(*) - count({x}) AS empty, round_even(count({x}) / greatest(count(*), 1), 3)::DOUBLE AS share FROM g" for f, x in (("c_custkey", "k"), ("c_name", "n"), ("c_acctbal", "b"), ("c_mktsegment", "s"))),
    "error_limit": _CUSTOMER_SQL + "SELECT k AS row_number FROM c WHERE k <= (SELECT max(k) FROM (SELECT DISTINCT k FROM e ORDER BY k LIMIT 10)) OR (SELECT count(DISTINCT k) FROM e) < 10",
    "allowed_values_large": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)",
    "alternatives_report": ALTERNATIVES_SQL,
    "checksums": CHECKSUM_SQL,
    "excel_serial": "SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1899-12-30', l_shipdate::DATE)::DOUBLE AS serial, strftime(l_shipdate, '%Y-%m-%d') AS back FROM lineitem",
    "csv_roundtrip": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "hypotheses": "SELECT c AS column_name, p::BIGINT AS place, t AS type, k AS culture, 1.0::DOUBLE AS confidence FROM (VALUES ('signed', 1, 'Date', 'de-DE'), ('signed', 2, 'Text', ''), ('english', 1, 'Decimal', ''), ('english', 2, 'Decimal', 'en-US'), ('english', 3, 'Text', ''), ('german', 1, 'Decimal', 'de-DE'), ('german', 2, 'Text', ''), ('plain', 1, 'Decimal', 'de-DE'), ('plain', 2, 'Text', '')) x(c, p, t, k)",
    "header_match": "SELECT i::BIGINT AS column_index, h AS header, f AS field_name FROM (VALUES (0, 'CUST KEY', 'custkey'), (1, 'c-name', 'c_name'), (2, 'C.AcctBal', 'c_acctbal'), (4, 'segment', 'Segment')) x(i, h, f)",
    "number_outliers": "SELECT row_number() OVER (ORDER BY c_custkey)::INTEGER AS place, c_custkey::BIGINT AS row_number, 'none' AS value FROM customer WHERE c_custkey % 5 = 0 ORDER BY c_custkey LIMIT 20",
    "distinct_names": "SELECT n_nationkey, lower(regexp_replace(n_name, '[\\s_.-]', '', 'g')) AS name FROM nation",
    "formula_guard": "WITH c AS (SELECT c_custkey, c_acctbal::DECIMAL(18,2)::VARCHAR AS v FROM customer), t AS (SELECT c_custkey, CASE WHEN v LIKE '%.00' THEN left(v, length(v) - 3) ELSE rtrim(v, '0') END AS v FROM c) SELECT c_custkey, CASE WHEN v LIKE '-%' THEN '''' || v ELSE v END AS guarded FROM t",
}
del W

from . import queries_files  # noqa: E402

QUERIES |= queries_files.QUERIES
SQL |= queries_files.SQL

from . import queries_plans  # noqa: E402

QUERIES |= queries_plans.QUERIES
SQL |= queries_plans.SQL
