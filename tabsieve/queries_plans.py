"""Registered queries of readings, mapping, precheck and checked extraction, and their DuckDB SQL over the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, PlanError
from .functions import readings as R
from .functions.cultures import culture
from .operators import profile as P
from .operators.extract import compile_plan, translations
from .plans import mapping as M
from .plans import schema as S
from .plans.precheck import precheck
from .sources.workbooks import from_duration
from .streaming.extract import extract_stream


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(rows: list[tuple]) -> str:
    """DuckDB rows of texts and whole numbers."""
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


# Readings


def number_spellings(spark, sf):
    """Prices spelled in many ways, and what the spelling's culture reads."""
    o, cents = _t(spark, sf, "orders"), F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part = F.floor(cents / 100).cast("long"), F.lpad((cents % 100).cast("string"), 2, "0")
    grouped = lambda g: F.replace(F.format_number(whole, 0), F.lit(","), F.lit(g))
    k = F.col("o_orderkey") % 8
    spelled = {
        "de-CH": F.concat(grouped("’"), F.lit("."), part),
        "fr-FR": F.concat(grouped(" "), F.lit(","), part),
        "sv-SE": F.concat(grouped(" "), F.lit(","), part, F.lit("-")),
        "en-US": F.concat(F.lit("+"), whole.cast("string"), F.lit("."), part, F.lit("e1")),
        "pt-BR": F.concat(F.lit("  "), grouped("."), F.lit(","), part, F.lit(" ")),
        "it-IT": F.concat(whole.cast("string"), F.lit("."), part),
        "en-GB": F.concat(grouped("."), F.lit(","), part),
        "": F.concat(F.lit("EUR "), whole.cast("string")),
    }
    text, value, other, name = F.lit(""), F.lit(None).cast(R.WHOLE), F.lit(None).cast(R.WHOLE), F.lit("")
    for i, (n, x) in enumerate(spelled.items()):
        text, name = F.when(k == i, x).otherwise(text), F.when(k == i, F.lit(n)).otherwise(name)
        value, other = F.when(k == i, R.decimal(F.col("text"), culture(n))).otherwise(value), F.when(k == i, R.other_separator(F.col("text"), culture(n))).otherwise(other)
    return o.select("o_orderkey", name.alias("culture"), text.alias("text")).select("o_orderkey", "culture", value.cast("double").alias("value"), other.cast("double").alias("with_other_separator"))


NUMBER_SPELLINGS_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'de-CH' WHEN 1 THEN 'fr-FR' WHEN 2 THEN 'sv-SE' WHEN 3 THEN 'en-US' WHEN 4 THEN 'pt-BR' WHEN 5 THEN 'it-IT' WHEN 6 THEN 'en-GB' ELSE '' END AS culture,
  CASE WHEN k IN (0, 1, 4) THEN c / 100.0 WHEN k = 2 THEN -c / 100.0 WHEN k = 3 THEN c / 10.0 END::DOUBLE AS value, CASE WHEN k = 5 THEN c / 100.0 END::DOUBLE AS with_other_separator FROM o"""


def date_spellings(spark, sf):
    """Order dates spelled in many ways, and what the spelling's culture reads; what names no whole date is none."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 10
    months = lambda n: F.element_at(F.array(*[F.lit(m) for m in culture(n).months]), F.month(d))
    forms = [
        ("de-DE", F.concat(F.day(d).cast("string"), F.lit(". "), months("de-DE"), F.lit(" "), F.year(d).cast("string"))),
        ("en-US", F.concat(F.initcap(months("en-US")), F.lit(" "), F.day(d).cast("string"), F.lit(", "), F.year(d).cast("string"))),
        ("pl-PL", F.concat(F.day(d).cast("string"), F.lit(" "), months("pl-PL"), F.lit(" "), F.year(d).cast("string"))),
        ("", F.date_format(d, "MM/dd/yyyy 'at'")),
        ("", F.date_format(d, "MM/dd/yyyy hh:mm a")),
        ("de-DE", F.date_format(d, "dd.MM.yy")),
        ("fr-FR", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("en-US", F.date_format(d, "M/d")),
        ("de-DE", F.date_format(d, "HH:mm")),
        ("ja-JP", F.date_format(d, "yyyy/MM/dd")),
    ]
    text, day = F.lit(""), F.lit(None).cast("timestamp_ntz")
    for i, (n, x) in enumerate(forms):
        text, day = F.when(k == i, x).otherwise(text), F.when(k == i, R.date(F.col("text"), culture(n))).otherwise(day)
    return _t(spark, sf, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


def serial_dates(spark, sf):
    """Serial numbers as dates in both systems: day 60 of the 1900 system is none, fractions are times."""
    n = F.col("p_partkey")
    p = _t(spark, sf, "part").select("p_partkey", n.cast("double").alias("n"), (n + 0.75).alias("later"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return p.select("p_partkey", show(R.from_serial(F.col("n"))).alias("d1900"), show(R.from_serial(F.col("later"), True)).alias("d1904"))


def checksum_letters(spark, sf):
    """Luhn over securities numbers and mod 97 over identifiers that are built to pass for even keys."""
    k = F.col("c_custkey")
    body = F.concat(F.lit("ZA"), F.lpad(k.cast("string"), 8, "0"), F.lit("Q"))
    digits = R.expanded(F.concat(body, F.lit("0")))
    sums = F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int"))), F.lit(0), lambda s, x: s + x)
    check = F.pmod(F.lit(10) - sums % 10, F.lit(10))
    c = _t(spark, sf, "customer").select("c_custkey", F.concat(body, F.pmod(check + k % 2, F.lit(10)).cast("int").cast("string")).alias("code"), F.when(k % 3 == 0, F.lower(body)).otherwise(F.lit("WEST12345698765432GB82")).alias("other"))
    return c.select("c_custkey", R.luhn(F.col("code")).alias("luhn"), R.mod97(F.col("other")).alias("mod97"))


def booleans_read(spark, sf):
    """true and false in any case, and nothing else, are booleans."""
    k = F.col("c_custkey") % 6
    t = F.element_at(F.array(*[F.lit(x) for x in ("true", "FALSE", " True ", "yes", "1", "f")]), (k + 1).cast("int"))
    return _t(spark, sf, "customer").select("c_custkey", R.boolean(t).alias("value"))


def durations(spark, sf):
    """Durations of a spreadsheet as dates, by customer."""
    rows = [(i, t, d and d.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(("PT1H2M3S", "P1DT1H", "PT90M", "P0D", "-PT1H", "PT", "PT25H")) for d in (from_duration(t),)]
    return _t(spark, sf, "customer").join(F.broadcast(spark.createDataFrame(rows, "i int, duration string, at string")), F.col("c_custkey") % 7 == F.col("i")).select("c_custkey", "duration", "at")


# Profile


def profile_kinds(spark, sf):
    """Native kinds of events, and how their JSON text reads."""
    e = _t(spark, sf, "events")
    f = P.column_facts(P.tally(P.cells(e, "event_id")), e.count(), ("",))
    return f.select(F.col("name").alias("column_name"), "kind_text", "kind_number", "kind_date", "kind_boolean", F.col("integers_0").alias("integers"), F.col("decimals_0").alias("decimals"), F.col("dates_0").alias("dates"), F.col("distinct").alias("distinct_count"))


PROFILE_KINDS_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {'count(*)' if kind == 'text' else '0::BIGINT'} AS kind_text, {'count(*)' if kind == 'number' else '0::BIGINT'} AS kind_number, {'count(*)' if kind == 'date' else '0::BIGINT'} AS kind_date, 0::BIGINT AS kind_boolean, {f'count(*) FILTER (WHERE {c} = floor({c}))' if kind == 'number' else '0::BIGINT'} AS integers, {f'count(*) FILTER (WHERE {c} <> floor({c}))' if kind == 'number' else '0::BIGINT'} AS decimals, {'count(*)' if kind == 'date' else '0::BIGINT'} AS dates, count(DISTINCT {d}) AS distinct_count FROM events"
    for c, kind, d in (("event_id", "number", "event_id"), ("ts", "date", "date_trunc('second', ts)"), ("user_id", "number", "user_id"), ("event_type", "text", "event_type"), ("value", "number", "value"), ("props", "text", "props"))
)


def _days(spark, sf):
    """Order dates by day, month, year; prices with a comma; some cells are neither."""
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    day = F.when(k % 97 == 0, F.lit("unknown")).when(k % 5 != 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
    price = F.when(k % 89 == 0, F.lit("n/a")).otherwise(F.replace(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return o.select("o_orderkey", day.alias("day"), price.alias("price"))


def readings_disagree(spark, sf):
    """Rows that cultures read differently, by the profile; the empties, and each culture's first date outlier."""
    df = _days(spark, sf)
    values = P.cells(df, "o_orderkey")
    f = P.column_facts(P.tally(values), df.count(), ("de-DE", "en-US")).where("name = 'day'")
    first = P.all_outliers(values.where("name = 'day'"), ("de-DE",), 1).where("dates").select("row_number")
    return f.select("empty", F.col("dates_0").alias("dates_de"), F.col("dates_1").alias("dates_en"), F.col("dates_differ_0_1").alias("rows_read_differently"), F.date_format("min_date_0", "yyyy-MM-dd").alias("first_day")).crossJoin(first)


READINGS_DISAGREE_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders), r AS (SELECT * FROM o WHERE k % 97 <> 0 AND k % 5 <> 0)
SELECT (SELECT count(*) FROM o WHERE k % 97 <> 0 AND k % 5 = 0) AS empty, count(*) AS dates_de, count(*) FILTER (WHERE day(d) <= 12) AS dates_en, count(*) FILTER (WHERE day(d) > 12 OR day(d) <> month(d)) AS rows_read_differently, strftime(min(d), '%Y-%m-%d') AS first_day, (SELECT min(k) FROM o WHERE k % 97 = 0)::BIGINT AS row_number FROM r"""


def sheet_profile(spark, sf):
    """The sheet's decimal separator by vote, and each column's ranked hypotheses."""
    p = P.analyze(_days(spark, sf), "o_orderkey", P.AnalysisOptions(cultures=("", "de-DE")))
    rows = [(c.header, i + 1, h.type, h.culture or "", h.matched, h.unmatched, len(h.outliers), p.preferred_separator) for c in p.columns if c.header != "o_orderkey" for i, h in enumerate(c.hypotheses)]
    return spark.createDataFrame(rows, "column_name string, place long, type string, culture string, matched long, unmatched long, outliers long, separator string")


SHEET_PROFILE_SQL = """
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, round(o_totalprice, 2) AS p FROM orders), b AS (SELECT count(*) FILTER (WHERE k % 97 = 0) AS bad, count(*) FILTER (WHERE k % 97 = 0 OR k % 5 <> 0) AS n FROM o), c AS (SELECT count(*) FILTER (WHERE k % 89 = 0) AS bad, count(*) AS n FROM o)
SELECT 'day' AS column_name, 1::BIGINT AS place, 'Date' AS type, 'de-DE' AS culture, n - bad AS matched, bad AS unmatched, least(bad, 20) AS outliers, ',' AS separator FROM b
UNION ALL SELECT 'day', 2, 'Text', '', n, 0, 0, ',' FROM b
UNION ALL SELECT 'price', 1, 'Decimal', 'de-DE', n - bad, bad, least(bad, 20), ',' FROM c
UNION ALL SELECT 'price', 2, 'Text', '', n, 0, 0, ',' FROM c"""


# Mapping and precheck


def plan_faults(spark, sf):
    """Everything that is wrong with a plan, and with the file that it meets."""
    schema = S.Schema((S.Field("id", "Integer").require(), S.Field("price", "Decimal").with_rules(S.min_length(2)), *S.translated("title", ["en", "de"], required=True)))
    plan = M.Plan((M.Binding(0, "a", "nothing"), M.Binding(1, "b", "price"), M.Binding(1, "b", "price"), M.Binding(-1, "x", "price")), "xx-XX", sheet=-1, header_row=-2)
    rows = [("plan", *f) for f in M.faults(plan, schema, 2)]
    good = M.Plan((M.Binding(0, "Id", "id"), M.Binding(1, "title_en", "title.en")), sheet_name="orders")
    for name, sheets, headers in (("none", [], None), ("renamed", [("other", None)], ["id", "title_en"]), ("no header", [("orders", None)], None), ("moved", [("orders", None)], ["title_en", "id"]), ("fits", [("orders", None)], [" ID", "Title EN"])):
        try:
            M.check_structure(good, sheets, headers)
        except EngineError as e:
            rows.append((name, e.code, ""))
    for name, make in (("duplicate", lambda: S.Schema((S.Field("a"), S.Field("a")))), ("type", lambda: S.Field("a", "Blob")), ("member", lambda: S.Schema((S.Field("a").require(),), (S.Alternatives("x", (S.all_of("g", "a"),)),))), ("reserved", lambda: S.must("value.mine", lambda v: v)), ("pattern", lambda: S.pattern("(a)\\1")), ("variants", lambda: S.translated("t", ["en", "EN"]))):
        try:
            make()
        except ValueError:
            rows.append((name, "refused", ""))
    try:
        M.validate(M.Plan(()), schema)
    except PlanError as e:
        rows.append(("raised", e.code, str(len(e.faults))))
    return spark.createDataFrame(rows, "subject string, code string, what string")


PLAN_FAULTS = [
    ("plan", "mapping.unknown-field", "nothing"),
    ("plan", "mapping.invalid-column", "-1"),
    ("plan", "mapping.duplicate-binding", "price"),
    ("plan", "mapping.duplicate-binding", "1"),
    ("plan", "mapping.required-field-unmapped", "id"),
    ("plan", "mapping.constraint-type-mismatch", "price: value.min-length"),
    ("plan", "mapping.required-group-unmapped", "title"),
    ("plan", "mapping.invalid-header-row", "-2"),
    ("plan", "mapping.invalid-sheet", "-1"),
    ("plan", "mapping.unknown-culture", "xx-XX"),
    ("none", "structure.sheet-missing", ""),
    ("renamed", "structure.sheet-changed", ""),
    ("no header", "structure.header-row-missing", ""),
    ("moved", "structure.header-changed", ""),
    *((x, "refused", "") for x in ("duplicate", "type", "member", "reserved", "pattern", "variants")),
    ("raised", "mapping.required-field-unmapped", "3"),
]


def header_variants(spark, sf):
    """Translated fields found by every spelling of a variant."""
    schema = S.Schema(tuple(S.translated("title", ["en", "de", "fr", "it", "es", "nl", "pl", "hu"])))
    plan = M.by_header(["Title#en", "title_DE", "title-fr", "title.it", "title es", "title@nl", "title (pl)", "title[hu]", "title#xx"], schema)
    mine = M.by_header(["A", "B"], S.Schema((S.Field("x"), S.Field("y"))), matcher=lambda h, f: {"A": "y", "B": "x"}[h] == f.name)
    back = M.Plan.from_json(plan.to_json())
    return spark.createDataFrame([(b.column, b.field) for b in (*back.bindings, *(replace(b, column=b.column + 100) for b in mine.bindings))], "column_index long, field_name string")


CHECKED = S.Schema(
    (
        S.Field("key", "Integer").require().must_be_unique(),
        S.Field("price", "Decimal").with_rules(S.max_value(100_000)),
        S.Field("day", "Date").require(),
        S.Field("status").require().with_rules(S.allowed_values(["F", "O"])),
        S.Field("clerk"),
        S.Field("flag", "Boolean"),
        S.Field("lat", "Decimal"),
        S.Field("town"),
        *S.translated("title", ["en", "de"], required=True),
    ),
    (S.Alternatives("place", (S.all_of("point", "lat"), S.all_of("address", "town", "clerk"))),),
)


def _checked(spark, sf):
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    price = F.when(k % 89 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select("o_orderkey", F.when(k % 50 == 1, k - 1).otherwise(k).cast("string").alias("key"), price.alias("price"), F.when(k % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 4 == 0, F.lit("-")).otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("flag"), F.lit(None).cast("string").alias("title_en"), F.lit(None).cast("string").alias("title_de"))


def precheck_findings(spark, sf):
    """What the profile says of an import, before any row is converted: severity, rows, bound, reason."""
    df = _checked(spark, sf)
    p = P.analyze(df.drop("o_orderkey"), F.monotonically_increasing_id(), P.AnalysisOptions(cultures=("",)))
    plan = M.by_header([c for c in df.columns if c != "o_orderkey"], CHECKED, "")
    plan = replace(plan, bindings=tuple(replace(b, treat_as_empty=("-",)) if b.field == "status" else b for b in plan.bindings))
    found = [("file", f) for f in precheck(spark, plan, CHECKED, p).findings]
    found += [("sheet", f) for f in precheck(spark, replace(plan, sheet=3), CHECKED, p).findings]
    found += [("stale", f) for f in precheck(spark, replace(plan, header_row=2), CHECKED, p).findings]
    found += [("culture", f) for f in precheck(spark, replace(plan, culture="xx-XX"), CHECKED, p).findings]
    rows = [(of, f.severity, f.code, f.field, f.rows, f.bound, f.arguments.get("reason"), ",".join(f.examples)) for of, f in found]
    return spark.createDataFrame(rows, "subject string, severity string, code string, field_name string, rows long, bound string, reason string, examples string")


PRECHECK_SQL = """
WITH o AS (SELECT o_orderkey AS k, round(o_totalprice, 2) AS p, CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE o_orderstatus END AS s FROM orders), c AS (SELECT count(*) AS n FROM o)
SELECT 'file' AS subject, 'Blocking' AS severity, 'value.type-mismatch' AS code, 'flag' AS field_name, n AS rows, 'Exact' AS bound, 'no-row-can-satisfy' AS reason, '' AS examples FROM c
UNION ALL SELECT 'file', 'Blocking', 'group.required', 'title', n, 'Exact', NULL, '' FROM c
UNION ALL SELECT 'file', 'Blocking', 'group.unresolved', 'place', n, 'Exact', NULL, '' FROM c
UNION ALL SELECT 'file', 'Undetermined', 'group.level-unmapped', g, NULL, 'Exact', NULL, '' FROM (VALUES ('point'), ('address')) x(g)
UNION ALL SELECT 'file', 'Blocking', 'value.not-unique', 'key', (SELECT count(*) FROM o WHERE k % 50 = 1), 'Exact', 'repeats', ''
UNION ALL SELECT 'file', 'Warning', 'value.required', 'day', (SELECT count(*) FROM o WHERE k % 5 = 0), 'Exact', 'empty-cells', ''
UNION ALL SELECT 'file', 'Warning', 'value.type-mismatch', 'price', (SELECT count(*) FROM o WHERE k % 89 = 0), 'Exact', 'values-fail', ''
UNION ALL SELECT 'file', CASE WHEN d <= 1000 THEN 'Warning' ELSE 'Undetermined' END, 'value.out-of-range', 'price', CASE WHEN d <= 1000 THEN bad END, 'Exact', CASE WHEN d <= 1000 THEN 'values-fail' ELSE 'too-many-distinct' END, CASE WHEN d <= 1000 THEN ex ELSE '' END FROM (SELECT count(DISTINCT CASE WHEN k % 89 = 0 THEN 'n/a' ELSE p::VARCHAR END) AS d, count(*) FILTER (WHERE k % 89 <> 0 AND p > 100000) AS bad, '' AS ex FROM o) WHERE d > 1000 OR bad > 0
UNION ALL SELECT 'file', 'Warning', 'value.not-allowed', 'status', n, 'Exact', 'values-fail', ex FROM (SELECT count(*) AS n, string_agg(DISTINCT s, ',' ORDER BY s) AS ex FROM o WHERE s NOT IN ('F', 'O', '-')) WHERE n > 0
UNION ALL SELECT s, v, c, NULL, NULL, 'Exact', NULL, '' FROM (VALUES ('sheet', 'Blocking', 'mapping.invalid-sheet'), ('stale', 'Undetermined', 'mapping.stale-profile'), ('culture', 'Blocking', 'mapping.unknown-culture')) x(s, v, c)"""


# Checked extraction

LINES = S.Schema(
    (S.Field("key", "Integer").require(), S.Field("price", "Decimal").with_rules(S.must("rule.whole-cents", lambda v: v * 100 == F.floor(v * 100))), S.Field("flag").require().with_rules(S.exact_length(1)), S.Field("phone"), S.Field("mail"), *S.translated("title", ["en", "de"], required=True)),
    (S.Alternatives("contact", (S.all_of("mail", "mail"), S.ladder("call", S.Level("phone", ("phone",))))),),
)


def _lines(spark, sf):
    """Orders as text cells: blank rows, rows without any mapped value, spelled nothings, the other decimal separator."""
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    blank = k % 10 == 0
    put = lambda c: F.when(~blank, c)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    price = F.when(k % 3 == 0, F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))).when(k % 3 == 1, F.concat((cents / 100).cast("long").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit("5"))).otherwise(F.lit(" N/A "))
    cells = F.array(put(k.cast("string")), put(price), put(F.when(k % 7 == 0, F.lit("  ")).otherwise(F.lit("x"))), put(F.when(k % 2 == 0, F.lit("123"))), put(F.when(k % 5 == 1, F.lit("a@b"))), put(F.when(k % 4 < 2, F.lit("Title"))), put(F.when(k % 4 == 2, F.lit("Titel"))), F.when(k % 20 == 0, F.lit("note")))
    return o.select(k.alias("row_number"), cells.alias("cells"))


def _imported(spark, sf):
    plan = M.by_header(["key", "price", "flag", "phone", "mail", "title_en", "title_de", "unmapped"], LINES, "de-DE")
    plan = replace(plan, bindings=tuple(replace(b, treat_as_empty=("n/a",), accept_other_separator=True) if b.field == "price" else b for b in plan.bindings))
    return compile_plan(_lines(spark, sf), plan, LINES, cells="cells")


_LINES_SQL = """
WITH o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c FROM orders), l AS (SELECT * FROM o WHERE k % 10 <> 0),
e AS (SELECT k, 1 AS p, 'price' AS f, 'rule.whole-cents' AS code FROM l WHERE k % 3 = 1 UNION ALL SELECT k, 2, 'flag', 'value.required' FROM l WHERE k % 7 = 0 UNION ALL SELECT k, 3, 'title', 'group.required' FROM l WHERE k % 4 = 3 UNION ALL SELECT k, 4, 'contact', 'group.unresolved' FROM l WHERE k % 2 = 1 AND k % 5 <> 1),
g AS (SELECT * FROM l WHERE k NOT IN (SELECT k FROM e)) """


def import_summary(spark, sf):
    return _imported(spark, sf).summary()


def import_errors(spark, sf):
    return _imported(spark, sf).rejected().select("row_number", "field_name", "code")


def import_rows(spark, sf):
    """Accepted rows with the alternative that located them, and the present translations."""
    x = _imported(spark, sf).accepted()
    r = F.col("contact_resolution")
    return translations(x, LINES, "title").select("row_number", F.col("price").cast("double").alias("price"), r["group"].alias("group_name"), r["level"].alias("level"), r["level_name"].alias("level_name"), F.array_join(F.transform(F.map_keys("title"), lambda v: F.concat(v, F.lit("="), F.element_at("title", v))), ",").alias("titles"))


def import_rows_mapped(spark, sf):
    """Accepted rows through a caller's mapper, on the executors."""
    return _imported(spark, sf).mapped(lambda r: (r["key"], f"{r['flag']}{r['phone'] or '-'}"), "key long, made string")


def import_chunks(spark, sf):
    """Windows of 1000 read rows: first and last row, number of items and of errors."""
    rows = [(i, a, b, len(items), len(errors)) for i, (a, b, items, errors) in enumerate(_imported(spark, sf).chunks(1000))]
    return spark.createDataFrame(rows, "chunk long, first_row long, last_row long, items long, errors long")


def import_all_or_nothing(spark, sf):
    """What one failing row leaves of an import that is all or nothing, and of its chunks; and of one past its limit."""
    x = _imported(spark, sf)
    strict = replace(x, schema=replace(x.schema, policy="AllOrNothing", _by={}))
    try:
        x.read_all(10)
        past = 0
    except EngineError as e:
        past = e.code
    return spark.createDataFrame([(len(strict.read_all()), sum(len(items) for _, _, items, errors in strict.chunks(3) if errors), past)], "items long, items_of_failing_chunks long, past_limit string")


def import_preview(spark, sf):
    """The first twenty accepted rows as text."""
    p = _imported(spark, sf).preview(20)
    return p.select("row_number", F.col("values")["key"].alias("key"), F.col("values")["flag"].alias("flag"))


def review_report(spark, sf):
    """The first errors of a review, which never stops early."""
    summary, first = _imported(spark, sf).review(50)
    return spark.createDataFrame([(e["row_number"], e["field_name"], e["code"], summary["rows_failed"]) for e in first], "row_number long, field_name string, code string, rows_failed long")


def unresolved_rows(spark, sf):
    """Row numbers that a report names: incomplete groups and unresolved rows, the first fifty."""
    lenient = replace(LINES, alternatives=tuple(replace(a, unresolved_row_fails=False) for a in LINES.alternatives), _by={})
    x = _imported(spark, sf)
    r = compile_plan(_lines(spark, sf), x.plan, lenient, cells="cells").alternatives_report("contact").where("group = 'mail'")
    return r.select("rows_judged", "unresolved", F.explode("unresolved_rows").alias("row_number"))


UNRESOLVED_SQL = """
WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 4 <> 3), u AS (SELECT k FROM o WHERE k % 2 = 1 AND k % 5 <> 1)
SELECT (SELECT count(*) FROM o) AS rows_judged, (SELECT count(*) FROM u) AS unresolved, k AS row_number FROM (SELECT k FROM u ORDER BY k LIMIT 50)"""


def extract_of_stream(spark, sf):
    """The same extraction of a stream, run to its end."""
    import uuid

    from .scratch import new_path

    schema = S.Schema((S.Field("c_custkey", "Integer").require(), S.Field("c_acctbal", "Decimal").with_rules(S.min_value(0))))
    table = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/customer.parquet" if sf.startswith("file:") or "://" in sf else f"{sf}/customer.parquet*")
    x = extract_stream(stream.select(F.col("c_custkey").alias("row_number"), "*"), M.by_header(["c_custkey", "c_acctbal"], schema), schema)
    path, name = new_path(spark, "accepted"), uuid.uuid4().hex
    q = x.accepted().writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))


QUERIES = {f.__name__: f for f in (number_spellings, date_spellings, serial_dates, checksum_letters, booleans_read, durations, profile_kinds, readings_disagree, sheet_profile, plan_faults, header_variants, precheck_findings, import_summary, import_errors, import_rows, import_rows_mapped, import_chunks, import_all_or_nothing, import_preview, review_report, unresolved_rows, extract_of_stream)}

SQL = {
    "number_spellings": NUMBER_SPELLINGS_SQL,
    "date_spellings": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 NOT IN (3, 7, 8) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "serial_dates": "SELECT p_partkey, CASE WHEN p_partkey <> 60 THEN strftime(CASE WHEN p_partkey < 60 THEN DATE '1899-12-31' ELSE DATE '1899-12-30' END + p_partkey::INT, '%Y-%m-%d 00:00') END AS d1900, strftime(DATE '1904-01-01' + p_partkey::INT, '%Y-%m-%d 18:00') AS d1904 FROM part",
    "checksum_letters": "SELECT c_custkey, c_custkey % 2 = 0 AS luhn, c_custkey % 3 <> 0 AS mod97 FROM customer",
    "booleans_read": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS value FROM customer",
    "durations": f"SELECT c_custkey, d AS duration, a AS at FROM customer, (VALUES {_values([(0, 'PT1H2M3S', '1899-12-31 01:02:03'), (1, 'P1DT1H', '1899-12-31 01:00:00'), (2, 'PT90M', '1899-12-31 01:30:00'), (3, 'P0D', '1899-12-31 00:00:00'), (4, '-PT1H', None), (5, 'PT', None), (6, 'PT25H', '1899-12-31 01:00:00')])}) x(i, d, a) WHERE c_custkey % 7 = i",
    "profile_kinds": PROFILE_KINDS_SQL,
    "readings_disagree": READINGS_DISAGREE_SQL,
    "sheet_profile": SHEET_PROFILE_SQL,
    "plan_faults": f"SELECT * FROM (VALUES {_values(PLAN_FAULTS)}) x(subject, code, what)",
    "header_variants": f"SELECT i::BIGINT AS column_index, f AS field_name FROM (VALUES {_values([*((i, f'title.{v}') for i, v in enumerate(('en', 'de', 'fr', 'it', 'es', 'nl', 'pl', 'hu'))), (100, 'y'), (101, 'x')])}) x(i, f)",
    "precheck_findings": PRECHECK_SQL,
    "import_summary": _LINES_SQL + "SELECT (SELECT count(*) FROM o) AS rows_read, (SELECT count(*) FROM g) AS rows_produced, (SELECT count(*) FROM o WHERE k % 10 = 0) AS rows_skipped, (SELECT count(*) FROM o WHERE k % 20 = 0) AS rows_with_nothing_mapped, (SELECT count(DISTINCT k) FROM e) AS rows_failed, (SELECT count(*) FROM e) AS error_count, (SELECT count(*) FROM l WHERE k % 3 = 0) AS other_separator_decimals",
    "import_errors": _LINES_SQL + "SELECT k AS row_number, f AS field_name, code FROM e",
    "import_rows": _LINES_SQL + "SELECT k AS row_number, CASE WHEN k % 3 = 0 THEN c / 100.0 END::DOUBLE AS price, CASE WHEN k % 5 = 1 THEN 'mail' ELSE 'call' END AS group_name, 1::INTEGER AS level, CASE WHEN k % 5 = 1 THEN 'mail' ELSE 'phone' END AS level_name, CASE WHEN k % 4 < 2 THEN 'en=Title' ELSE 'de=Titel' END AS titles FROM g",
    "import_rows_mapped": _LINES_SQL + "SELECT k AS key, 'x' || CASE WHEN k % 2 = 0 THEN '123' ELSE '-' END AS made FROM g",
    "import_chunks": _LINES_SQL + "SELECT w AS chunk, min(k) AS first_row, max(k) AS last_row, count(*) FILTER (WHERE bad = 0) AS items, sum(bad)::BIGINT AS errors FROM (SELECT k, (SELECT count(*) FROM e WHERE e.k = l.k) AS bad, (row_number() OVER (ORDER BY k) - 1) // 1000 AS w FROM l) GROUP BY w",
    "import_all_or_nothing": "SELECT 0::BIGINT AS items, 0::BIGINT AS items_of_failing_chunks, 'limit.exceeded' AS past_limit",
    "import_preview": _LINES_SQL + "SELECT k AS row_number, k::VARCHAR AS key, 'x' AS flag FROM g ORDER BY k LIMIT 20",
    "review_report": _LINES_SQL + "SELECT k AS row_number, f AS field_name, code, (SELECT count(DISTINCT k) FROM e) AS rows_failed FROM e ORDER BY k, p LIMIT 50",
    "unresolved_rows": UNRESOLVED_SQL,
    "extract_of_stream": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0",
}
