"""Mapping plans and checked extraction."""

import pytest
from pyspark.sql import functions as F

from tabsieve.errors import LimitError, PlanError, StructureError
from tabsieve.operators.extract import compile_plan, translations
from tabsieve.plans import schema as S
from tabsieve.plans.mapping import Binding, Plan, by_header, check_structure, faults, header_variant, validate


def test_by_header():
    schema = S.Schema((S.Field("first name"), S.Field("amount", "Decimal")))
    plan = by_header(["First_Name", "", "AMOUNT", "amount"], schema)
    assert [(b.column, b.field) for b in plan.bindings] == [(0, "first name"), (2, "amount")]
    assert Plan.from_json(plan.to_json()) == plan


def test_variants():
    for h in ("title#en", "title_EN", "title-en", "title.en", "title en", "title@en", "title(en)", "title[en]"):
        assert header_variant(h, ["de", "en"]) == ("title", "en")
    assert header_variant("title", ["en"]) is None


def test_faults_are_all_listed():
    schema = S.Schema((S.Field("a").require(), S.Field("b", "Date").with_rules(S.min_value(1))))
    plan = Plan((Binding(9, "x", "zzz"), Binding(0, "b", "b"), Binding(0, "b", "b")), "xx", -1, header_row=-1)
    assert {c for c, _ in faults(plan, schema, 3)} == {"mapping.unknown-field", "mapping.invalid-column", "mapping.duplicate-binding", "mapping.required-field-unmapped", "mapping.constraint-type-mismatch", "mapping.invalid-header-row", "mapping.invalid-sheet", "mapping.unknown-culture"}
    with pytest.raises(PlanError):
        validate(plan, schema)


def test_structure():
    plan = Plan((Binding(0, "a", "a"),), sheet_name="S")
    check_structure(plan, [("S", None)], ["A"])
    for sheets, headers, code in (([], ["a"], "structure.sheet-missing"), ([("T", None)], ["a"], "structure.sheet-changed"), ([("S", None)], None, "structure.header-row-missing"), ([("S", None)], ["b"], "structure.header-changed")):
        with pytest.raises(StructureError) as e:
            check_structure(plan, sheets, headers)
        assert e.value.code == code


def test_schema_is_checked():
    for make in (lambda: S.Field("a", "Nope"), lambda: S.Schema((S.Field("a"), S.Field("a"))), lambda: S.must("value.x", lambda v: v), lambda: S.pattern(r"(a)\1"), lambda: S.translated("t", ["en", "EN"])):
        with pytest.raises(ValueError):
            make()


@pytest.fixture(scope="module")
def ladder(spark):
    schema = S.Schema(
        (S.Field("id", "Integer").require(), S.Field("mail").with_rules(S.pattern("[^@]+@.+")), S.Field("street"), S.Field("city"), S.Field("amount", "Decimal"), *S.translated("title", ["en", "de"], required=True)),
        (S.Alternatives("contact", (S.all_of("mail", "mail"), S.ladder("post", S.Level("street", ("street",)), S.Level("city", ("city",)), required=2))),),
    )
    rows = [
        (2, ["1", "a@b", None, None, "1,5", "T", None]),
        (3, ["2", None, "Road", "Ulm", "48.1836", None, "D"]),
        (4, ["3", None, "Road", None, None, "T", "D"]),
        (5, ["x", "bad", None, None, "?", None, None]),
        (6, [None, " ", None]),
        (7, [None] * 7 + ["more"]),
        (8, ["4", "N/A", "R", "C", None, "T", None]),
    ]
    df = spark.createDataFrame(rows, "row_number long, cells array<string>")
    plan = by_header(["id", "mail", "street", "city", "amount", "title#en", "title (de)"], schema, "de-DE")
    plan = Plan(tuple(Binding(b.column, b.header, b.field, ("n/a",) if b.field == "mail" else (), b.field == "amount") for b in plan.bindings), "de-DE")
    return schema, compile_plan(df, plan, schema, cells="cells")


def test_accepted_and_rejected(ladder):
    schema, x = ladder
    good = {r["row_number"]: r for r in x.accepted().collect()}
    assert sorted(good) == [2, 3, 8]
    assert float(good[3]["amount"]) == 48.1836 and good[3]["contact_resolution"]["group"] == "post" and good[3]["contact_resolution"]["level"] == 2
    errors = [(r["row_number"], r["field_name"], r["code"]) for r in x.rejected().orderBy("row_number", "place").collect()]
    assert errors == [(4, "contact", "group.unresolved"), (5, "id", "value.type-mismatch"), (5, "mail", "value.pattern"), (5, "amount", "value.type-mismatch"), (5, "title", "group.required"), (5, "contact", "group.unresolved")]


def test_summary_and_report(ladder):
    _, x = ladder
    s, first = x.review(2)
    assert s == {"rows_read": 7, "rows_produced": 3, "rows_skipped": 2, "rows_with_nothing_mapped": 1, "rows_failed": 2, "error_count": 6, "other_separator_decimals": 1}
    assert len(first) == 2
    report = {r["group"]: r.asDict() for r in x.alternatives_report("contact").collect()}
    assert report["mail"]["won"] == 1 and report["post"]["rows_needing"] == 2 and report["post"]["rows_at_level"] == [0, 0, 2]
    assert {r["field"]: r["share"] for r in x.coverage().collect()}["amount"] == 0.667


def test_limits(ladder):
    schema, x = ladder
    assert [r[0] for r in x.until_errors(1).select("row_number").orderBy("row_number").collect()] == [2, 3, 4]
    with pytest.raises(LimitError):
        x.read_all(2)
    assert [(a, b, len(i), len(e)) for a, b, i, e in x.chunks(3)] == [(2, 4, 2, 1), (5, 8, 1, 5)]
    assert x.preview(1).first()["values"]["id"] == "1"
    assert translations(x.accepted(), schema, "title").where("row_number = 2").select(F.col("title")).first()[0] == {"en": "T"}


def test_stream(spark, tmp_path):
    from tabsieve.streaming.extract import extract_stream

    schema = S.Schema((S.Field("a", "Integer").require(),))
    spark.createDataFrame([(1, "5"), (2, "x")], "row_number long, a string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_number long, a string").parquet(str(tmp_path / "in"))
    x = extract_stream(stream, by_header(["a"], schema), schema)
    q = x.accepted().writeStream.format("memory").queryName("accepted_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("accepted_rows").collect()] == [(1, 5)]
