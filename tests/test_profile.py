"""The profile, hypotheses, and what a precheck makes of them."""

from tabsieve.operators.profile import AnalysisOptions, analyze
from tabsieve.plans import schema as S
from tabsieve.plans.mapping import by_header
from tabsieve.plans.precheck import precheck


def make(spark, *columns):
    rows = [(i + 1, *r) for i, r in enumerate(zip(*columns, strict=True))]
    df = spark.createDataFrame(rows, "row_number long, " + ", ".join(f"c{k} string" for k in range(len(columns))))
    return analyze(df, "row_number")


def test_profile_facts(spark):
    p = make(spark, ["a", "b", " a ", None, ""], ["11.01.2018", "11.02.2018", "11.03.2018", None, None], ["1,5", "2.000", "7", "x", None])
    c = p["c0"]
    assert (c.rows, c.non_empty, c.empty, c.distinct, c.is_unique) == (5, 3, 2, 2, False)
    assert (c.top, c.samples, c.values) == ([("a", 2), ("b", 1)], ["a", "b", "a"], [("a", 2), ("b", 1)])
    assert c.rows_with_value_in({"a"}) == 2
    d = p["c1"]
    assert d.dates_disagree and (d.hypotheses[0].type, d.hypotheses[0].culture) == ("Date", "de-DE")
    n = p["c2"]
    assert n.number_outliers["de-DE"] == [(4, "x")]
    assert [(h.type, h.culture) for h in n.hypotheses][0] == ("Decimal", "de-DE") and n.hypotheses[-1].type == "Text"


def test_empty_table(spark):
    p = analyze(spark.createDataFrame([], "row_number long, a string"), "row_number")
    assert p.rows == 0 and p["a"].hypotheses == [] and p["a"].is_unique is None


def test_options_are_checked():
    for bad in ({"cultures": ()}, {"cultures": ("xx",)}, {"outlier_sample_size": -1}):
        try:
            AnalysisOptions(**bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_precheck_predicts(spark):
    p = make(spark, ["DE", "AT", "XX", "n/a"], ["1", "2", "x", "4"], ["a", "a", "b", "c"])
    schema = S.Schema((S.Field("c0").require().with_rules(S.allowed_values(["DE", "AT"])), S.Field("c1", "Integer"), S.Field("c2").must_be_unique()))
    plan = by_header(["row_number", "c0", "c1", "c2"], schema)
    v = precheck(spark, plan, schema, p)
    assert {(f.field, f.code, f.severity, f.rows) for f in v.findings} == {("c0", "value.not-allowed", "Warning", 2), ("c1", "value.type-mismatch", "Warning", 1), ("c2", "value.not-unique", "Blocking", 1)}
    assert not v.can_import
