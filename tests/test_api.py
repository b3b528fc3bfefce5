"""From a file to typed rows, and back."""

import pytest

from tabsieve.api import export, open_workbook
from tabsieve.errors import PlanError, StructureError
from tabsieve.plans import schema as S
from tabsieve.plans.mapping import Binding, Plan
from tabsieve.sinks.workbooks import SheetOut

CUSTOMERS = "id;name;country;signed_on;amount;active\n1001;Contoso Ltd;DE;2024-01-15;1.250,00;true\n1002;Fabrikam;AT;2024-02-01;99,90;false\n1003;Tailspin;DE;n/a;;true\n\n1004;\"Adventure \"\"Works\"\"\";CH;2024-03-09;x;true\n"


def test_end_to_end(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CUSTOMERS)
    f = open_workbook(spark, str(tmp_path / "c.csv"))
    schema = S.Schema((S.Field("id", "Integer").require().must_be_unique(), S.Field("name").require(), S.Field("country").with_rules(S.exact_length(2)), S.Field("signed on", "Date"), S.Field("amount", "Decimal")))
    p = f.profile()
    assert p.rows == 4 and p["amount"].hypotheses[0].culture == "de-DE" and p.preferred_separator == ","
    plan = f.plan(schema, "de-DE")
    v = f.check(plan, schema, p)
    assert v.can_import and {(x.field, x.code, x.rows) for x in v.findings} == {("signed on", "value.type-mismatch", 1), ("amount", "value.type-mismatch", 1)}
    x = f.extract(plan, schema)
    s, errors = x.review()
    assert (s["rows_read"], s["rows_produced"], s["rows_skipped"], s["rows_failed"]) == (5, 2, 1, 2)
    assert [(e["row_number"], e["code"], e["raw_value"]) for e in errors] == [(4, "value.type-mismatch", "n/a"), (6, "value.type-mismatch", "x")]
    for name in ("out.xlsx", "out.ods", "out.zip"):
        export(str(tmp_path / name), [SheetOut("S", x.accepted(), "row_number")])
        assert [c["text"] for c in open_workbook(spark, str(tmp_path / name)).rows().where("row_number = 2").first()["cells"]][:3] == ["1001", "Contoso Ltd", "DE"]
    with pytest.raises(PlanError):
        f.extract(Plan(()), schema)
    with pytest.raises(StructureError):
        f.extract(Plan((Binding(0, "other", "id"), Binding(1, "name", "name"))), schema)
