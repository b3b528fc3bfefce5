"""What can't be written so that it reads back, as Column expressions; one rule for every format where formats can differ."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteError
from ..functions import readings as R
from ..sources.dialect import MAX_COLUMNS, MAX_FIELD_CHARS

MAX_TEXT = 32_767  # UTF-16 units in a workbook's cell
NOT_IN_XML = "[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def double_problem(x: Column) -> Column:
    """A double is read back through 15 significant digits. One that is written in so few passes without a second look."""
    text = x.cast("string")
    back = F.format_string("%.14e", x).try_cast("double")
    out_of_range = (F.abs(x) >= 7.9228162514264338e28) | ((x != 0) & (F.abs(x) < 5e-29))
    lost = out_of_range | ((F.length(text) > 16) & ~back.eqNullSafe(x))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), "write.not-finite").when(lost, "write.precision-loss")


def problem(f: T.StructField, form: str) -> Column:
    """The code of a column's value that can't be written as csv, xlsx or ods; null if it can."""
    c, t, workbook = F.col(f"`{f.name}`"), f.dataType, form != "csv"
    if isinstance(t, DATES):
        first = {"csv": "0002-01-01", "xlsx": "1900-01-01", "ods": "0001-01-01"}[form]
        return F.when((c.cast("timestamp_ntz") < F.lit(first).cast("timestamp_ntz")) | (F.year(c) > 9999), "write.date-out-of-range")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), double_problem(c.cast("double")))
    if isinstance(t, T.LongType) and workbook:
        return F.when(c.cast("double").cast("decimal(38,0)") != c.cast("decimal(38,0)"), "write.precision-loss")
    if isinstance(t, T.DecimalType) and workbook:
        return F.when(c.isNotNull() & ~R.from_double(c.cast("double")).eqNullSafe(c.try_cast(R.WHOLE)), "write.precision-loss")
    if isinstance(t, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("string")
    text = c.cast("string")
    return F.when((R.length16(text) if workbook else F.length(text)) > (MAX_TEXT if workbook else MAX_FIELD_CHARS), "write.text-too-long").when(text.rlike(NOT_IN_XML), "write.invalid-character")


def first_problem(df: DataFrame, row: str, problems: dict[str, Column]) -> int:
    """Raises the first refusal in order of rows, then columns; else the number of rows. One pass, without a sort."""
    found = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), p.alias("code")) for i, (n, p) in enumerate(problems.items())])
    one = F.get(F.filter(found, lambda x: x["code"].isNotNull()), F.lit(0))
    seen = df.select(F.col(f"`{row}`").alias("row_number"), one.alias("one"))
    r = seen.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("one").isNotNull(), F.struct("row_number", "one"))).alias("first")).first()
    if r["first"]:
        at, bad = r["first"]["row_number"], r["first"]["one"]
        raise WriteError(bad["code"], f"row {at}, column {bad['column']}", row=at, column=bad["column"])
    return r["n"]


def check_headers(names: list[str]) -> None:
    """1 to 16,384 columns; headers neither empty nor padded, unlike in any case, without characters that XML can't hold."""
    if not 1 <= len(names) <= MAX_COLUMNS:
        raise WriteError("write.columns", f"a sheet has 1 to {MAX_COLUMNS} columns, not {len(names)}")
    seen = set()
    for n in names:
        if not n.strip():
            raise WriteError("write.header", "a header is empty")
        if n != n.strip():
            raise WriteError("write.header", f"{n!r} begins or ends with white space, which reading trims")
        if n.upper() in seen:
            raise WriteError("write.header", f"{n!r} is there twice")
        if re.search(NOT_IN_XML, n) or any("\ud800" <= ch <= "\udfff" for ch in n):
            raise WriteError("write.invalid-character", f"header {n!r}")
        seen.add(n.upper())
