"""Delimited text that reads back exactly. Lines are a projection; what can't be written exactly is found first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteError
from ..functions import readings as R
from ..functions.cultures import culture
from ..sources.dialect import MAX_QUOTED_LINES
from .checks import check_headers, first_problem, problem


@dataclass(frozen=True)
class CsvOptions:
    culture: str | None = None
    delimiter: str | None = None
    byte_order_mark: bool = True
    formula_guard: bool = False

    def resolved(self) -> str:
        """The delimiter. With a comma as decimal separator it is a semicolon, so that numbers stay whole."""
        if self.delimiter is not None and (len(self.delimiter) != 1 or self.delimiter in '"\r\n' or self.delimiter.isalnum()):
            raise WriteError("write.delimiter", repr(self.delimiter))
        return self.delimiter or (";" if culture(self.culture).decimal == "," else ",")


def rendered(f: T.StructField, o: CsvOptions) -> Column:
    """A column as the text that reads back as the same value in the options' culture."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, T.StringType):
        return R.guarded(c) if o.formula_guard else c
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return R.canonical_date(c.cast("timestamp_ntz"))
    text = R.canonical_number(c) if isinstance(t, T.DecimalType) else c.cast("string")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        text = F.regexp_replace(text, r"\.0$", "")
    if isinstance(t, T.NumericType) and culture(o.culture).decimal == ",":
        text = F.replace(text, F.lit("."), F.lit(","))
    return text


def quoted(text: Column, delimiter: str) -> Column:
    """Quoted where it holds a delimiter that a reader might take, a quote or a line break; null is empty."""
    must = text.rlike('[;,\\t|"\\r\\n]') | text.contains(delimiter)
    return F.coalesce(F.when(must, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))


def problems(df: DataFrame, row: str, options: CsvOptions = CsvOptions()) -> dict[str, Column]:
    """By column: the code of a value that would not read back, else null."""
    d = options.resolved()
    fields = [f for f in df.schema.fields if f.name != row]
    out = {}
    for f in fields:
        c = F.col(f"`{f.name}`")
        out[f.name] = problem(f, "csv")
        if isinstance(f.dataType, T.StringType):
            breaks = F.regexp_count(c, F.lit("\r\n|\r|\n"))
            swallowed = (breaks > 0) & (F.lit(len(fields)) >= 5) & (F.length(c) - F.length(F.replace(c, F.lit(d), F.lit(""))) >= len(fields) - 1)
            out[f.name] = F.coalesce(out[f.name], F.when(breaks > MAX_QUOTED_LINES, "write.too-many-lines").when(swallowed, "write.ambiguous-line-breaks"))
    return out


def refusals(df: DataFrame, row: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """(row_number, place, column, code) of values that would not read back."""
    found = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), p.alias("code")) for i, (n, p) in enumerate(problems(df, row, options).items())]
    return df.select(F.col(row).alias("row_number"), F.inline(F.array(*found))).where("code is not null").select("row_number", "place", "column", "code")


def lines(df: DataFrame, row: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """(row_number, value): one line a row."""
    d = options.resolved()
    fields = [f for f in df.schema.fields if f.name != row]
    text = F.concat_ws(d, *[quoted(rendered(f, options), d) for f in fields])
    if len(fields) == 1:  # else an empty value would be a blank line
        text = F.when(text == "", F.lit('""')).otherwise(text)
    return df.select(F.col(row).alias("row_number"), text.alias("value"))


def header_line(names: list[str], delimiter: str) -> str:
    return delimiter.join('"' + n.replace('"', '""') + '"' if any(c in n for c in ';,\t|"\r\n') else n for n in names)


def checked(df: DataFrame, row: str, options: CsvOptions = CsvOptions()) -> int:
    """The number of rows; raises the first refusal."""
    check_headers([c for c in df.columns if c != row])
    return first_problem(df, row, problems(df, row, options))


def write_csv(df: DataFrame, path: str, row: str, options: CsvOptions = CsvOptions()) -> int:
    """A folder of csv parts in row order, each with the header: every executor writes its own. Returns the rows written."""
    n = checked(df, row, options)
    head = header_line([c for c in df.columns if c != row], options.resolved())
    mark = "﻿" if options.byte_order_mark else ""
    parts = lines(df.orderBy(f"`{row}`"), row, options).select("value", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    first = F.pmod(F.col("i"), F.lit(1 << 33)) == 0
    parts.select(F.when(first, F.concat(F.lit(mark + head + "\r\n"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.option("lineSep", "\r\n").text(path)
    return n


def csv_bytes(df: DataFrame, row: str, options: CsvOptions = CsvOptions()):
    """The pieces of one csv file, in row order; rows come from the executors partition by partition."""
    checked(df, row, options)
    if options.byte_order_mark:
        yield b"\xef\xbb\xbf"
    yield (header_line([c for c in df.columns if c != row], options.resolved()) + "\r\n").encode()
    for r in lines(df.orderBy(f"`{row}`"), row, options).select("value").toLocalIterator(prefetchPartitions=True):
        yield (r["value"] + "\r\n").encode()
