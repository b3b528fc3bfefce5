"""The column profile: every fact of every column over every row.

The table is unpivoted to cells (column, row, kind, text, number, date) and tallied once by (column, value): one shuffle,
combined on the map side. All facts but the samples come from the tally, so costly readings run once for each distinct
value, weighted by its count. Samples in row order keep the first few rows of each partition before their shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import readings as R
from ..functions.cultures import Culture, culture


@dataclass(frozen=True)
class AnalysisOptions:
    cultures: tuple[str, ...] = ("", "de-DE", "en-US")
    retained_distinct_values: int = 1000
    minimum_hypothesis_confidence: float = 0.5
    reported_sample_size: int = 20
    first_value_sample_size: int = 10
    outlier_sample_size: int = 20

    def __post_init__(self):
        if not self.cultures:
            raise ValueError("at least one culture is needed")
        for c in self.cultures:
            culture(c)
        for n in ("retained_distinct_values", "reported_sample_size", "first_value_sample_size", "outlier_sample_size"):
            if getattr(self, n) < 0:
                raise ValueError(f"{n} must not be negative")


KINDS = ("Text", "Number", "Date", "Boolean", "Error")
CELL = "struct<column_index:int,name:string,kind:string,text:string,num:double,date:timestamp_ntz>"


def typed_cell(i: int, f: T.StructField) -> Column:
    """A typed column's cell: kind, canonical text, number, date."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    num = date = F.lit(None)
    if isinstance(t, T.BooleanType):
        kind, text = "Boolean", c.cast("string")
    elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        date = c.cast("timestamp_ntz")
        kind, text = "Date", R.canonical_date(date)
    elif isinstance(t, T.NumericType):
        num = c.cast("double")
        text = R.canonical_number(c) if isinstance(t, (T.DecimalType, T.IntegralType)) else F.regexp_replace(c.cast("string"), r"\.0$", "")
        kind = "Number"
    else:
        kind, text = "Text", R.trimmed(c.cast("string"))
    return F.struct(F.lit(i).alias("column_index"), F.lit(f.name).alias("name"), F.lit(kind).alias("kind"), text.alias("text"), num.cast("double").alias("num"), date.cast("timestamp_ntz").alias("date"))


def cells(df: DataFrame, row: Column | str, columns: list[str] | None = None) -> DataFrame:
    """(row_number, column_index, name, kind, text, num, date), one row a value; empty cells (text null) are left out.
    row: the row's number, given by the scan or by a key, never derived from an order that a shuffle may change."""
    row = F.col(row) if isinstance(row, str) else row
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    made = F.array(*[typed_cell(i, f) for i, f in enumerate(fields)])
    return df.select(row.cast("long").alias("row_number"), F.inline(made)).where("text is not null")


def tally(values: DataFrame) -> DataFrame:
    """(column_index, name, kind, text, num, date, n, first_row), one row for each distinct value of each column."""
    return values.groupBy("column_index", "name", "kind", "text").agg(F.first("num").alias("num"), F.first("date").alias("date"), F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"))


def _readings(t: DataFrame, cultures: list[Culture]) -> DataFrame:
    """tally with each culture's readings: i_k, d_k (number), o_k (other separator), t_k (date), s_k (own separator).
    Cultures that read alike are evaluated once."""
    text, is_text = F.col("text"), F.col("kind") == "Text"
    no = F.lit(False)
    is_number = F.col("kind") == "Number"
    whole = is_number & (F.floor("num") == F.col("num"))
    native = F.struct(F.coalesce(whole, no).alias("i"), F.when(is_number, F.coalesce(text.try_cast(R.WHOLE), R.from_double(F.col("num")))).alias("v"), F.coalesce(is_number & ~whole, no).alias("d"), no.alias("o"))
    none = F.struct(no.alias("i"), F.lit(None).cast(R.WHOLE).alias("v"), no.alias("d"), no.alias("o"))
    guard = is_text & R.could_be_numeric(text)
    numbers, dates, made = {}, {}, {}
    for k, c in enumerate(cultures):
        n = numbers.setdefault((c.decimal, frozenset(c.group)), k)
        d = dates.setdefault((c.order, tuple(c.month_names().items())), k)
        if n == k:
            made[f"r_{k}"] = F.when(F.col("numeric"), R.number(text, c)).when(~is_text, native).otherwise(none)
        if d == k:
            made[f"t_{k}"] = F.when(is_text, R.date(text, c)).otherwise(F.col("date"))
    t = t.withColumn("numeric", guard).withColumns(made)
    out = {}
    for k, c in enumerate(cultures):
        n, d = numbers[c.decimal, frozenset(c.group)], dates[c.order, tuple(c.month_names().items())]
        out |= {f"{x}_{k}": F.col(f"r_{n}")[x] for x in ("i", "v", "d", "o")}
        out |= {f"t_{k}": F.col(f"t_{d}"), f"s_{k}": is_text & F.col(f"t_{d}").isNotNull() & R.has_own_separator(text, c)}
    return t.withColumns(out).withColumn("b", (F.col("kind") == "Boolean") | (is_text & R.boolean(text).isNotNull()))


def _sum(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)).cast("long")


def column_facts(tallied: DataFrame, rows: int, cultures: tuple[str, ...]) -> DataFrame:
    """One row a column that has values: counts, lengths, distinct, kinds, each culture's readings and extremes, and for
    each pair of cultures the rows that they read differently."""
    cs = [culture(c) for c in cultures]
    t = tallied if "numeric" in tallied.columns else _readings(tallied, cs)
    aggs = [
        F.sum("n").cast("long").alias("non_empty"),
        F.min(R.length16(F.col("text"))).alias("min_length"),
        F.max(R.length16(F.col("text"))).alias("max_length"),
        F.count(F.lit(1)).cast("long").alias("distinct"),
        F.max("n").cast("long").alias("most"),
        _sum(F.col("b")).alias("booleans"),
        *[_sum(F.col("kind") == k).alias(f"kind_{k.lower()}") for k in KINDS],
    ]
    for k in range(len(cs)):
        aggs += [_sum(F.col(f"i_{k}")).alias(f"integers_{k}"), _sum(F.col(f"d_{k}")).alias(f"decimals_{k}"), _sum(F.col(f"o_{k}")).alias(f"other_separator_{k}"), _sum(F.col(f"t_{k}").isNotNull()).alias(f"dates_{k}"), _sum(F.col(f"s_{k}")).alias(f"own_separator_{k}")]
        aggs += [F.min(f"v_{k}").alias(f"min_number_{k}"), F.max(f"v_{k}").alias(f"max_number_{k}"), F.min(f"t_{k}").alias(f"min_date_{k}"), F.max(f"t_{k}").alias(f"max_date_{k}")]
        for j in range(k):
            is_text = F.col("kind") == "Text"
            aggs += [_sum(is_text & ~F.col(f"v_{j}").eqNullSafe(F.col(f"v_{k}"))).alias(f"numbers_differ_{j}_{k}"), _sum(is_text & ~F.col(f"t_{j}").eqNullSafe(F.col(f"t_{k}"))).alias(f"dates_differ_{j}_{k}")]
    out = t.groupBy("column_index", "name").agg(*aggs)
    unique = F.when(F.col("non_empty") < rows, False).otherwise(F.col("most") == 1)
    return out.withColumn("empty", F.lit(rows) - F.col("non_empty")).withColumn("is_unique", unique)


def first_values(values: DataFrame, n: int) -> DataFrame:
    """The first n values of each column in row order (row_number breaks no ties: a cell's row is its own)."""
    by = W.partitionBy("column_index").orderBy("row_number")
    return values.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("column_index", "name", "place", "row_number", "text")


def outliers(values: DataFrame, name: str, n: int, dates: bool = False) -> DataFrame:
    """The first n values of each column, in row order, that don't read as a number (or as a date) in a culture."""
    return all_outliers(values, (name,), n).where(F.col("dates") if dates else ~F.col("dates")).drop("culture", "dates")


def all_outliers(values: DataFrame, cultures: tuple[str, ...], n: int, read: DataFrame | None = None) -> DataFrame:
    """outliers() of all cultures and both kinds: (culture, dates, column_index, name, place, row_number, text).

    Readings run once for each distinct value (read: the tally with them). The first n cells that don't read hold no
    other values than the n distinct ones that come first, so only these few are looked up among all cells.
    """
    t = _readings(tally(values), [culture(c) for c in cultures]) if read is None else read
    # Cultures that read alike fail alike: each kind of failure is looked up once.
    fails, alike = [], {}
    for k, c in enumerate(cultures):
        own = culture(c)
        for dates, key, unread in ((False, (own.decimal, frozenset(own.group)), ~(F.col(f"i_{k}") | F.col(f"d_{k}"))), (True, (own.order, tuple(own.month_names().items())), F.col(f"t_{k}").isNull())):
            first = alike.setdefault((dates, key), (c, []))
            first[1].append(c)
            if first[0] == c:
                fails.append(F.struct(F.lit(c).alias("culture"), F.lit(dates).alias("dates"), unread.alias("unread")))
    one = t.select("column_index", "kind", "text", "first_row", F.inline(F.filter(F.array(*fails), lambda w: F.coalesce(w["unread"], F.lit(True))))).drop("unread")
    early = W.partitionBy("column_index", "culture", "dates").orderBy("first_row", "kind", "text")
    few = one.withColumn("place", F.row_number().over(early)).where(F.col("place") <= n).drop("place", "first_row")
    found = values.select("column_index", "name", "kind", "row_number", "text").join(F.broadcast(few), ["column_index", "kind", "text"])  # n values a column, culture and kind
    by = W.partitionBy("column_index", "culture", "dates").orderBy("row_number")
    found = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n)
    twins = F.array(*[F.struct(F.lit(first).alias("of"), F.lit(d).alias("d"), F.lit(c).alias("c")) for (d, _), (first, same) in alike.items() for c in same])
    own = F.filter(twins, lambda x: (x["of"] == F.col("culture")) & (x["d"] == F.col("dates")))
    return found.select(F.explode(own).alias("own"), "dates", "column_index", "name", "place", "row_number", "text").select(F.col("own.c").alias("culture"), "dates", "column_index", "name", "place", "row_number", "text")


def top_values(tallied: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each column, ties by the value."""
    by = W.partitionBy("column_index").orderBy(F.desc("n"), "text")
    return tallied.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("column_index", "name", "place", "text", "n")


def distinct_values(tallied: DataFrame, cap: int) -> DataFrame:
    """Every distinct value with its count, in order of first appearance, for columns that have at most cap of them."""
    small = tallied.groupBy("column_index").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= cap).select("column_index")
    by = W.partitionBy("column_index").orderBy("first_row", "text")
    return tallied.join(small, "column_index").withColumn("place", F.row_number().over(by)).select("column_index", "name", "place", "text", "n")


def rows_with_value_in(tallied: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return tallied.where((F.col("name") == column) & F.col("text").isin(allowed)).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"))


@dataclass(frozen=True)
class Reading:
    culture: str
    integers: int
    decimals: int
    dates: int
    own_separator_dates: int
    other_separator: int
    min_number: object = None
    max_number: object = None
    min_date: object = None
    max_date: object = None

    @property
    def numbers(self) -> int:
        return self.integers + self.decimals


@dataclass
class ColumnProfile:
    index: int
    header: str
    rows: int
    non_empty: int = 0
    min_length: int | None = None
    max_length: int | None = None
    distinct: int = 0
    is_unique: bool | None = None
    booleans: int = 0
    kinds: dict[str, int] = field(default_factory=dict)
    readings: list[Reading] = field(default_factory=list)
    numbers_disagree: bool = False
    dates_disagree: bool = False
    top: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    values: list[tuple[str, int]] = field(default_factory=list)
    values_complete: bool = False
    number_outliers: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    date_outliers: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    hypotheses: list = field(default_factory=list)

    @property
    def empty(self) -> int:
        return self.rows - self.non_empty

    def best(self, preferred: str | None = None) -> Reading | None:
        """The culture that reads most numbers, then most dates, then most dates with its own separator."""
        if not self.readings:
            return None
        top = max(self.readings, key=lambda r: (r.numbers, r.dates, r.own_separator_dates))
        if preferred:
            for r in self.readings:
                if r.numbers == top.numbers and culture(r.culture).decimal == preferred:
                    return r
        return top

    def rows_with_value_in(self, allowed) -> int | None:
        return sum(n for v, n in self.values if v in allowed) if self.values_complete else None


@dataclass
class SheetProfile:
    rows: int
    columns: list[ColumnProfile]
    header_row: int = 0
    preferred_separator: str | None = None
    sheet: int = 0
    name: str | None = None
    source: str | None = None

    def __getitem__(self, header: str) -> ColumnProfile:
        return next(c for c in self.columns if c.header == header)


def analyze(df: DataFrame, row: Column | str, options: AnalysisOptions | None = None, delimiter: str | None = None) -> SheetProfile:
    """Profiles df, its columns typed or text."""
    return analyze_cells(cells(df, row), df.count(), df.columns, options, delimiter)


def analyze_cells(values: DataFrame, rows: int, headers: list[str], options: AnalysisOptions | None = None, delimiter: str | None = None) -> SheetProfile:
    """Profiles cells (as cells() or a scan gives them). What comes to the driver is bounded by columns and options, not by rows."""
    from .hypotheses import hypotheses, separator_vote

    o = options or AnalysisOptions()
    cs = o.cultures
    tallied = _readings(tally(values), [culture(c) for c in cs]).persist()
    columns = [ColumnProfile(i, h, rows, is_unique=None if rows == 0 else False) for i, h in enumerate(headers)]
    for r in column_facts(tallied, rows, cs).collect():
        c = columns[r["column_index"]]
        c.non_empty, c.min_length, c.max_length, c.distinct, c.booleans, c.is_unique = (r[k] for k in ("non_empty", "min_length", "max_length", "distinct", "booleans", "is_unique"))
        c.kinds = {k: r[f"kind_{k.lower()}"] for k in KINDS if r[f"kind_{k.lower()}"]}
        c.readings = [Reading(n, *(r[f"{x}_{k}"] for x in ("integers", "decimals", "dates", "own_separator", "other_separator", "min_number", "max_number", "min_date", "max_date"))) for k, n in enumerate(cs)]
        number, date = max(x.numbers for x in c.readings), max(x.dates for x in c.readings)
        for k in range(len(cs)):
            for j in range(k):
                a, b = c.readings[j], c.readings[k]
                c.numbers_disagree |= number > 0 and a.numbers == b.numbers == number and r[f"numbers_differ_{j}_{k}"] > 0
                c.dates_disagree |= date > 0 and a.dates == b.dates == date and r[f"dates_differ_{j}_{k}"] > 0
    for r in top_values(tallied, o.reported_sample_size).orderBy("column_index", "place").collect():
        columns[r["column_index"]].top.append((r["text"], r["n"]))
    for r in first_values(values, o.first_value_sample_size).orderBy("column_index", "place").collect():
        columns[r["column_index"]].samples.append(r["text"])
    for r in distinct_values(tallied, o.retained_distinct_values).orderBy("column_index", "place").collect():
        columns[r["column_index"]].values.append((r["text"], r["n"]))
    for c in columns:
        c.values_complete = len(c.values) == c.distinct
    for r in all_outliers(values, cs, o.outlier_sample_size, tallied).orderBy("column_index", "place").collect():
        c = columns[r["column_index"]]
        (c.date_outliers if r["dates"] else c.number_outliers).setdefault(r["culture"], []).append((r["row_number"], r["text"]))
    tallied.unpersist()
    preferred = separator_vote(columns, delimiter)
    for c in columns:
        c.hypotheses = hypotheses(c, o.minimum_hypothesis_confidence, preferred)
    return SheetProfile(rows, columns, preferred_separator=preferred)
