"""Checked extraction: a plan and a schema compiled to one narrow projection.

`compile_plan` turns a scan (row_number, cells array<string>, or named columns) into rows of typed values and errors.
There is no shuffle: every reading, rule, group and ladder is a Column expression. Accepted and rejected rows, the
review and the summaries are filters and aggregates over that projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import readings as R
from ..functions.cultures import culture
from ..plans.mapping import Plan, validate
from ..plans.schema import Alternatives, Field, Schema
from .profile import typed_cell

ERROR = "struct<row_number:bigint,column_index:int,field_name:string,code:string,raw_value:string>"
SQL_TYPE = {"Text": "string", "Integer": "bigint", "Decimal": R.WHOLE, "Date": "timestamp_ntz", "Boolean": "boolean"}


@dataclass(frozen=True)
class Native:
    """What a file or table itself says of a value: its kind, number and date. exact: a number held exactly, in place of num."""

    kind: Column
    num: Column
    date: Column
    exact: Column | None = None

    def integer(self) -> Column:
        is_number = self.kind == "Number"
        if self.exact is not None:
            return F.when(is_number & (F.floor(self.exact) == self.exact), self.exact.try_cast("bigint"))
        whole = (F.floor(self.num) == self.num) & (self.num >= -(2.0**63)) & (self.num < 2.0**63)
        return F.when(is_number & whole, self.num.cast("bigint"))

    def decimal(self) -> Column:
        return self.exact if self.exact is not None else R.from_double(self.num)


def read(text: Column, f: Field, c, accept_other: bool, native: Native | None = None) -> tuple[Column, Column]:
    """(typed value, whether it was read with the other decimal separator). A native value isn't read through the culture."""
    no = F.lit(False)
    if f.type == "Text":
        return text, no
    if f.type == "Boolean":
        return R.boolean(text), no
    if f.type == "Integer":
        plain = R.integer(text, c)
        return (plain if native is None else F.when(text.isNotNull(), F.coalesce(native.integer(), plain))), no
    if f.type == "Date":
        plain = R.date(text, c)
        return (plain if native is None else F.when(text.isNotNull(), F.when(native.kind == "Date", native.date).otherwise(plain))), no
    plain = R.decimal(text, c)
    other = R.other_separator(text, c) if accept_other else F.lit(None).cast(R.WHOLE)
    was_other = plain.isNull() & other.isNotNull() if accept_other else no
    value = F.coalesce(plain, other) if accept_other else plain
    if native is not None:
        is_number = native.kind == "Number"
        value = F.when(text.isNotNull(), F.when(is_number, native.decimal()).otherwise(value))
        was_other = F.coalesce(~is_number, F.lit(True)) & was_other
    return value, was_other


def _named(x: str) -> str:
    return x.replace(".", "_")


@dataclass
class Extraction:
    """rows: row_number, blank, nothing_mapped, values struct, errors array, other_separator, resolutions per set.

    Filters name `part`, the task's number: as that is not deterministic, a filter stays above the projection. Pushed
    below, it would repeat every reading and rule in the condition.
    """

    rows: DataFrame
    schema: Schema
    plan: Plan

    def _good(self) -> DataFrame:
        return self.rows.where("not blank and size(errors) = 0 and part >= 0")

    def _bad(self) -> DataFrame:
        return self.rows.where("not blank and size(errors) > 0 and part >= 0")

    def accepted(self) -> DataFrame:
        good = self._good()
        return good.select("row_number", "values.*", *[F.col(f"`set_{a.name}`").alias(f"{a.name}_resolution") for a in self.schema.alternatives])

    def rejected(self) -> DataFrame:
        """One row an error, in the order of the row's errors."""
        bad = self._bad().select("row_number", F.posexplode("errors").alias("place", "e"))
        return bad.select("row_number", "place", "e.column_index", "e.field_name", "e.code", "e.raw_value")

    def summary(self) -> DataFrame:
        yes = lambda c: F.count_if(c).cast("long")
        live = ~F.col("blank")
        bad = F.size("errors") > 0
        return self.rows.agg(
            F.count(F.lit(1)).alias("rows_read"),
            yes(live & ~bad).alias("rows_produced"),
            yes(F.col("blank")).alias("rows_skipped"),
            yes(F.col("nothing_mapped")).alias("rows_with_nothing_mapped"),
            yes(live & bad).alias("rows_failed"),
            F.coalesce(F.sum(F.when(live, F.size("errors"))), F.lit(0)).cast("long").alias("error_count"),
            F.coalesce(F.sum(F.when(live, F.col("other_separator"))), F.lit(0)).cast("long").alias("other_separator_decimals"),
        )

    def review(self, max_errors: int = 50) -> tuple[dict, list]:
        """(summary, the first errors in row order); never stops early."""
        first = self.rejected().orderBy("row_number", "place").limit(max_errors)
        return self.summary().first().asDict(), [r.asDict() for r in first.collect()]

    def coverage(self) -> DataFrame:
        """(field, filled, empty, share) over produced rows; shares rounded half-even to three places."""
        good = self._good()
        names = [_named(b.field) for b in self.plan.bindings]
        one = good.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col("values")[n]).alias(n) for n in names])
        rows = one.select("n", F.inline(F.array(*[F.struct(F.lit(b.field).alias("field"), F.col(n).alias("filled")) for b, n in zip(self.plan.bindings, names, strict=True)])))
        return rows.select("field", "filled", (F.col("n") - F.col("filled")).alias("empty"), F.when(F.col("n") > 0, F.bround(F.col("filled") / F.col("n"), 3)).otherwise(F.lit(0.0)).alias("share"))

    def until_errors(self, limit: int = 1000) -> DataFrame:
        """rows up to the one with which `limit` rows have failed: reading stops there."""
        cut = self._bad().select("row_number").orderBy("row_number").limit(limit).agg(F.count(F.lit(1)).alias("n"), F.max("row_number").alias("cut"))
        return self.rows.join(F.broadcast(cut), (F.col("n") < limit) | (F.col("row_number") <= F.col("cut"))).drop("n", "cut")

    def preview(self, n: int) -> DataFrame:
        good = self._good().orderBy("row_number").limit(n)
        return good.select("row_number", F.create_map(*[x for b in self.plan.bindings for x in (F.lit(b.field), F.col("texts")[_named(b.field)])]).alias("values"))

    def mapped(self, mapper: Callable[[dict], tuple | dict], returns: str) -> DataFrame:
        """Each produced row through mapper (a dict of its values by field -> a tuple or dict), on the executors. returns: the
        rows' schema."""
        names = {_named(b.field): b.field for b in self.plan.bindings}
        schema = T.StructType.fromDDL(returns)
        columns, arrow = schema.fieldNames(), to_arrow_schema(schema)

        def run(batches):
            for b in batches:
                made = [mapper({names[k]: v for k, v in r.items()}) for r in b.to_pylist()]
                yield pa.RecordBatch.from_pylist([x if isinstance(x, dict) else dict(zip(columns, x, strict=True)) for x in made], arrow)

        return self._good().select("values.*").mapInArrow(run, schema)

    def read_all(self, limit: int = 100_000) -> list:
        """All produced rows on the driver; an error past the limit. AllOrNothing: none if any row fails."""
        if self.schema.policy == "AllOrNothing" and self._bad().limit(1).count():
            return []
        out = self.accepted().orderBy("row_number").limit(limit + 1).collect()
        if len(out) > limit:
            from ..errors import LimitError

            raise LimitError("limit.exceeded", f"more than {limit} rows")
        return out

    def chunks(self, size: int):
        """(first row, last row, items, errors) of windows of `size` read rows, in row order; rows come partition-wise."""
        window, items, errors, all_or_nothing = [], [], [], self.schema.policy == "AllOrNothing"
        for r in self.rows.where("not blank and part >= 0").select("row_number", "values", "errors").orderBy("row_number").toLocalIterator():
            window.append(r["row_number"])
            (errors.extend if r["errors"] else items.append)(r["errors"] if r["errors"] else r["values"])
            if len(window) == size:
                yield window[0], window[-1], [] if errors and all_or_nothing else items, errors
                window, items, errors = [], [], []
        if window:
            yield window[0], window[-1], [] if errors and all_or_nothing else items, errors

    def alternatives_report(self, name: str, reported_rows: int = 50) -> DataFrame:
        """One row a group: rows needing it, won, at each level, empty, incomplete, and invalid values passed over; and
        the first row numbers that stay unresolved or incomplete."""
        a = next(x for x in self.schema.alternatives if x.name == name)
        good = self._good()
        s = f"alt_{a.name}"
        unresolved = F.col(f"set_{name}").isNull()
        firsts = {"unresolved_rows": unresolved}
        cols = [F.count(F.lit(1)).alias("rows_judged"), F.count_if(unresolved).alias("unresolved")]
        bound = {b.field for b in self.plan.bindings}
        for i, g in enumerate(a.groups):
            st = F.col(f"`{s}`")[i]
            reach = 0
            for x in g.levels:
                if not any(m in bound for m in x.any_of):
                    break
                reach += 1
            firsts[f"incomplete_rows_{i}"] = st["needed"] & (st["level"] < reach)
            cols += [
                F.count_if(st["needed"]).alias(f"needing_{i}"),
                F.count_if(st["won"]).alias(f"won_{i}"),
                F.array(*[F.count_if(st["needed"] & (st["level"] == k)) for k in range(len(g.levels) + 1)]).alias(f"at_{i}"),
                F.count_if(st["needed"] & ~st["any"]).alias(f"empty_{i}"),
                F.count_if(st["needed"] & (st["level"] < reach)).alias(f"incomplete_{i}"),
                F.coalesce(F.sum(F.when(~st["needed"], st["ignored"])), F.lit(0)).cast("long").alias(f"ignored_{i}"),
            ]
        one = good.agg(*cols)
        for c, when in firsts.items():  # as many rows as are reported, by a top-n of their own
            rows = good.where(when).select("row_number").orderBy("row_number").limit(reported_rows)
            one = one.join(F.broadcast(rows.agg(F.sort_array(F.collect_list("row_number")).alias(c))))
        return one.select("rows_judged", "unresolved", "unresolved_rows", F.inline(F.array(*[F.struct(F.lit(g.name).alias("group"), *[F.col(f"{x}_{i}").alias(y) for x, y in (("needing", "rows_needing"), ("won", "won"), ("at", "rows_at_level"), ("empty", "empty"), ("incomplete", "incomplete"), ("incomplete_rows", "incomplete_rows"), ("ignored", "ignored_invalid_values"))]) for i, g in enumerate(a.groups)])))


def compile_plan(scan: DataFrame, plan: Plan, schema: Schema, row: str = "row_number", cells: str | None = None) -> Extraction:
    """scan: row numbers and either an array column `cells` (of texts, or of a scan's cells) or columns by position (row's
    own left out). The kinds, numbers and dates of a workbook's cells and of typed columns are taken as they are."""
    others = [c for c in scan.columns if c != row]
    validate(plan, schema, None if cells else len(others))
    c = culture(plan.culture)
    typed_cells = bool(cells) and isinstance(scan.schema[cells].dataType.elementType, T.StructType)
    native: dict[int, Native] = {}
    first = [F.col(row).cast("long").alias("row_number")]
    for k, b in enumerate(plan.bindings):
        if typed_cells:
            cell = F.get(F.col(f"`{cells}`"), b.column)
            parts = {"raw": R.trimmed(cell["text"]), "kind": cell["kind"], "num": cell["num"], "date": cell["date"]}
        elif cells:
            parts = {"raw": R.trimmed(F.get(F.col(f"`{cells}`"), b.column))}
        else:
            own = scan.schema[others[b.column]]
            cell = typed_cell(b.column, own)
            parts = {"raw": cell["text"]}
            if not isinstance(own.dataType, T.StringType):
                parts |= {x: cell[x] for x in ("kind", "num", "date")}
                if isinstance(own.dataType, (T.DecimalType, T.IntegralType)):
                    parts["exact"] = F.col(f"`{own.name}`").try_cast(R.WHOLE)
        first += [x.alias(f"{n}_{k}") for n, x in parts.items()]
        if "kind" in parts:
            native[k] = Native(*[F.col(f"{n}_{k}") if n in parts else None for n in ("kind", "num", "date", "exact")])
    if typed_cells:
        some = F.exists(F.col(f"`{cells}`"), lambda x: R.trimmed(x["text"]).isNotNull())
    elif cells:
        some = F.exists(F.col(f"`{cells}`"), lambda x: R.trimmed(x).isNotNull())
    else:
        some = F.coalesce(*[R.trimmed(F.col(f"`{x}`").cast("string")) for x in others], F.lit(None).cast("string")).isNotNull()
    step = scan.select(*first, F.coalesce(some, F.lit(False)).alias("any_cell"))
    blank = F.lit(True)
    for k in range(len(plan.bindings)):
        blank = blank & F.col(f"raw_{k}").isNull()
    step = step.withColumn("blank", blank).withColumn("nothing_mapped", F.col("blank") & F.col("any_cell"))
    text = lambda k, b: F.when(~F.upper(F.col(f"raw_{k}")).isin([x.strip().upper() for x in b.treat_as_empty]), F.col(f"raw_{k}")) if b.treat_as_empty else F.col(f"raw_{k}")
    step = step.withColumns({f"text_{k}": text(k, b) for k, b in enumerate(plan.bindings)})
    typed, other = {}, F.lit(0)
    for k, b in enumerate(plan.bindings):
        typed[f"value_{k}"], was_other = read(F.col(f"text_{k}"), schema[b.field], c, b.accept_other_separator, native.get(k))
        other = other + was_other.cast("int")
    step = step.withColumns(typed | {"other_separator": F.coalesce(other, F.lit(0))})

    def error(k: int, code: str, when: Column) -> Column:
        b = plan.bindings[k]
        return F.when(when, F.struct(F.col("row_number"), F.lit(b.column).alias("column_index"), F.lit(b.field).alias("field_name"), F.lit(code).alias("code"), F.col(f"raw_{k}").alias("raw_value")))

    place = {b.field: k for k, b in enumerate(plan.bindings)}
    fields_errors: dict[str, list[Column]] = {}
    for k, b in enumerate(plan.bindings):
        f, v, t = schema[b.field], F.col(f"value_{k}"), F.col(f"text_{k}")
        own = []
        if f.required and not f.group:
            own.append(error(k, "value.required", t.isNull()))
        own.append(error(k, "value.type-mismatch", t.isNotNull() & v.isNull()))
        own += [error(k, r.code, v.isNotNull() & ~F.coalesce(r.check(t, v), F.lit(False))) for r in f.constraints]
        fields_errors[b.field] = own
    step = step.withColumns({f"errors_{k}": F.filter(F.array(*fields_errors[b.field]), lambda e: e.isNotNull()) for k, b in enumerate(plan.bindings)})

    later = {m for a in schema.alternatives for g in a.groups[1:] for m in g.members}
    errors = [F.col(f"errors_{k}") for k, b in enumerate(plan.bindings) if b.field not in later]
    for g, members in schema.groups().items():
        ks = [place[m.name] for m in members if m.name in place]
        if any(m.required for m in members) and ks:
            k = ks[0]
            none = F.coalesce(*[F.col(f"value_{x}").cast("string") for x in ks]).isNull()
            errors.append(F.filter(F.array(F.when(none, F.struct(F.col("row_number"), F.lit(plan.bindings[k].column).alias("column_index"), F.lit(g).alias("field_name"), F.lit("group.required").alias("code"), F.lit(None).cast("string").alias("raw_value")))), lambda e: e.isNotNull()))

    for a in schema.alternatives:
        step, own = _ladder(step, a, place, plan)
        errors += own
    none = F.expr(f"cast(array() as array<{ERROR}>)")
    step = step.withColumn("errors", F.concat(none, *errors))
    values = F.struct(*[F.col(f"value_{k}").cast(SQL_TYPE[schema[b.field].type]).alias(_named(b.field)) for k, b in enumerate(plan.bindings)])
    texts = F.struct(*[F.col(f"text_{k}").alias(_named(b.field)) for k, b in enumerate(plan.bindings)])
    keep = [F.col(f"`{p}_{a.name}`") for a in schema.alternatives for p in ("set", "alt")]
    return Extraction(step.select(F.spark_partition_id().alias("part"), "row_number", "blank", "nothing_mapped", values.alias("values"), texts.alias("texts"), "errors", "other_separator", *keep), schema, plan)


def _ladder(step: DataFrame, a: Alternatives, place: dict[str, int], plan: Plan) -> tuple[DataFrame, list[Column]]:
    """Adds set_<name> (the resolution) and alt_<name> (state of each group); the set's own errors and deferred ones."""
    states = []
    open_ = F.lit(True)  # no earlier group has won
    deferred = []
    for i, g in enumerate(a.groups):
        good = lambda m: (F.col(f"value_{place[m]}").isNotNull() & (F.size(f"errors_{place[m]}") == 0)) if m in place else F.lit(False)
        level, whole = F.lit(0), F.lit(True)
        for x in g.levels:
            hit = F.lit(False)
            for m in x.any_of:
                hit = hit | good(m)
            whole = whole & hit
            level = level + whole.cast("int")
        members = [m for m in dict.fromkeys(g.members) if m in place]
        some = F.lit(False)
        for m in members:
            some = some | F.col(f"text_{place[m]}").isNotNull()
        ignored = F.lit(0)
        for m in members if i else ():
            ignored = ignored + (F.size(f"errors_{place[m]}") > 0).cast("int")
        step = step.withColumn(f"lv_{a.name}_{i}", level)
        lv = F.col(f"`lv_{a.name}_{i}`")
        won = open_ & (lv >= g.needed)
        states.append(F.struct(lv.alias("level"), open_.alias("needed"), won.alias("won"), some.alias("any"), ignored.alias("ignored"), F.lit(g.name).alias("group"), F.lit(i).alias("group_index"), F.try_element_at(F.array(*[F.lit(x.name) for x in g.levels]), F.when(lv > 0, lv).otherwise(F.lit(len(g.levels) + 1))).alias("level_name")))
        if i:
            none = F.expr(f"cast(array() as array<{ERROR}>)")
            deferred += [F.when(open_, F.col(f"errors_{place[m]}")).otherwise(none) for m in members]
        open_ = open_ & (lv < g.needed)
    step = step.withColumn(f"alt_{a.name}", F.array(*states))
    won = F.filter(F.col(f"`alt_{a.name}`"), lambda s: s["won"])
    step = step.withColumn(f"set_{a.name}", F.when(F.size(won) > 0, F.struct(*[F.get(won, 0)[x].alias(x) for x in ("group", "group_index", "level", "level_name")])))
    own = []
    if a.unresolved_row_fails:
        first = min((place[m] for g in a.groups for m in g.members if m in place), default=None)
        col = plan.bindings[first].column if first is not None else -1
        e = F.when(F.col(f"`set_{a.name}`").isNull(), F.struct(F.col("row_number"), F.lit(col).alias("column_index"), F.lit(a.name).alias("field_name"), F.lit("group.unresolved").alias("code"), F.lit(None).cast("string").alias("raw_value")))
        own.append(F.filter(F.array(e), lambda x: x.isNotNull()))
    return step, own + deferred


def translations(rows: DataFrame, schema: Schema, group: str) -> DataFrame:
    """rows of accepted() with the group's present variants as a map variant -> text."""
    pairs = [x for f in schema.groups()[group] if _named(f.name) in rows.columns for x in (F.lit(f.variant), F.col(f"`{_named(f.name)}`"))]
    return rows.withColumn(group, F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


def not_in(rows: DataFrame, column: str, allowed: DataFrame) -> DataFrame:
    """Rows whose value is not among the single column of allowed: AllowedValues for sets too large for a list."""
    return rows.join(allowed.select(F.col(allowed.columns[0]).alias("__allowed")), F.col(column) == F.col("__allowed"), "left_anti").where(F.col(column).isNotNull())
