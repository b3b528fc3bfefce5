"""Judges a plan against a profile: what an import would run into, without reading rows.

A finding says what is certain (Blocking), that rows will fail (Warning), or what facts about single columns can't tell
(Undetermined). Its arguments name the cause, where a code has several, and the figures behind it.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.cultures import culture, known
from ..operators.extract import Native, read
from ..operators.profile import ColumnProfile, SheetProfile
from .mapping import Binding, Plan
from .schema import Field, Schema

SEVERITY = {"Blocking": 3, "Warning": 2, "Undetermined": 1, "Info": 0}
EXAMPLES = 5

# The names of arguments, and the causes that a reason names.
ARGUMENTS = ("sheetIndex", "culture", "profileHeaderRowIndex", "planHeaderRowIndex", "boundColumnCount", "reason", "distinctCount", "failingCount", "judgedCount", "expectedHeader", "actualHeader", "type", "alternatives", "group", "level", "reachableLevel")
REASONS = ("every-value-is-nothing", "empty-cells", "spelled-as-nothing", "repeats", "no-values", "too-many-distinct", "values-fail", "no-row-can-satisfy", "not-profiled")


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    field: str | None = None
    rows: int | None = None
    bound: str = "Exact"  # or AtLeast, AtMost, Unknown
    examples: tuple[str, ...] = ()
    column: int | None = None
    arguments: dict[str, str] = dataclasses.field(default_factory=dict, hash=False)


@dataclass
class Verdict:
    findings: list[Finding]
    policy: str

    @property
    def can_import(self) -> bool:
        worst = max((SEVERITY[f.severity] for f in self.findings), default=0)
        return worst < 3 and (self.policy != "AllOrNothing" or worst <= 1)


def _args(**values) -> dict[str, str]:
    return {k: str(v) for k, v in values.items()}


def precheck(spark: SparkSession, plan: Plan, schema: Schema, profile: SheetProfile | list[SheetProfile]) -> Verdict:
    """Findings by severity, then affected rows. Rules are judged on the distinct values that the profile kept, by the
    same expressions that extraction uses."""
    sheet = next((p for p in (profile if isinstance(profile, list) else [profile]) if p.sheet == plan.sheet), None)
    if sheet is None:
        return Verdict([Finding("Blocking", "mapping.invalid-sheet", arguments=_args(sheetIndex=plan.sheet))], schema.policy)
    other_name = plan.sheet_name is not None and sheet.name is not None and plan.sheet_name != sheet.name
    if other_name or (plan.sheet_source is not None and plan.sheet_source != sheet.source):
        return Verdict([Finding("Blocking", "structure.sheet-changed", arguments=_args(sheetIndex=plan.sheet))], schema.policy)
    if known(plan.culture) is None:
        return Verdict([Finding("Blocking", "mapping.unknown-culture", arguments=_args(culture=plan.culture))], schema.policy)
    out: list[Finding] = []
    stale = sheet.header_row != plan.header_row
    if stale:
        out.append(Finding("Undetermined", "mapping.stale-profile", arguments=_args(profileHeaderRowIndex=sheet.header_row, planHeaderRowIndex=plan.header_row)))
    lenient = {m for a in schema.alternatives for g in a.groups[1:] for m in g.members}
    names = {f.name for f in schema.fields}
    for b in plan.bindings:
        if b.field not in names:
            continue  # a fault of the plan
        if b.column >= len(sheet.columns):
            out.append(Finding("Blocking", "mapping.invalid-column", b.field, column=b.column))
        elif not stale:
            own = _Column(b, schema[b.field], sheet.columns[b.column], sheet, plan)
            found = [*own.required(), *own.unique(), *own.header(), *own.rules(spark), *own.type()]
            out += [replace(x, severity="Undetermined" if b.field in lenient else x.severity, field=b.field, column=b.column) for x in found]
    if not stale:
        out += _groups(plan, schema, sheet) + _alternatives(plan, schema, sheet)
    return Verdict(sorted(out, key=lambda x: (-SEVERITY[x.severity], -(x.rows or 0))), schema.policy)


def _groups(plan: Plan, schema: Schema, sheet: SheetProfile) -> list[Finding]:
    """A required group whose columns are all empty. Whether single rows leave all of them empty, only the rows tell."""
    out = []
    column = {b.field: b.column for b in plan.bindings if b.column < len(sheet.columns)}
    for g, members in schema.groups().items():
        own = [column[m.name] for m in members if m.required and m.name in column]
        if own and not any(sheet.columns[i].non_empty for i in own):
            out.append(Finding("Blocking", "group.required", g, sheet.rows, column=min(own), arguments=_args(boundColumnCount=len(own))))
    return out


def _alternatives(plan: Plan, schema: Schema, sheet: SheetProfile) -> list[Finding]:
    """How far the mapping lets rows reach on each ladder."""
    out, bound = [], {b.field for b in plan.bindings}
    for a in schema.alternatives:
        usable = False
        for g in a.groups:
            reach = next((i for i, x in enumerate(g.levels) if not bound & set(x.any_of)), len(g.levels))
            usable |= reach >= g.needed
            if reach < len(g.levels):
                out.append(Finding("Undetermined", "group.level-unmapped", g.name, arguments=_args(alternatives=a.name, group=g.name, level=g.levels[reach].name, reachableLevel=reach)))
        if not usable:
            out.append(Finding("Blocking" if a.unresolved_row_fails else "Undetermined", "group.unresolved", a.name, sheet.rows, arguments=_args(alternatives=a.name)))
    return out


class _Column:
    """What a binding's column says of its field."""

    def __init__(self, b: Binding, f: Field, c: ColumnProfile, sheet: SheetProfile, plan: Plan):
        self.b, self.f, self.c, self.sheet, self.plan = b, f, c, sheet, plan
        self.nothing = {x.strip().upper() for x in b.treat_as_empty}
        self.all_bound = {x.column for x in plan.bindings} >= set(range(len(sheet.columns)))

    def _spelled_as_nothing(self, value: str) -> bool:
        return value.upper() in self.nothing

    def _empties_bound(self) -> str:
        """Spellings of nothing make empty cells too few; rows whose bound cells are all empty are skipped, which makes them too many."""
        return {(True, True): "Unknown", (True, False): "AtLeast", (False, True): "AtMost"}.get((bool(self.nothing), not self.all_bound), "Exact")

    def required(self) -> list[Finding]:
        c = self.c
        if not self.f.required or self.f.group:
            return []  # a group answers for its members
        if c.non_empty and c.values_complete and all(self._spelled_as_nothing(v) for v, _ in c.values):
            return [Finding("Blocking", "value.required", rows=self.sheet.rows, arguments=_args(reason="every-value-is-nothing"))]
        if c.empty:
            return [Finding("Warning", "value.required", rows=c.empty, bound=self._empties_bound(), arguments=_args(reason="empty-cells"))]
        return []

    def unique(self) -> list[Finding]:
        c = self.c
        if not self.f.unique:
            return []
        if c.values_complete and any(self._spelled_as_nothing(v) for v, _ in c.values):
            return [Finding("Blocking", "value.not-unique", arguments=_args(reason="spelled-as-nothing"))]
        if c.is_unique is None:
            return [Finding("Undetermined", "value.not-unique", arguments=_args(reason="no-values"))]
        if c.is_unique:
            return []
        repeats = c.non_empty - c.distinct
        if repeats:
            return [Finding("Blocking", "value.not-unique", rows=repeats, arguments=_args(reason="repeats"))]
        # Empty cells may stand in rows that the import skips, unless all columns are bound.
        return [Finding("Blocking" if self.all_bound else "Warning", "value.not-unique", rows=c.empty, bound=self._empties_bound(), arguments=_args(reason="empty-cells"))]

    def header(self) -> list[Finding]:
        if not self.b.header or self.b.header == self.c.header:
            return []
        return [Finding("Blocking", "mapping.header-changed", arguments=_args(expectedHeader=self.b.header, actualHeader=self.c.header))]

    def rules(self, spark: SparkSession) -> list[Finding]:
        c, f = self.c, self.f
        if not f.constraints or not c.non_empty:
            return []
        if not c.values_complete:
            return [Finding("Undetermined", r.code, arguments=_args(reason="too-many-distinct", distinctCount=c.distinct)) for r in f.constraints]
        kept = [(v, n, *self._rebuilt(v)) for v, n in c.values if not self._spelled_as_nothing(v)]
        if not kept:
            return []  # every value reads as absent: required() has that
        df = spark.createDataFrame(kept, "t string, n long, kind string, num double, date string")
        native = Native(F.col("kind"), F.col("num"), F.col("date").try_cast("timestamp_ntz"))
        value, _ = read(F.col("t"), f, culture(self.plan.culture), self.b.accept_other_separator, native)
        df = df.withColumn("v", value).where("v is not null")  # unread values are type()'s
        rows = df.select("t", "n", *[F.coalesce(r.check(F.col("t"), F.col("v")), F.lit(False)).alias(f"ok_{i}") for i, r in enumerate(f.constraints)]).collect()  # at most the retained values
        # No row can pass only if none can be excused as empty.
        strict = (f.required and not f.group) or (not c.empty and not self.nothing)
        out = []
        for i, r in enumerate(f.constraints):
            failing = [x for x in rows if not x[f"ok_{i}"]]
            if failing:
                none = strict and len(failing) == len(rows)
                out.append(Finding("Blocking" if none else "Warning", r.code, rows=sum(x["n"] for x in failing), examples=tuple(sorted(x["t"] for x in failing)[:EXAMPLES]), arguments=_args(reason="no-row-can-satisfy" if none else "values-fail", failingCount=len(failing), judgedCount=len(rows))))
        return out

    def _rebuilt(self, value: str) -> tuple[str, float | None, str | None]:
        """(kind, number, date) of a value that was kept as text, by the kind that most of the column's native cells have."""
        kind = max(("Number", "Date", "Boolean"), key=lambda k: self.c.kinds.get(k, 0))
        if not self.c.kinds.get(kind):
            return "Text", None, None
        if kind == "Number":
            try:
                return kind, float(value), None
            except ValueError:
                return "Text", None, None
        return (kind, None, value if kind == "Date" else None) if kind == "Boolean" or value[:4].isdigit() else ("Text", None, None)

    def type(self) -> list[Finding]:
        c, f = self.c, self.f
        if f.type == "Text" or not c.non_empty:
            return []
        name = self.plan.culture or ""
        native = sum(c.kinds.get(k, 0) for k in ("Number", "Date", "Boolean"))
        reading = next((r for r in c.readings if r.culture.lower() == name.lower()), None)
        if reading is None and native == c.non_empty and c.readings:
            reading = c.readings[0]  # native values read alike in every culture
        if reading is None:
            return [Finding("Undetermined", "value.type-mismatch", arguments=_args(reason="not-profiled", culture=name, type=f.type.lower()))]
        other = reading.other_separator if self.b.accept_other_separator else 0
        readable = {"Integer": reading.integers, "Decimal": reading.numbers + other, "Date": reading.dates, "Boolean": c.booleans}[f.type]
        failing = c.non_empty - readable
        if failing <= 0:
            return []
        reason = "values-fail" if readable else "no-row-can-satisfy"
        return [Finding("Warning" if readable else "Blocking", "value.type-mismatch", rows=failing, arguments=_args(reason=reason, culture=name, type=f.type.lower(), failingCount=failing, judgedCount=c.non_empty))]
