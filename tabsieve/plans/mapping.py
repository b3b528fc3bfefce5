"""Mapping plans: which column feeds which field. Built by header, checked against the schema, kept as JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from ..errors import PlanError, StructureError
from ..functions.cultures import known
from .schema import Field, Schema


@dataclass(frozen=True)
class Binding:
    column: int
    header: str
    field: str
    treat_as_empty: tuple[str, ...] = ()
    accept_other_separator: bool = False


@dataclass(frozen=True)
class Plan:
    bindings: tuple[Binding, ...]
    culture: str | None = None
    sheet: int = 0
    sheet_name: str | None = None
    sheet_source: str | None = None
    header_row: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Plan:
        d = json.loads(text)
        d["bindings"] = tuple(Binding(**{**b, "treat_as_empty": tuple(b["treat_as_empty"])}) for b in d["bindings"])
        return Plan(**d)


def normalized(name: str) -> str:
    """Without white space and _ - . in lower case."""
    return re.sub(r"[\s_\-.]", "", name).lower()


def header_variant(header: str, variants: list[str]) -> tuple[str, str] | None:
    """(base, variant) of a header that ends in a declared variant: name#en, name_en, name-en, name.en, name en, name@en,
    name(en), name[en]."""
    for v in variants:
        m = re.fullmatch(rf"(.+?)\s*(?:[#_\-.@ ]{re.escape(v)}|\({re.escape(v)}\)|\[{re.escape(v)}\])\s*", header, re.IGNORECASE)
        if m:
            return m[1].strip(), v
    return None


def by_header(headers: list[str | None], schema: Schema, culture: str | None = None, matcher: Callable[[str, Field], bool] | None = None, sheet: int = 0, sheet_name: str | None = None, header_row: int = 0) -> Plan:
    """Each field bound once, to the first column that matches; columns in order, fields in schema order."""

    def matches(h: str, f: Field) -> bool:
        if matcher:
            return matcher(h, f)
        if normalized(h) == normalized(f.name):
            return True
        if f.variant and f.group:
            found = header_variant(h, [f.variant])
            return bool(found) and normalized(found[0]) == normalized(f.group)
        return False

    bound: dict[str, Binding] = {}
    for i, h in enumerate(headers):
        if h is None or not h.strip():
            continue
        for f in schema.fields:
            if f.name not in bound and matches(h, f):
                bound[f.name] = Binding(i, h, f.name)
                break
    return Plan(tuple(sorted(bound.values(), key=lambda b: b.column)), culture, sheet, sheet_name, None, header_row)


def faults(plan: Plan, schema: Schema, columns: int | None = None) -> list[tuple[str, str]]:
    """Everything that is wrong with the plan, as (code, what)."""
    out = []
    names, bound, used = {f.name for f in schema.fields}, [b.field for b in plan.bindings], [b.column for b in plan.bindings]
    for b in plan.bindings:
        if b.field not in names:
            out.append(("mapping.unknown-field", b.field))
        if b.column < 0 or (columns is not None and b.column >= columns):
            out.append(("mapping.invalid-column", str(b.column)))
    out += [("mapping.duplicate-binding", f) for f in dict.fromkeys(bound) if bound.count(f) > 1]
    out += [("mapping.duplicate-binding", str(c)) for c in dict.fromkeys(used) if used.count(c) > 1]
    for f in schema.fields:
        if f.required and not f.group and f.name not in bound:
            out.append(("mapping.required-field-unmapped", f.name))
        out += [("mapping.constraint-type-mismatch", f"{f.name}: {c.code}") for c in f.constraints if f.type not in c.types]
    for g, members in schema.groups().items():
        if any(m.required for m in members) and not any(m.name in bound for m in members):
            out.append(("mapping.required-group-unmapped", g))
    if plan.header_row < 0:
        out.append(("mapping.invalid-header-row", str(plan.header_row)))
    if plan.sheet < 0:
        out.append(("mapping.invalid-sheet", str(plan.sheet)))
    if known(plan.culture) is None:
        out.append(("mapping.unknown-culture", plan.culture))
    return out


def validate(plan: Plan, schema: Schema, columns: int | None = None) -> None:
    found = faults(plan, schema, columns)
    if found:
        raise PlanError(found)


def check_structure(plan: Plan, sheets: list[tuple[str, str | None]], headers: list[str | None] | None) -> None:
    """Sheet and headers are those of the plan."""
    if plan.sheet >= len(sheets):
        raise StructureError("structure.sheet-missing", f"there is no sheet {plan.sheet}")
    name, source = sheets[plan.sheet]
    if (plan.sheet_name is not None and plan.sheet_name != name) or (plan.sheet_source is not None and plan.sheet_source != source):
        raise StructureError("structure.sheet-changed", f"sheet {plan.sheet} is {name!r} now")
    if headers is None:
        raise StructureError("structure.header-row-missing", "no header row")
    for b in plan.bindings:
        if b.column >= len(headers) or normalized(headers[b.column] or "") != normalized(b.header):
            raise StructureError("structure.header-changed", f"column {b.column} is no longer {b.header!r}")
