"""The target schema: fields, constraints, groups and ladders of alternatives."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import readings as R

TYPES = ("Text", "Integer", "Decimal", "Date", "Boolean")
RESERVED = ("value.", "group.", "mapping.", "format.", "limit.", "structure.", "write.", "file.", "import.")


@dataclass(frozen=True)
class Constraint:
    """A rule on present, read values. check: (text, value) -> Column, true where the value passes."""

    code: str
    check: Callable[[Column, Column], Column]
    types: tuple[str, ...] = TYPES
    arguments: tuple = ()


def exact_length(n: int) -> Constraint:
    return Constraint("value.exact-length", lambda t, v: R.length16(t) == n, ("Text",), (n,))


def min_length(n: int) -> Constraint:
    return Constraint("value.min-length", lambda t, v: R.length16(t) >= n, ("Text",), (n,))


def max_length(n: int) -> Constraint:
    return Constraint("value.max-length", lambda t, v: R.length16(t) <= n, ("Text",), (n,))


def min_value(n) -> Constraint:
    return Constraint("value.out-of-range", lambda t, v: v >= F.lit(n), ("Integer", "Decimal"), (n,))


def max_value(n) -> Constraint:
    return Constraint("value.out-of-range", lambda t, v: v <= F.lit(n), ("Integer", "Decimal"), (n,))


def allowed_values(values, ignore_case: bool = False) -> Constraint:
    values = list(values)
    if ignore_case:
        return Constraint("value.not-allowed", lambda t, v: F.upper(t).isin([x.upper() for x in values]), ("Text",), tuple(values))
    return Constraint("value.not-allowed", lambda t, v: t.isin(values), ("Text",), tuple(values))


def _may_explode(regex: str) -> bool:
    """Whether a repetition holds another repetition or a choice, so that backtracking need not end in linear time."""
    try:
        tree = re._parser.parse(regex)
    except re.error:
        return True  # not what Python reads: the other engine decides

    def within(part, repeated: bool) -> bool:
        for op, arg in part:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                if (repeated and low != high) or within(body, repeated or high > 1):
                    return True
            elif name == "BRANCH":
                if repeated or any(within(x, repeated) for x in arg[1]):
                    return True
            elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
                if within(arg[-1] if name == "SUBPATTERN" else arg, repeated):
                    return True
        return False

    return within(tree, False)


def pattern(regex: str) -> Constraint:
    """Full match, in time linear in the text. Backreferences and look-around are refused. A pattern that the JVM might
    backtrack on without end is matched by an automaton (RE2, by Arrow batches)."""
    if re.search(r"\\[1-9]|\(\?[=!<]", regex):
        raise ValueError("backreferences and look-around are not allowed in a pattern")
    whole = rf"\A(?:{regex})\z"
    if not _may_explode(regex):
        return Constraint("value.pattern", lambda t, v: t.rlike(whole), ("Text",), (regex,))
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        pc.match_substring_regex(pa.array([""]), whole)
    except pa.ArrowInvalid as e:
        raise ValueError(f"{regex!r} is no pattern: {e}") from e

    def matches(t: pd.Series) -> pd.Series:
        return pc.match_substring_regex(pa.array(t, pa.string()), whole).to_pandas()

    return Constraint("value.pattern", lambda t, v: F.pandas_udf(matches, "boolean")(t), ("Text",), (regex,))


def luhn(code: str = "rule.luhn") -> Constraint:
    return Constraint(code, lambda t, v: R.luhn(t), ("Text",))


def mod97(code: str = "rule.mod97") -> Constraint:
    return Constraint(code, lambda t, v: R.mod97(t), ("Text",))


def must(code: str, check: Callable[[Column], Column]) -> Constraint:
    """The caller's own rule: a Column function of the typed value (a pandas_udf will do)."""
    if code.startswith(RESERVED):
        raise ValueError(f"{code!r} has a reserved prefix")
    return Constraint(code, lambda t, v: check(v))


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "Text"
    required: bool = False
    constraints: tuple[Constraint, ...] = ()
    unique: bool = False
    group: str | None = None
    variant: str | None = None

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r} of field {self.name!r}")

    def require(self) -> Field:
        return replace(self, required=True)

    def with_rules(self, *rules: Constraint) -> Field:
        return replace(self, constraints=(*self.constraints, *rules))

    def must_be_unique(self) -> Field:
        return replace(self, unique=True)


def translated(name: str, variants: list[str], *rules: Constraint, required: bool = False) -> list[Field]:
    """A text field in several variants (languages): one field name.variant each, all of one group."""
    low = [v.lower() for v in variants]
    if not variants or any(not v.strip() for v in variants) or len(set(low)) < len(low):
        raise ValueError("variants must be non-empty and differ")
    return [Field(f"{name}.{v}", "Text", required, rules, group=name, variant=v) for v in variants]


@dataclass(frozen=True)
class Level:
    name: str
    any_of: tuple[str, ...]


@dataclass(frozen=True)
class Group:
    """A group of an alternatives set: a ladder of levels, of which the first `required` must be reached."""

    name: str
    levels: tuple[Level, ...]
    required: int | None = None

    @property
    def needed(self) -> int:
        return len(self.levels) if self.required is None else self.required

    @property
    def members(self) -> list[str]:
        return [m for x in self.levels for m in x.any_of]


def all_of(name: str, *fields: str) -> Group:
    return Group(name, tuple(Level(f, (f,)) for f in fields))


def ladder(name: str, *levels: Level, required: int = 1) -> Group:
    return Group(name, tuple(levels), required)


@dataclass(frozen=True)
class Alternatives:
    name: str
    groups: tuple[Group, ...]
    unresolved_row_fails: bool = True


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    alternatives: tuple[Alternatives, ...] = ()
    policy: str = "BestEffort"  # or AllOrNothing
    _by: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError("field names must differ")
        if self.policy not in ("BestEffort", "AllOrNothing"):
            raise ValueError(f"unknown policy {self.policy!r}")
        self._by.update({f.name: f for f in self.fields})
        seen: set[str] = set()
        sets = [a.name for a in self.alternatives]
        if len(set(sets)) < len(sets):
            raise ValueError("alternative sets must have different names")
        for a in self.alternatives:
            for g in a.groups:
                for m in set(g.members):
                    if m not in self._by:
                        raise ValueError(f"{a.name}: unknown field {m!r}; there are {', '.join(names)}")
                    if self._by[m].required:
                        raise ValueError(f"{a.name}: {m!r} is required, so it can't be an alternative")
                    if m in seen:
                        raise ValueError(f"{a.name}: {m!r} is in two groups")
                    seen.add(m)

    def __getitem__(self, name: str) -> Field:
        if name not in self._by:
            raise KeyError(f"no field {name!r}; there are {', '.join(self._by)}")
        return self._by[name]

    def groups(self) -> dict[str, list[Field]]:
        """Required groups (translated fields) by name."""
        out: dict[str, list[Field]] = {}
        for f in self.fields:
            if f.group:
                out.setdefault(f.group, []).append(f)
        return out
