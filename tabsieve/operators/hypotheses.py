"""Ranked type hypotheses of a profiled column. Text always comes last."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cmp_to_key

from ..functions.cultures import culture

SPECIFICITY = {"Boolean": 5, "Date": 4, "Integer": 3, "Decimal": 2, "Text": 1}


@dataclass(frozen=True)
class Hypothesis:
    type: str
    culture: str | None
    confidence: float
    matched: int
    unmatched: int
    outliers: tuple = ()
    own_separator: int = 0


def separator_vote(columns, delimiter: str | None = None) -> str | None:
    """The sheet's decimal separator: each column votes by which separator's best culture reads more numbers; a tie goes
    by the csv delimiter, if there is one."""
    vote = 0
    for c in columns:
        best = {s: max((r.numbers for r in c.readings if culture(r.culture).decimal == s), default=0) for s in ",."}
        vote += (best[","] > best["."]) - (best[","] < best["."])
    if vote:
        return "," if vote > 0 else "."
    return {";": ",", ",": "."}.get(delimiter or "")


def hypotheses(c, minimum: float, preferred: str | None = None) -> list[Hypothesis]:
    n = c.non_empty
    if not n:
        return []
    found: list[Hypothesis] = []

    def add(kind, name, matched, outliers=(), own=0):
        if matched:
            found.append(Hypothesis(kind, name, matched / n, matched, n - matched, () if matched == n else tuple(outliers), own))

    native = {k: c.kinds.get(k, 0) for k in ("Number", "Date", "Boolean")}
    if sum(native.values()) == n:
        whole = c.readings[0].integers if c.readings else 0
        add("Boolean", None, native["Boolean"])
        add("Date", None, native["Date"])
        add("Decimal", None, native["Number"])
        if whole == native["Number"]:
            add("Integer", None, native["Number"])
    else:
        add("Boolean", None, c.booleans)
        for r in c.readings:
            add("Decimal", r.culture, r.numbers, c.number_outliers.get(r.culture, ()))
            if r.integers == r.numbers:
                add("Integer", r.culture, r.numbers, c.number_outliers.get(r.culture, ()))
            add("Date", r.culture, r.dates, c.date_outliers.get(r.culture, ()), r.own_separator_dates)
    found = [h for h in found if h.confidence >= minimum]

    def favoured(h):
        return c.numbers_disagree and preferred and h.type in ("Integer", "Decimal") and h.culture is not None and culture(h.culture).decimal == preferred

    def rank(h):
        s = SPECIFICITY[h.type]
        if c.numbers_disagree and h.type in ("Integer", "Decimal"):
            s = SPECIFICITY["Decimal" if h.type == "Integer" else "Integer"]
        return s

    def order(a, b):
        for x, y in ((b.confidence, a.confidence), (bool(favoured(b)), bool(favoured(a))), (rank(b), rank(a)), (b.own_separator, a.own_separator), (a.culture or "", b.culture or "")):
            if x != y:
                return -1 if x < y else 1
        return 0

    return [*sorted(found, key=cmp_to_key(order)), Hypothesis("Text", None, 1.0, n, 0)]
