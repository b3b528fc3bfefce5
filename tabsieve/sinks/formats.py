"""Grammars of number formats, date formats and colours: what is accepted is what every spreadsheet shows alike."""

from __future__ import annotations

import re
from dataclasses import dataclass

_NUMBER = re.compile(r'(?:"(?P<before>[^"]*)")?(?P<whole>[#0,]+)(?:\.(?P<part>[0#]+))?(?P<percent>%)?(?:"(?P<after>[^"]*)")?')
_DATE = re.compile(r'yyyy|yy|mm|m|dd|d|hh|h|ss|s|[/\-.:, ]|"[^"]*"|\\.')


def number_format(code: str) -> str:
    """code, if it follows ["text"] (#,)*0* [.0*#*] [%] ["text"] with at most 30 decimals; else ValueError."""
    m = _NUMBER.fullmatch(code)
    if not m:
        raise ValueError(f"{code!r} is no number format")
    whole, part = m["whole"], m["part"] or ""
    bare = whole.replace(",", "")
    if not bare or re.search("0#", bare) or re.search("#0", part) or len(part) > 30:
        raise ValueError(f"{code!r}: # comes before 0 in the integer, after it in the decimals; 30 decimals at most")
    if "," in whole and (whole[0] == "," or whole[-1] == "," or ",," in whole):
        raise ValueError(f"{code!r}: commas stand between digits")
    return code


@dataclass(frozen=True)
class NumberParts:
    before: str
    after: str
    whole_digits: int
    least_decimals: int
    most_decimals: int
    grouped: bool
    percent: bool


def number_parts(code: str) -> NumberParts:
    """What a number format shows."""
    m = _NUMBER.fullmatch(number_format(code))
    part = m["part"] or ""
    return NumberParts(m["before"] or "", m["after"] or "", m["whole"].count("0"), part.count("0"), len(part), "," in m["whole"], bool(m["percent"]))


def date_format(code: str) -> list[str]:
    """The tokens of a date format, minutes told from months (`m` is minutes right after hours or right before seconds)."""
    tokens, at = [], 0
    while at < len(code):
        m = _DATE.match(code, at)
        if not m:
            raise ValueError(f"{code!r} is no date format, at {at}")
        tokens.append(m[0])
        at = m.end()
    fields = [i for i, t in enumerate(tokens) if t[0] in "ymdhs"]
    if not fields:
        raise ValueError(f"{code!r} shows nothing of a date")
    for k, i in enumerate(fields):
        before, after = tokens[fields[k - 1]] if k else "", tokens[fields[k + 1]] if k + 1 < len(fields) else ""
        if tokens[i][0] == "m" and (before[:1] == "h" or after[:1] == "s"):
            tokens[i] = "minute" if len(tokens[i]) == 1 else "minutes"
    return tokens


def color(text: str) -> str:
    """RRGGBB of #RGB, #RRGGBB or RRGGBB."""
    t = text.removeprefix("#")
    if re.fullmatch("[0-9A-Fa-f]{3}", t) and text.startswith("#"):
        t = "".join(c * 2 for c in t)
    if not re.fullmatch("[0-9A-Fa-f]{6}", t):
        raise ValueError(f"{text!r} is no colour")
    return t.upper()
