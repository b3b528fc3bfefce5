"""Records of delimited text, with malformed quoting repaired and counted.

A quote is syntax only at a field's start. Inside a quoted field a doubled quote is one quote, and past a line end only a
quote before a delimiter, a line end or the end of the text closes it. Text after a closing quote is kept. A quoted
field that runs on too long, or that swallows a record's worth of delimiters, is read again with its quote literal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..errors import LimitError
from .dialect import MAX_COLUMNS, MAX_FIELD_CHARS, MAX_QUOTED_LINES, Dialect

WIDE = 5  # columns from which a swallowed record is told by its delimiters


@dataclass
class Repairs:
    unterminated: int = 0
    stray: int = 0

    @property
    def clean(self) -> bool:
        return not (self.unterminated or self.stray)


def records(text: str, dialect: Dialect, repairs: Repairs | None = None, max_lines: int = MAX_QUOTED_LINES, max_chars: int = MAX_FIELD_CHARS, max_columns: int = MAX_COLUMNS) -> Iterator[list[str]]:
    """Every record's fields as they stand; a blank line is a record of one empty field."""
    repairs = repairs if repairs is not None else Repairs()
    d, q, n = dialect.delimiter, dialect.quote, len(text)
    if q is None or q not in text:  # the plain case: lines are records
        if text:
            lines = re.split("\r\n|\r|\n", text)
            if not lines[-1]:
                lines.pop()
            for line in lines:
                fields = line.split(d)
                _check(fields, max_chars, max_columns)
                yield fields
        return
    stop = re.compile(f"[{re.escape(d)}\r\n]")
    width, at = 0, 0
    literal = -1  # a quote at this place is text
    while at < n:
        fields: list[str] = []
        start = at
        while True:  # a field
            if at < n and text[at] == q and at != literal:
                opened, pos, lines, delimiters, parts, closed = at, at + 1, 0, 0, [], False
                mark = pos
                replay = None
                while True:
                    hit = _next(text, pos, q)
                    end = n if hit < 0 else hit
                    lines += _lines(text, pos, end)
                    delimiters += text.count(d, pos, end)
                    crossed = lines > 0
                    if crossed and width >= WIDE and delimiters >= width - 1 and len(fields) + 1 + _stray_room(text, opened, d) <= width:
                        replay = "stray"
                        break
                    if lines > max_lines:
                        replay = "unterminated"
                        break
                    if hit < 0:
                        replay = "unterminated" if crossed else None
                        if replay is None:
                            parts.append(text[mark:n])
                            pos = n
                        break
                    if hit + 1 < n and text[hit + 1] == q:
                        parts.append(text[mark : hit + 1])
                        pos = mark = hit + 2
                        continue
                    if crossed and hit + 1 < n and text[hit + 1] != d and text[hit + 1] not in "\r\n":
                        pos = hit + 1
                        continue
                    parts.append(text[mark:hit])
                    pos, closed = hit + 1, True
                    break
                if replay:
                    if replay == "stray":
                        repairs.stray += 1
                    else:
                        repairs.unterminated += 1
                    literal = opened
                    continue
                if closed:
                    m = stop.search(text, pos)
                    end = m.start() if m else n
                    parts.append(text[pos:end])
                    pos = end
                value, at = "".join(parts), pos
            else:
                m = stop.search(text, at)
                end = m.start() if m else n
                value, at = text[at:end], end
            if len(value) > max_chars:
                raise LimitError("limit.exceeded", f"a field of {len(value)} characters")
            fields.append(value)
            if len(fields) > max_columns:
                raise LimitError("limit.exceeded", f"more than {max_columns} columns")
            if at < n and text[at] == d:
                at += 1
                continue
            break
        if at < n:
            at += 2 if text.startswith("\r\n", at) else 1
        if not width:
            width = len(fields)
        if at == start:
            break
        yield fields


def _next(text: str, pos: int, q: str) -> int:
    return text.find(q, pos)


def _lines(text: str, lo: int, hi: int) -> int:
    return text.count("\n", lo, hi) + text.count("\r", lo, hi) - text.count("\r\n", lo, hi)


def _stray_room(text: str, opened: int, d: str) -> int:
    """Delimiters in the rest of the line in which the quote stands."""
    ends = [i for i in (text.find("\n", opened), text.find("\r", opened)) if i >= 0]
    return text.count(d, opened, min(ends, default=len(text)))


def _check(fields: list[str], max_chars: int, max_columns: int) -> None:
    if len(fields) > max_columns:
        raise LimitError("limit.exceeded", f"more than {max_columns} columns")
    if any(len(f) > max_chars for f in fields):
        raise LimitError("limit.exceeded", "a field is too long")
