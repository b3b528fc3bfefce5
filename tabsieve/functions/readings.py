"""Readings of text as numbers, dates and booleans, as Column expressions: built-in functions only, no casts that throw."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cultures import Culture

WHOLE, WIDE = "decimal(38,18)", "decimal(38,0)"
WHITE = r"[\s\x0B   -     　\x85]"


def trimmed(text: Column) -> Column:
    """text without Unicode white space around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", F.lit("")), F.lit(""))


def length16(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def could_be_numeric(text: Column) -> Column:
    return text.rlike(r"^[0-9.,\-+eE   '’\t-\r]+$") & text.rlike("[0-9]")


def _class(chars: str) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def bare_integer(text: Column) -> Column:
    """Digits alone, as most integers are written: they read alike in every culture, without further tests."""
    return text.rlike("^-?[0-9]{1,18}$")


def integer(text: Column, c: Culture) -> Column:
    """Sign, digits in well-formed groups; null unless it is in the range of 64 bits."""
    g = _class(c.group)
    ok = text.rlike(rf"^\s*[+-]?\d+(?:{g}\d{{3}})*\s*$")
    other = F.when(could_be_numeric(text) & ok, F.regexp_replace(text, rf"{g}|\s", "").try_cast("bigint"))
    return F.when(bare_integer(text), text.try_cast("bigint")).otherwise(other)


def _decimal_pattern(c: Culture) -> str:
    g, d = _class(c.group), re.escape(c.decimal)
    number = rf"(?:\d+(?:{g}\d{{3}})*(?:{d}\d*)?|{d}\d+)"
    return rf"^\s*(?:[+-]?\s*{number}(?:[eE][+-]?\d+)?|{number}(?:[eE][+-]?\d+)?[+-])\s*$"


def _plain(text: Column, c: Culture, guarded: bool = False) -> Column:
    """The number without groups, with a decimal point and the sign in front; null if it isn't well formed. guarded: it is
    known to be possibly numeric."""
    plain = F.translate(text, c.group + " \t\n\x0b\f\r", "")
    plain = F.translate(plain, c.decimal, ".") if c.decimal != "." else plain
    turned = F.when(plain.rlike("[+-]$"), F.concat(F.right(plain, F.lit(1)), F.substr(plain, F.lit(1), F.length(plain) - 1))).otherwise(plain)
    fits = text.rlike(_decimal_pattern(c))
    return F.when(fits if guarded else could_be_numeric(text) & fits, turned)


def decimal(text: Column, c: Culture) -> Column:
    """As integer, with a decimal part, an exponent and a trailing sign too; decimal(38,18), null if it doesn't fit."""
    bare = text.rlike(rf"^-?[0-9]{{1,18}}(?:{re.escape(c.decimal)}[0-9]{{1,18}})?$")  # needs no further tests
    plain = F.translate(text, ",", ".") if c.decimal == "," else text
    return F.when(bare, plain.try_cast(WHOLE)).otherwise(_plain(text, c).try_cast(WHOLE))


def reads_as_decimal(text: Column, c: Culture) -> Column:
    """Whether the text is a number of up to 28 integer digits: fits where decimal(38,18) has no room too."""
    return F.coalesce(F.abs(_plain(text, c).try_cast("double")) < 7.9228162514264338e28, F.lit(False))


def number(text: Column, c: Culture) -> Column:
    """(i whether an integer, v the value, d whether a decimal, o whether one with the other separator) of a text that could
    be numeric: each pattern runs once."""
    g = _class(c.group)

    def read(plain: Column) -> Column:
        whole = F.when(plain.isNotNull() & text.rlike(rf"^\s*[+-]?\d+(?:{g}\d{{3}})*\s*$"), plain.try_cast("bigint"))
        value = plain.try_cast(WHOLE)
        is_decimal = whole.isNull() & F.coalesce(F.abs(plain.try_cast("double")) < 7.9228162514264338e28, F.lit(False))
        other = plain.isNull() & text.contains(c.other) & other_separator(text, c).isNotNull()
        return F.struct(whole.isNotNull().alias("i"), F.coalesce(whole.cast(WHOLE), value).alias("v"), is_decimal.alias("d"), (~is_decimal & other).alias("o"))

    bare = F.struct(F.lit(True).alias("i"), text.try_cast(WHOLE).alias("v"), F.lit(False).alias("d"), F.lit(False).alias("o"))
    return F.when(bare_integer(text), bare).otherwise(let(_plain(text, c, guarded=True), read))


def other_separator(text: Column, c: Culture) -> Column:
    """A plain decimal with the separator that isn't the culture's: digits on both sides, not three after it."""
    s = re.escape(c.other)
    t = F.trim(text)
    ok = (F.length(t) <= 30) & t.rlike(rf"^[+-]?\d+{s}\d+$") & ~t.rlike(rf"{s}\d{{3}}$") & (F.length(F.regexp_replace(t, r"\D", "")) <= 28)
    return F.when(ok, F.regexp_replace(t, s, ".").try_cast(WHOLE))


TIME = r"(?:[Tt\s]\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,7})?)?\s*(?:[AaPp][Mm])?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def looks_like_date(text: Column) -> Column:
    """Cheap test before the costly readings."""
    words = F.length(text).between(8, 40) & (_count(text, "-/., ") >= 2) & text.rlike(r"\p{L}.*\d{4}$")
    return (F.length(text) >= 4) & (text.contains(":") | (_count(text, "-/.") >= 2) | words)


def _made(day: Column, t: Column) -> Column:
    """The date-time of y-m-d and the time at the end of t; a zone is read over, the wall clock stays."""
    clock = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6}))?)?\d?\s*([AaPp][Mm])?\s*(?:[Zz]|[+-]\d{2}:?\d{2})?$"

    def made(d: Column) -> Column:
        part = lambda i: F.try_element_at(d, F.lit(i)).try_cast("int")
        year = part(1) + F.when(F.length(F.try_element_at(d, F.lit(1))) > 2, 0).when(part(1) < 50, 2000).otherwise(1900)
        at = lambda h, m, sec: F.when(year != 1, F.try_make_timestamp_ntz(year, part(2), part(3), h, m, sec))
        hour, half = F.coalesce(F.regexp_extract(t, clock, 1).try_cast("int"), F.lit(0)), F.lower(F.regexp_extract(t, clock, 5))
        hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
        second = F.concat(F.lit("0"), F.regexp_extract(t, clock, 3), F.lit("."), F.regexp_extract(t, clock, 4), F.lit("0")).try_cast("decimal(10,6)")
        timed = at(hour, F.coalesce(F.regexp_extract(t, clock, 2).try_cast("int"), F.lit(0)), second)
        return F.when(t.contains(":"), timed).otherwise(at(F.lit(0), F.lit(0), F.lit(0).cast("decimal(10,6)")))

    return F.when(day.isNotNull(), let(F.split(day, "-"), made))


def date(text: Column, c: Culture) -> Column:
    """A date with day, month and year, perhaps a time; never completed from today. Patterns: ISO, the culture's numeric
    order with any of . / - between, year first, and month names."""
    names = c.month_names()
    some = "|".join(sorted(map(re.escape, names), key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    forms = [(rf"^(\d{{4}})(?:-|[./]\s?)(\d{{1,2}})(?:-|[./]\s?)(\d{{1,2}})\.?{TIME}", "$1-$2-$3")]
    if c.order != "YMD":
        forms.append((rf"^(\d{{1,2}})[./-]\s?(\d{{1,2}})[./-]\s?(\d{{4}}|\d{{2}}){TIME}", "$3-$2-$1" if c.order == "DMY" else "$3-$1-$2"))

    def read(t: Column) -> Column:
        # A pattern that doesn't match leaves the text as it is, so one pass both tests and extracts.
        def first_of(left: list) -> Column:
            if not left:
                return F.lit(None).cast("string")
            (p, to), *rest = left
            return let(F.regexp_replace(t, p, "=" + to), lambda x: F.when(x.startswith("="), F.substr(x, F.lit(2))).otherwise(first_of(rest)))

        numeric = first_of(forms)
        days = []
        for p, y, m, d in ((rf"^(\d{{1,2}})\.?[\s-]+({some})\.?,?[\s-]+(\d{{4}}){TIME}", 3, 2, 1), (rf"^({some})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){TIME}", 3, 1, 2)):
            get = lambda i, p=p: F.regexp_extract(t, p, i)
            days.append(F.when(t.rlike(p), F.concat_ws("-", get(y), F.try_element_at(table, get(m)).cast("string"), get(d))))
        worded = F.when(t.rlike(r"\p{L}\p{L}"), F.coalesce(*days))
        return F.when(looks_like_date(t), let(F.coalesce(numeric, worded), lambda day: _made(day, t)))

    iso = text.rlike("^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}$")  # as most dates are kept
    return F.when(iso, text.try_cast("timestamp_ntz")).otherwise(let(F.lower(F.trim(text)), read))


def has_own_separator(text: Column, c: Culture) -> Column:
    return text.contains(c.date_separator)


def boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False)


def from_double(x: Column) -> Column:
    """A workbook's number with its 15 significant digits."""
    return F.when(F.abs(x) < 5e-29, F.lit(0).cast(WHOLE)).otherwise(F.format_string("%.14e", x).try_cast(WHOLE))


def canonical_number(x: Column) -> Column:
    """A decimal's text without trailing zeros."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)


def canonical_date(x: Column) -> Column:
    """yyyy-MM-dd, with the time if there is one."""
    return F.when(F.date_trunc("day", x) == x, F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"))


def from_serial(n: Column, date1904: bool = False) -> Column:
    """The date of a workbook's serial number. In the 1900 system day 60 is no date, and days before it count from a day later."""
    micros = F.round(n * 86_400_000).cast("long") * 1000
    base = F.when(F.lit(date1904), F.lit("1904-01-01")).when(n < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("timestamp_ntz")
    made = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / 1_000_000).cast("decimal(18,6)"))
    ok = (n >= 0) & (n < 2_958_466) if date1904 else (n >= 0) & (n < 2_958_466) & ~((n >= 60) & (n < 61))
    return F.when(ok, made)


def to_serial(t: Column) -> Column:
    """The serial number of a date in the 1900 system; null before 1900-01-01."""
    days = F.datediff(t, F.lit("1899-12-30").cast("date")).cast("double")
    days = F.when(days < 61, days - 1).otherwise(days)
    part = (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / F.lit(86400.0)
    return F.when(t >= F.lit("1900-01-01").cast("timestamp_ntz"), days + part)


def expanded(text: Column) -> Column:
    """Digits of a code, letters as two digits (A = 10 ... Z = 35); null unless upper-case letters and digits only."""
    digits = F.transform(F.split(text, ""), lambda ch: F.when(ch.rlike("[A-Z]"), (F.ascii(ch) - 55).cast("string")).otherwise(ch))
    return F.when(text.rlike(r"^[0-9A-Z]+$"), F.array_join(digits, ""))


def luhn(text: Column) -> Column:
    """Luhn checksum over the expanded digits."""
    d = F.reverse(F.transform(F.split(expanded(text), ""), lambda ch: ch.cast("int")))
    total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(total % 10 == 0, F.lit(False))


def mod97(text: Column) -> Column:
    """ISO 7064 mod 97-10: the expanded number leaves 1."""
    rest = F.aggregate(F.split(expanded(text), ""), F.lit(0), lambda r, ch: (r * 10 + ch.cast("int")) % 97)
    return F.coalesce(rest == 1, F.lit(False))


def guarded(text: Column) -> Column:
    """Formula guard: text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def normalized_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s_\-.]", ""))
