"""Cultures: how numbers and dates are written. The empty name is the invariant culture."""

from __future__ import annotations

import re
from dataclasses import dataclass

SPACES = "   "  # a culture that groups with one of these accepts all three
APOSTROPHES = "'’"

EN = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DE = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")
FR = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
IT = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")
NL = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")


PL = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września", "października", "listopada", "grudnia")
HU = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")
TR = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")


@dataclass(frozen=True)
class Culture:
    name: str
    decimal: str
    group: str  # all characters that group alike
    date_separator: str
    order: str  # of day, month, year in a numeric date
    months: tuple[str, ...] = EN
    more_months: tuple[tuple[str, int], ...] = ()  # other names of months, with their numbers

    def month_names(self) -> dict[str, int]:
        """Names of months, and their first three letters where they tell one from the others."""
        out = {n: i for n, i in self.more_months} | {n: i + 1 for i, n in enumerate(self.months)}
        short = [n[:3] for n in self.months]
        return {n[:3]: i + 1 for i, n in enumerate(self.months) if short.count(n[:3]) == 1} | out

    @property
    def other(self) -> str:
        """The decimal separator that isn't this culture's."""
        return "." if self.decimal == "," else ","


CULTURES = {
    c.name: c
    for c in (
        Culture("", ".", ",", "/", "MDY"),
        Culture("en-US", ".", ",", "/", "MDY"),
        Culture("en-GB", ".", ",", "/", "DMY"),
        Culture("de-DE", ",", ".", ".", "DMY", DE),
        Culture("de-CH", ".", APOSTROPHES, ".", "DMY", DE),
        Culture("fr-FR", ",", SPACES, "/", "DMY", FR),
        Culture("pl-PL", ",", SPACES, ".", "DMY", PL),
        Culture("hu-HU", ",", SPACES, ". ", "YMD", HU),
        Culture("it-IT", ",", ".", "/", "DMY", IT),
        Culture("es-ES", ",", ".", "/", "DMY", ES),
        Culture("nl-NL", ",", ".", "-", "DMY", NL),
        Culture("tr-TR", ",", ".", ".", "DMY", TR),
    )
}


_found: dict[str, Culture] = {}
_tags: set[str] = set()


def _of_platform(name: str) -> Culture | None:
    """A culture by the platform's locale data (predefined ones only, so that a typo makes none); None without Spark."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is None:
        return None
    jvm = context._jvm
    locale = jvm.java.util.Locale.forLanguageTag(name)
    if not _tags:
        _tags.update(str(x.toLanguageTag()) for x in jvm.java.util.Locale.getAvailableLocales())
    if not locale.getCountry() or str(locale.toLanguageTag()) not in _tags:
        return None
    symbols = jvm.java.text.DecimalFormatSymbols.getInstance(locale)
    decimal, group = str(symbols.getDecimalSeparator()), str(symbols.getGroupingSeparator())
    if decimal not in ",." or not str(symbols.getZeroDigit()) == "0":
        return None  # numbers here have one of two separators and ASCII digits
    group = SPACES if group in SPACES else APOSTROPHES if group in APOSTROPHES else group
    style = jvm.java.text.DateFormat
    shape = style.getDateInstance(style.SHORT, locale).toPattern()
    fields = re.findall("y+|[ML]+|d+", shape)
    order = "".join({"y": "Y", "M": "M", "L": "M", "d": "D"}[f[0]] for f in fields)
    if sorted(order) != ["D", "M", "Y"]:
        return None
    between = re.search(r"(?:y+|[ML]+|d+)([^A-Za-z']+)(?:y+|[ML]+|d+)", shape)
    forms = jvm.java.time.format.TextStyle
    names = lambda form: [str(jvm.java.time.Month.of(i).getDisplayName(form, locale)).lower().rstrip(".") for i in range(1, 13)]
    months = names(forms.FULL)
    more = {n: i + 1 for form in (forms.SHORT, forms.FULL_STANDALONE, forms.SHORT_STANDALONE) for i, n in enumerate(names(form)) if not n.isdigit()}
    return Culture(str(locale.toLanguageTag()), decimal, group, between[1] if between else "-", order, tuple(months), tuple(sorted(more.items())))


def known(name: str | None) -> Culture | None:
    """The culture of that name, without regard to case: one of CULTURES, or one that the platform has."""
    low = (name or "").lower()
    found = {k.lower(): v for k, v in CULTURES.items()}.get(low)
    if found is None and low not in _found:
        made = _of_platform(name)
        if made is None:
            return None  # asked again once Spark runs
        _found[low] = made
    return found or _found.get(low)


def culture(name: str | None) -> Culture:
    found = known(name)
    if found is None:
        raise ValueError(f"unknown culture {name!r}; there are {', '.join(repr(k) for k in CULTURES)} and the platform's")
    return found


def read_numbers_alike(a: Culture, b: Culture) -> bool:
    """Twins: cultures whose number readings never differ, so one of them is evaluated."""
    return a.decimal == b.decimal and set(a.group) == set(b.group)
