"""Spreadsheets: sheets and typed cells of xlsx and ods packages, with the standard library only."""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import NamedTuple
from xml.etree import ElementTree

from ..errors import FormatError, LimitError

MAX_ROWS, MAX_COLUMNS, MAX_SHEETS = 1_048_576, 16_384, 4_096
KNOWN_CELLS = 200_000  # kept by their markup, as many cells are alike
MAX_UNCOMPRESSED = {"Xlsx": 2 << 30, "Ods": 8 << 30}

# The built-in number formats that show a date.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}


class Cell(NamedTuple):
    kind: str
    text: str | None = None
    num: float | None = None
    date: datetime | None = None


EMPTY = Cell("Empty")


@dataclass(frozen=True)
class Sheet:
    index: int
    name: str
    format: str
    source: str | None = None
    visibility: str = "Visible"


def text_cell(text: str | None) -> Cell:
    text = (text or "").strip()
    return Cell("Text", text) if text else EMPTY


def number_text(x: float) -> str:
    """The shortest text that reads back."""
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    r = repr(x)
    return r.upper().replace("E-0", "E-").replace("E+0", "E+") if "e" in r else r


def number_cell(x: float) -> Cell:
    return Cell("Number", number_text(x), x) if math.isfinite(x) else text_cell(str(x))


def date_cell(d: datetime) -> Cell:
    d = d.replace(tzinfo=None)
    plain = not (d.hour or d.minute or d.second or d.microsecond)
    return Cell("Date", d.strftime("%Y-%m-%d") if plain else d.strftime("%Y-%m-%dT%H:%M:%S"), None, d)


def from_serial(n: float, date1904: bool = False) -> datetime | None:
    """The 1900 system counts a day that never was: serial 60 is no date, earlier ones are a day later."""
    if not 0 <= n < 2_958_466 or (not date1904 and 60 <= n < 61):
        return None
    base = datetime(1904, 1, 1) if date1904 else datetime(1899, 12, 31) if n < 60 else datetime(1899, 12, 30)
    try:
        return base + timedelta(milliseconds=round(n * 86_400_000))
    except OverflowError:
        return None


def shows_a_date(code: str) -> bool:
    return bool(re.search("[ydhsm]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code), re.IGNORECASE))


def column_index(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    if n > MAX_COLUMNS:
        raise LimitError("limit.exceeded", ref)
    return n - 1


def unescaped(text: str) -> str:
    """_xHHHH_ escapes."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _package(data: bytes, kind: str, most: int | None = None) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise FormatError("format.corrupt", str(e)) from e
    if sum(i.file_size for i in z.infolist()) > (most or MAX_UNCOMPRESSED[kind]):
        raise LimitError("limit.exceeded", "the package holds too much")
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise FormatError("format.unsupported", "an encrypted package")
    return z


def _xml(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except KeyError as e:
        raise FormatError("format.corrupt", f"{name} is missing") from e
    except (ElementTree.ParseError, zipfile.BadZipFile) as e:
        raise FormatError("format.corrupt", f"{name}: {e}") from e


class _Unusual(Exception):
    """Markup that the patterns below don't read."""


_PLAIN_HEAD = re.compile(rb"""(?s)\s*(?:<\?xml[^>]*?(?:encoding=["']utf-8["'][^>]*)?\?>\s*)?<worksheet\b[^>]*>(?!.*<!)""", re.IGNORECASE)
_ROW = re.compile(rb"(?s)<row\b([^>]*?)(?:/>|>(.*?)</row>)")
_NUMBER_OF = re.compile(rb'\br="(\d+)"')
_LETTERS = re.compile(rb"[A-Z]+")
_CELL_REST = re.compile(rb'((?: [\w:]+="[^"]*")*)\s*(?:/>|>(?:<v>([^<]*)</v>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)')  # behind its reference
_ATTRIBUTE = re.compile(rb'(\w+)="([^"]*)"')
_columns: dict[bytes, int] = {}
# The entities of XML.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _entities(text: str) -> str:
    return re.sub(r"&(#x?[0-9A-Fa-f]+|[a-z]+);", lambda m: _NAMED.get(m[1]) or (chr(int(m[1][2:], 16)) if m[1][1:2] == "x" else chr(int(m[1][1:]))), text)


class Xlsx:
    """An xlsx workbook: `sheets`, and rows(i) as (row number, cells)."""

    def __init__(self, data: bytes, max_bytes: int | None = None, max_sheets: int = MAX_SHEETS):
        self.z = _package(data, "Xlsx", max_bytes)
        names = {n.lstrip("/"): n for n in self.z.namelist()}
        rels = self._relations("_rels/.rels") if "_rels/.rels" in names else {}
        book = next((t for kind, t in rels.values() if kind.endswith("/officeDocument")), "xl/workbook.xml")
        if book.endswith(".bin"):
            raise FormatError("format.unsupported", "a binary workbook")
        if book not in names:
            raise FormatError("format.corrupt", "no workbook part")
        self.base = book.rpartition("/")[0]
        own = f"{self.base}/_rels/{book.rpartition('/')[2]}.rels".lstrip("/")
        self.rels = self._relations(own) if own in names else {}
        root = _xml(self.z, book)
        self.date1904 = any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root)
        self.sheets, self.parts = [], []
        for e in root.iter():
            if _local(e.tag) != "sheet":
                continue
            rid = next((v for k, v in e.attrib.items() if _local(k) == "id"), None)
            kind, target = self.rels.get(rid, ("/worksheet", f"worksheets/sheet{len(self.sheets) + 1}.xml"))
            if not kind.endswith("/worksheet"):
                continue
            state = {"hidden": "Hidden", "veryHidden": "VeryHidden"}.get(e.get("state"), "Visible")
            self.sheets.append(Sheet(len(self.sheets), e.get("name") or f"Sheet{len(self.sheets) + 1}", "Xlsx", None, state))
            self.parts.append(target.lstrip("/") if target.startswith("/") else f"{self.base}/{target}".lstrip("/"))
            if len(self.sheets) > max_sheets:
                raise LimitError("limit.exceeded", f"more than {max_sheets} sheets")
        self._strings = self._dates = None
        self._shapes: dict[bytes, tuple[str, int]] = {}
        self._known: dict[bytes, Cell] = {}  # cells by their markup

    def _relations(self, name: str) -> dict[str, tuple[str, str]]:
        return {e.get("Id"): (e.get("Type", ""), e.get("Target", "").lstrip("/") if name == "_rels/.rels" else e.get("Target", "")) for e in _xml(self.z, name) if e.get("TargetMode") != "External"}

    def strings(self) -> list[str]:
        if self._strings is None:
            part = next((f"{self.base}/{t}" for kind, t in self.rels.values() if kind.endswith("/sharedStrings")), f"{self.base}/sharedStrings.xml")
            self._strings = []
            if part in self.z.namelist():
                for _, e in ElementTree.iterparse(self.z.open(part)):
                    if _local(e.tag) == "si":
                        self._strings.append(self._runs(e))
                        e.clear()
        return self._strings

    @staticmethod
    def _runs(e) -> str:
        """The text of a string item: its runs, without phonetic ones."""
        out = []
        for child in e:
            if _local(child.tag) == "t":
                out.append(child.text or "")
            elif _local(child.tag) == "r":
                out += [t.text or "" for t in child if _local(t.tag) == "t"]
        return unescaped("".join(out))

    def dates(self) -> list[bool]:
        """For each cell format, whether it shows a date."""
        if self._dates is None:
            part = next((f"{self.base}/{t}" for kind, t in self.rels.values() if kind.endswith("/styles")), f"{self.base}/styles.xml")
            self._dates = []
            if part in self.z.namelist():
                root = _xml(self.z, part)
                codes = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if _local(e.tag) == "numFmt"}
                for xfs in root:
                    if _local(xfs.tag) == "cellXfs":
                        ids = [int(e.get("numFmtId", 0)) for e in xfs]
                        self._dates = [shows_a_date(codes[i]) if i in codes else i in DATE_FORMATS for i in ids]
        return self._dates

    def rows(self, index: int) -> Iterator[tuple[int, list[Cell]]]:
        """Rows as most producers write them are matched by patterns; any other row, or markup, goes through a parser."""
        part = self.parts[index]
        if part not in self.z.namelist():
            raise FormatError("format.corrupt", f"{part} is missing")
        try:
            with self.z.open(part) as f:
                plain = _PLAIN_HEAD.match(f.read(1 << 16)) is not None
        except zipfile.BadZipFile as e:
            raise FormatError("format.corrupt", str(e)) from e
        yield from self._plain_rows(part) if plain else self._parsed_rows(part)

    def _plain_rows(self, part: str) -> Iterator[tuple[int, list[Cell]]]:
        last, held, begun = 0, b"", False
        try:
            with self.z.open(part) as f:
                while True:
                    block = f.read(1 << 22)
                    held += block
                    if not begun:
                        at = held.find(b"<sheetData")
                        if at < 0:
                            if block:
                                continue
                            break
                        close = held.find(b">", at)
                        if close < 0 and block:
                            continue
                        if held[close - 1 : close] == b"/":
                            break  # no rows at all
                        held, begun = held[close + 1 :], True
                    if b"<!" in held:
                        raise _Unusual
                    cut = held.rfind(b"</row>") + 6
                    if cut == 5 and block:
                        continue
                    for attributes, body in self._split_rows(held[:cut] if block else held):
                        number = _NUMBER_OF.search(attributes)
                        last = int(number[1]) if number and last < int(number[1]) <= MAX_ROWS else last + 1
                        cells = self._plain_cells(body)
                        if cells is None:
                            cells = self._cells(ElementTree.fromstring(b"<row xmlns:x='x' xmlns:r='r' xmlns:x14ac='a'>" + body + b"</row>"))
                        yield last, cells
                    end = held.find(b"</sheetData>", max(0, cut - 1))
                    if end >= 0:
                        break
                    if not block:
                        raise FormatError("format.truncated", f"{part} ends early")
                    held = held[cut:]
                while f.read(1 << 20):  # to the end, where the checksum is
                    pass
        except _Unusual:
            yield from (x for x in self._parsed_rows(part) if x[0] > last)
        except ElementTree.ParseError as e:
            raise FormatError("format.corrupt", str(e)) from e
        except (zipfile.BadZipFile, EOFError) as e:
            raise FormatError("format.corrupt", str(e)) from e

    @staticmethod
    def _split_rows(markup: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(attributes, cells) of each row."""
        parts = markup.split(b"</row>")
        rest = parts.pop()
        for part in parts:
            at = part.find(b">")
            if part.startswith(b"<row ") and part[at - 1 : at] != b"/" and part.find(b"<row", 4) < 0:
                yield part[4:at], part[at + 1 :]
            else:
                yield from _ROW.findall(part + b"</row>")
        yield from _ROW.findall(rest)

    def _plain_cells(self, body: bytes) -> list[Cell] | None:
        """A row's cells; None if they aren't all of the usual form."""
        cells: list[Cell] = []
        known = self._known
        parts = body.split(b"<c ")
        if parts.pop(0):
            return None
        for part in parts:
            at = part.find(b'"', 3)
            if at < 0 or not part.startswith(b'r="'):
                return None
            rest, ref = part[at + 1 :], part[3:at].rstrip(b"0123456789")
            c = known.get(rest)
            if c is None:
                m = _CELL_REST.fullmatch(rest)
                if m is None:
                    return None
                c = self._plain_cell(*m.groups(b"")) if m[2] or m[3] else EMPTY
                if c is None:
                    return None
                if len(known) < KNOWN_CELLS:
                    known[rest] = c
            i = _columns.get(ref)
            if i is None:
                if not _LETTERS.fullmatch(ref):
                    return None
                i = _columns[ref] = column_index(ref.decode())
            if c is EMPTY and i >= len(cells):
                continue
            if i == len(cells):
                cells.append(c)
            else:
                if i > len(cells):
                    cells += [EMPTY] * (i + 1 - len(cells))
                cells[i] = c
        while cells and cells[-1] is EMPTY:
            cells.pop()
        return cells

    def _plain_cell(self, attributes: bytes, value: bytes, text: bytes) -> Cell | None:
        shape = self._shapes.get(attributes)
        if shape is None:
            found = dict(_ATTRIBUTE.findall(attributes))
            shape = self._shapes[attributes] = (found.get(b"t", b"n").decode(), int(found.get(b"s", b"0") or 0))
        v = (value or text).decode("utf-8", "replace")
        if "&" in v:
            v = _entities(v)
        if not text:
            return self._value(shape[0], v, shape[1])
        return None if "\r" in v else text_cell(unescaped(v))  # a parser folds line ends

    def _parsed_rows(self, part: str) -> Iterator[tuple[int, list[Cell]]]:
        last, closed = 0, False
        try:
            for _, e in ElementTree.iterparse(self.z.open(part)):
                tag = _local(e.tag)
                if tag == "row":
                    r = e.get("r")
                    last = int(r) if r and r.isdigit() and last < int(r) <= MAX_ROWS else last + 1
                    yield last, self._cells(e)
                    e.clear()
                elif tag == "sheetData":
                    closed = True
        except ElementTree.ParseError as e:
            raise FormatError("format.corrupt" if closed else "format.truncated", str(e)) from e
        except zipfile.BadZipFile as e:
            raise FormatError("format.corrupt", str(e)) from e

    def _cells(self, row) -> list[Cell]:
        cells: list[Cell] = []
        for c in row:
            if _local(c.tag) == "c":
                i = column_index(c.get("r")) if c.get("r") else len(cells)
                cells += [EMPTY] * (i + 1 - len(cells))
                cells[i] = self._cell(c)
        while cells and cells[-1] is EMPTY:
            cells.pop()
        return cells

    def _cell(self, c) -> Cell:
        kind, v = c.get("t"), None
        for child in c:
            if _local(child.tag) == "v":
                v = child.text
            elif _local(child.tag) == "is":
                return text_cell(self._runs(child))
        return EMPTY if v is None else self._value(kind or "n", v, int(c.get("s") or 0))

    def _value(self, kind: str, v: str, style: int) -> Cell:
        """A cell of a stated type."""
        if kind == "s":
            s = self.strings()
            return text_cell(s[int(v)]) if v.strip().isdigit() and int(v) < len(s) else EMPTY
        if kind in ("str", "inlineStr"):
            return text_cell(unescaped(v))
        if kind == "b":
            return Cell("Boolean", "true" if v.strip() in ("1", "true") else "false")
        if kind == "e":
            return Cell("Error", v.strip())
        if kind == "d":
            t = v.strip().rstrip("Z")
            try:
                if re.match(r"\d{2}:\d{2}", t):
                    t = f"{'1904-01-01' if self.date1904 else '1899-12-31'}T{t}"
                return date_cell(datetime.fromisoformat(t))
            except ValueError:
                return text_cell(v)
        try:
            x = float(v)
        except ValueError:
            return text_cell(v)
        if not math.isfinite(x):
            return text_cell(v)
        if style < len(self.dates()) and self.dates()[style] and (d := from_serial(x, self.date1904)):
            return date_cell(d)
        return number_cell(x)


_DURATION = re.compile(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def from_duration(text: str, null_date: datetime | None = None) -> datetime | None:
    """A duration as a time after the day before the calendar begins (after a day or more, after day zero)."""
    m = _DURATION.fullmatch(text.strip())
    if not m or m[1] or text.strip() in ("P", "PT", "-P"):
        return None
    y, mo, d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    y, mo = y + mo // 12, mo % 12
    span = timedelta(days=y * 365 + mo * 30 + d, hours=h, minutes=mi, seconds=s)
    base = null_date or (datetime(1899, 12, 31) if span < timedelta(days=1) else datetime(1899, 12, 30))
    try:
        return base + span
    except OverflowError:
        return None


_TABLE = re.compile(rb'<table:table(?=[\s/>])((?:\s+[\w:.-]+="[^"<]*")*)\s*(/?)>|</table:table>')
_TABLE_MARK = re.compile(rb"</?table:table(?![\w.:-])")
_TABLE_ROW = re.compile(rb"""(?s)<table:table-row(?=[\s/>])((?:\s+[\w:.-]+="[^"<]*")*)\s*(?:/>|>(.*?)</table:table-row>)""")
_TABLE_ROW_MARK = re.compile(rb"<table:table-row(?=[\s/>])")
_TABLE_CELL = re.compile(rb'<table:(?:covered-)?table-cell(?:\s+[\w:.-]+="[^"<]*")*\s*(?:/>|>(?:<text:p>[^<]*</text:p>)*</table:(?:covered-)?table-cell>)')
_FLOAT_CELL = re.compile(rb'<table:table-cell(?: table:style-name="[^"<]*")? office:value-type="float" office:value="([-+.\deE]+)"(?: calcext:value-type="float")?(?:/>|><text:p>[^<&]*</text:p></table:table-cell>)')
_ODS_HEAD = re.compile(rb"""(?s)\s*(?:<\?xml(?![^>]*encoding=["'](?!(?i:utf-8)["']))[^>]*\?>\s*)?<office:document-content((?:\s+[\w:.-]+="[^"<]*")*)\s*>(?!.*<[!?])""")
_ODS_PREFIXES = [f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"'.encode() for p in ("office", "table", "text")]
_ODS_END = re.compile(rb"</office:document-content\s*>\s*")
MAX_ODS_HEAD = 16 << 20  # bytes before the first sheet; a longer head goes through the parser


class Ods:
    """An OpenDocument spreadsheet: `sheets`, and rows(i) as (row number, cells)."""

    def __init__(self, data: bytes, max_bytes: int | None = None, max_sheets: int = MAX_SHEETS):
        self.z = _package(data, "Ods", max_bytes)
        if "content.xml" not in self.z.namelist():
            raise FormatError("format.corrupt", "content.xml is missing")
        self._known: dict[bytes, tuple[Cell, int]] = {}  # cells by their markup, and how often each is repeated
        self._wrapper = b""
        try:
            self._plain = self._plain_sheets(max_sheets)
        except _Unusual:
            self._plain = False
        except (zipfile.BadZipFile, EOFError, zlib.error) as e:
            raise FormatError("format.corrupt", str(e)) from e
        if self._plain:
            return
        self.sheets, depth, hidden, style = [], 0, set(), None
        try:
            for event, e in ElementTree.iterparse(self.z.open("content.xml"), ("start", "end")):
                tag = _local(e.tag)
                if event == "start" and tag == "style":
                    style = self._get(e, "name")
                elif event == "start" and tag == "table-properties" and self._get(e, "display") == "false":
                    hidden.add(style)
                elif tag == "table":
                    if event == "start" and not depth:
                        seen = "Hidden" if self._get(e, "style-name") in hidden else "Visible"
                        self.sheets.append(Sheet(len(self.sheets), self._get(e, "name") or f"Sheet{len(self.sheets) + 1}", "Ods", None, seen))
                        if len(self.sheets) > max_sheets:
                            raise LimitError("limit.exceeded", f"more than {max_sheets} sheets")
                    depth += 1 if event == "start" else -1
                elif event == "end" and tag == "table-row":
                    e.clear()
        except ElementTree.ParseError as e:
            raise FormatError("format.corrupt", str(e)) from e

    def _plain_sheets(self, max_sheets: int) -> bool:
        """Lists the sheets by their tags alone; _Unusual unless all of the content is of the form that the patterns read."""
        self.sheets, held, hidden, inside, end = [], b"", None, False, b""
        with self.z.open("content.xml") as f:
            while block := f.read(1 << 22):
                held += block
                if hidden is None:
                    at = _TABLE_MARK.search(held)
                    if at is None and len(held) < MAX_ODS_HEAD:
                        continue
                    head = _ODS_HEAD.match(held[: at.start()]) if at else None
                    if head is None or not all(p in head[1] for p in _ODS_PREFIXES):
                        raise _Unusual
                    self._wrapper = b"<r" + b"".join(re.findall(rb'\s+xmlns(?::[\w.-]+)?="[^"<]*"', head[1])) + b">"
                    hidden, held = self._hidden(held[: at.start()]), held[at.start() :]
                cut = held.rfind(b"<")  # no tag, text or value holds one
                if cut < 0:
                    continue
                part, held = held[:cut], held[cut:]
                if b"<!" in part or b"<?" in part:
                    raise _Unusual
                tags = list(_TABLE.finditer(part))
                if len(tags) != len(_TABLE_MARK.findall(part)):
                    raise _Unusual
                for m in tags:
                    opens = m[1] is not None
                    if opens == inside:
                        raise _Unusual  # tables within tables, or an end without a beginning
                    inside = opens and not m[2]
                    if opens:
                        e = self._element(b"<table:table" + m[1] + b"/>")
                        self.sheets.append(Sheet(len(self.sheets), self._get(e, "name") or f"Sheet{len(self.sheets) + 1}", "Ods", None, "Hidden" if self._get(e, "style-name") in hidden else "Visible"))
                        if len(self.sheets) > max_sheets:
                            raise LimitError("limit.exceeded", f"more than {max_sheets} sheets")
        if hidden is None or inside or not _ODS_END.fullmatch(held):
            raise _Unusual
        return True

    def _hidden(self, head: bytes) -> set[str | None]:
        """The styles of sheets that aren't shown."""
        hidden, style, parser = set(), None, ElementTree.XMLPullParser(("start",))
        try:
            parser.feed(head)
        except ElementTree.ParseError as e:
            raise _Unusual from e
        for _, e in parser.read_events():
            if _local(e.tag) == "style":
                style = self._get(e, "name")
            elif _local(e.tag) == "table-properties" and self._get(e, "display") == "false":
                hidden.add(style)
        return hidden

    def _element(self, markup: bytes):
        try:
            return ElementTree.fromstring(self._wrapper + markup + b"</r>")[0]
        except (ElementTree.ParseError, IndexError) as e:
            raise _Unusual from e

    @staticmethod
    def _get(e, name: str) -> str | None:
        return next((v for k, v in e.attrib.items() if _local(k) == name), None)

    def _repeat(self, e, name: str) -> int:
        v = self._get(e, name)
        if v is None:
            return 1
        if not v.isdigit() or int(v) < 1:
            raise FormatError("format.corrupt", f"{name}={v}")
        return int(v)

    def rows(self, index: int) -> Iterator[tuple[int, list[Cell]]]:
        """Rows as most producers write them are matched by patterns; any other goes through a parser."""
        last = 0
        if self._plain:
            try:
                for last, cells in self._plain_rows(index):
                    yield last, cells
                return
            except _Unusual:
                pass
            except (zipfile.BadZipFile, EOFError, zlib.error) as e:
                raise FormatError("format.corrupt", str(e)) from e
        try:
            yield from (x for x in self._parsed_rows(index) if x[0] > last)
        except ElementTree.ParseError as e:
            raise FormatError("format.corrupt", str(e)) from e

    def _plain_rows(self, index: int) -> Iterator[tuple[int, list[Cell]]]:
        at, held, number, inside = -1, b"", 0, False
        with self.z.open("content.xml") as f:
            while block := f.read(1 << 22):
                held += block
                while not inside:
                    m = _TABLE.search(held)
                    if m is None:
                        held = held[max(0, held.rfind(b"<")) :]
                        break
                    held = held[m.end() :]
                    at += m[1] is not None
                    if at == index:
                        if m[2] or m[1] is None:
                            return
                        inside = True
                if not inside:
                    continue
                end = held.find(b"</table:table>")
                cut = end if end >= 0 else held.rfind(b"</table:table-row>") + 18
                if cut == 17:
                    continue
                for attributes, body in self._split_rows(held[:cut]):
                    times = self._repeat(self._element(b"<table:table-row" + attributes + b"/>"), "number-rows-repeated") if b"number-rows-repeated" in attributes else 1
                    cells = self._plain_cells(body)
                    if cells:
                        for k in range(times):
                            if number + k >= MAX_ROWS:
                                raise LimitError("limit.exceeded", f"more than {MAX_ROWS} rows")
                            yield number + k + 1, cells
                    number += times
                if end >= 0:
                    return
                held = held[cut:]

    @staticmethod
    def _split_rows(markup: bytes) -> Iterator[tuple[bytes, bytes]]:
        """(attributes, cells) of each row; _Unusual if one isn't told apart."""
        parts = markup.split(b"</table:table-row>")
        rest = parts.pop()
        for part in parts:
            if part.startswith(b"<table:table-row>") and part.find(b"<table:table-row", 17) < 0:
                yield b"", part[17:]
            else:
                yield from Ods._matched_rows(part + b"</table:table-row>")
        yield from Ods._matched_rows(rest)

    @staticmethod
    def _matched_rows(markup: bytes) -> list[tuple[bytes, bytes]]:
        found = _TABLE_ROW.findall(markup)
        if len(found) != len(_TABLE_ROW_MARK.findall(markup)):
            raise _Unusual
        return found

    def _plain_cells(self, body: bytes) -> list[Cell]:
        """A row's cells; a cell that isn't of the usual form sends its row to a parser."""
        out, waiting, known = [], 0, self._known
        parts = body.split(b"<table:")
        plain = not parts.pop(0)
        for part in parts if plain else ():
            found = known.get(part)
            if found is None:
                markup = b"<table:" + part
                if m := _FLOAT_CELL.fullmatch(markup):
                    try:
                        x = float(m[1])
                    except ValueError:
                        x = math.nan
                    if math.isfinite(x):
                        out += [EMPTY] * waiting + [number_cell(x)]
                        waiting = 0
                        continue
                if _TABLE_CELL.fullmatch(markup) is None:
                    plain = False
                    break
                c = self._element(markup)
                found = (EMPTY if _local(c.tag).startswith("covered") else self._cell(c)), self._repeat(c, "number-columns-repeated")
                if len(known) < KNOWN_CELLS:
                    known[part] = found
            cell, times = found
            if cell is EMPTY:
                waiting += times
                continue
            if len(out) + waiting + times > MAX_COLUMNS:
                raise LimitError("limit.exceeded", f"more than {MAX_COLUMNS} columns")
            if waiting or times > 1:
                out += [EMPTY] * waiting + [cell] * times
                waiting = 0
            else:
                out.append(cell)
        if not plain:
            return self._cells(self._element(b"<table:table-row>" + body + b"</table:table-row>"))
        if len(out) > MAX_COLUMNS:
            raise LimitError("limit.exceeded", f"more than {MAX_COLUMNS} columns")
        return out

    def _parsed_rows(self, index: int) -> Iterator[tuple[int, list[Cell]]]:
        at, depth, number = -1, 0, 0
        for event, e in ElementTree.iterparse(self.z.open("content.xml"), ("start", "end")):
            tag = _local(e.tag)
            if tag == "table":
                if event == "start":
                    at += depth == 0
                    depth += 1
                else:
                    depth -= 1
                    if not depth and at == index:
                        return
            elif tag == "table-row" and event == "end" and depth == 1:
                if at == index:
                    times, cells = self._repeat(e, "number-rows-repeated"), self._cells(e)
                    if cells:
                        for k in range(times):
                            if number + k >= MAX_ROWS:
                                raise LimitError("limit.exceeded", f"more than {MAX_ROWS} rows")
                            yield number + k + 1, cells
                    number += times
                e.clear()

    def _cells(self, row) -> list[Cell]:
        out, waiting = [], 0
        for c in row:
            tag = _local(c.tag)
            if tag not in ("table-cell", "covered-table-cell"):
                continue
            cell, times = (EMPTY if tag.startswith("covered") else self._cell(c)), self._repeat(c, "number-columns-repeated")
            if cell is EMPTY:
                waiting += times
                continue
            if len(out) + waiting + times > MAX_COLUMNS:
                raise LimitError("limit.exceeded", f"more than {MAX_COLUMNS} columns")
            out += [EMPTY] * waiting + [cell] * times
            waiting = 0
        return out

    @staticmethod
    def _says_error(c) -> bool:
        """A failed formula is an empty text, and an error by an attribute of the producer's extension."""
        return any(k.endswith("}value-type") and "extension" in k or k == "calcext:value-type" for k, v in c.attrib.items() if v == "error")

    def _cell(self, c) -> Cell:
        kind, value = next((v for k, v in c.attrib.items() if _local(k) == "value-type" and "ext" not in k), None), self._get(c, "value")
        try:
            if self._says_error(c):
                return Cell("Error", text_cell("\n".join(self._folded(p) for p in c if _local(p.tag) in ("p", "h"))).text or "#ERROR")
            if kind in ("float", "percentage", "currency") and value is not None and math.isfinite(float(value)):
                return number_cell(float(value))
            if kind == "date" and (d := self._get(c, "date-value")) and d.find("-") >= 4:
                return date_cell(datetime.fromisoformat(d.rstrip("Z")))
            if kind == "time" and (t := from_duration(self._get(c, "time-value") or "")):
                return date_cell(t)
            if kind == "boolean":
                return Cell("Boolean", "true" if self._get(c, "boolean-value") == "true" else "false")
        except ValueError:
            pass
        text = self._get(c, "string-value")
        if text is None:
            text = "\n".join(self._folded(p) for p in c if _local(p.tag) in ("p", "h"))
        return text_cell(text)

    def _folded(self, e) -> str:
        """A paragraph's text: white space folded, then spaces, tabs and breaks as their own elements say."""
        out = [re.sub(r"[ \t\r\n]+", " ", e.text or "")]
        for c in e:
            tag = _local(c.tag)
            if tag == "s":
                out.append(" " * int(self._get(c, "c") or 1))
            elif tag == "tab":
                out.append("\t")
            elif tag == "line-break":
                out.append("\n")
            elif tag != "annotation":
                out.append(self._folded(c))
            out.append(re.sub(r"[ \t\r\n]+", " ", c.tail or ""))
        return "".join(out)
