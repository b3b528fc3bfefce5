"""One-file exports: xlsx, ods, and zip archives of csv sheets.

A sheet's rows are sorted once; executors check every value, render their rows as markup (a projection), and compress it
in pieces that the driver only strings together. Styles are enumerated before rows are rendered, as rules name them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteError
from ..sources.workbooks import MAX_ROWS
from .checks import DATES, NOT_IN_XML, check_headers, first_problem, problem
from .csv import CsvOptions, checked, header_line, lines
from .formats import color, date_format, number_format, number_parts
from .package import Package, piece, whole

MAX_STYLES, MAX_MERGES, MAX_WIDTH = 4_096, 65_536, 255
_DEVICES = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


@dataclass(frozen=True)
class Style:
    fill: str | None = None  # RRGGBB
    bold: bool = False
    italic: bool = False
    color: str | None = None
    number_format: str | None = None  # of numbers, or of dates
    align: str | None = None
    wrap: bool = False
    border: bool = False

    def __post_init__(self):
        for name in ("fill", "color"):
            if getattr(self, name):
                object.__setattr__(self, name, color(getattr(self, name)))
        if self.number_format and not self.of_numbers:
            date_format(self.number_format)
        if self.align not in (None, "left", "center", "right"):
            raise ValueError(f"{self.align!r} is no alignment")

    @property
    def of_numbers(self) -> bool:
        try:
            return bool(self.number_format and number_format(self.number_format))
        except ValueError:
            return False


@dataclass
class SheetOut:
    name: str
    df: DataFrame
    row: str
    freeze_rows: int = 0
    freeze_columns: int = 0
    auto_filter: bool = False
    header_style: Style | None = None
    styles: dict[str, Style] = field(default_factory=dict)  # by column
    rules: dict[str, str] = field(default_factory=dict)  # column -> column that names each cell's style
    named: dict[str, Style] = field(default_factory=dict)  # the styles that rules name; null or another name means none
    widths: dict[str, float] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)  # first row, first column, rows, columns
    partitions: int | None = None  # in which rows are sorted and rendered, each a job; else as Spark is set

    @property
    def fields(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if f.name != self.row and f.name not in self.rules.values()]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def width(self, column: str) -> float:
        return self.widths.get(column, max(9, min(MAX_WIDTH, len(column) + 2)))


def sheet_of(spark: SparkSession, name: str, source: Iterable, headers: list[str] | None = None, **layout) -> SheetOut:
    """A sheet of rows on the driver: tuples or dicts, or columnar batches (Arrow tables or record batches)."""
    items = list(source)
    if items and isinstance(items[0], (pa.Table, pa.RecordBatch)):
        data = pa.concat_tables([pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in items])
    else:
        rows = [dict(zip(headers or [], x, strict=True)) if not isinstance(x, dict) else x for x in items]
        data = pa.Table.from_pylist(rows) if rows else pa.table({h: pa.array([], pa.string()) for h in headers or []})
    data = data.rename_columns(headers) if headers else data
    return SheetOut(name, spark.createDataFrame(data.append_column("row_number", pa.array(range(data.num_rows), pa.int64()))), "row_number", **layout)


def letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def check_names(sheets: list[SheetOut], archive: bool = False) -> None:
    seen = set()
    for s in sheets:
        n = s.name
        bad = not n.strip() or len(n) > 31 or re.search(r"[\[\]:*?/\\\x00-\x1f]", n) or re.search(NOT_IN_XML, n) or n.startswith("'") or n.endswith("'") or n.lower() == "history"
        bad = bad or (archive and (re.search(r'[<>"|]', n) or n[-1] in ". " or n.split(".")[0].lower() in _DEVICES))
        if bad or n.lower() in seen:
            raise WriteError("write.sheet-name", n)
        seen.add(n.lower())
        check_headers(s.columns)
        for w in s.widths.values():
            if not 0 < w <= MAX_WIDTH:
                raise WriteError("write.column-width", str(w))
        taken = set()
        if len(s.merges) > MAX_MERGES:
            raise WriteError("write.too-many-merges", n)
        for r, c, h, w in s.merges:
            cells = {(r + i, c + j) for i in range(h) for j in range(w)}
            if r < 1 or c < 0 or c + w > len(s.columns) or taken & cells:
                raise WriteError("write.merge", f"{n}: {r},{c}")
            taken |= cells


class _Styles:
    """Every style that a workbook uses, by number: 0 none, 1 a date, 2 a date with a time, then the declared ones."""

    def __init__(self, sheets: list[SheetOut]):
        self.at: dict[tuple[Style, str], int] = {(Style(), ""): 0, (Style(), "date"): 1, (Style(), "time"): 2}
        for s in sheets:
            self.of(s.header_style, "")
            for f in s.fields:
                for own in (s.styles.get(f.name), *(s.named.values() if f.name in s.rules else ())):
                    for kind in ("date", "time") if isinstance(f.dataType, DATES) else ("",):
                        self.of(own, kind)

    def of(self, style: Style | None, kind: str) -> int:
        key = (style or Style(), kind)
        if key not in self.at and len(self.at) >= MAX_STYLES:
            raise WriteError("write.too-many-styles", "")
        return self.at.setdefault(key, len(self.at))

    def column(self, s: SheetOut, f: T.StructField, kind: str) -> Column:
        """The number of a cell's style, as text."""
        own = F.lit(str(self.of(s.styles.get(f.name), kind)))
        if f.name not in s.rules or not s.named:
            return own
        named = F.create_map(*[F.lit(x) for n, style in s.named.items() for x in (n, str(self.of(style, kind)))])
        return F.coalesce(F.try_element_at(named, F.col(f"`{s.rules[f.name]}`")), own)


def _ordered(df: DataFrame, row: str, partitions: int | None = None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(persisted rows in order of row, with __at that grows along them, the rows of each partition)."""
    rows = (df.repartitionByRange(partitions, f"`{row}`").sortWithinPartitions(f"`{row}`") if partitions else df.orderBy(f"`{row}`")).withColumn("__at", F.monotonically_increasing_id()).persist()
    per = rows.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a partition
    return rows, sorted((r["part"], r["n"]) for r in per)


def dealt(df: DataFrame, row: str, most: int) -> tuple[list[DataFrame], DataFrame]:
    """(df in order of row as frames of most rows, the last one of fewer, what is persisted for them). Rows are counted, so
    keys that are null, repeated or far apart make no frame larger."""
    rows, per = _ordered(df, row)
    cuts, n = [], 0
    for part, own in per:
        cuts += [(part << 33) + k - n for k in range(-(-n // most) * most, n + own, most)]
        n += own
    at = F.col("__at")
    return [rows.where((at >= cut) & (at < end) if end else at >= cut).drop("__at") for cut, end in zip(cuts, [*cuts[1:], None], strict=True)], rows


def _numbered(s: SheetOut) -> tuple[DataFrame, int]:
    """(rows in order with their number in the sheet as __n, number of rows). The header is row 1."""
    rows, per = _ordered(s.df, s.row, s.partitions)
    starts, n = [], 2
    for part, own in per:
        starts.append((part, n))
        n += own
    if n - 1 > MAX_ROWS:
        rows.unpersist()
        raise WriteError("write.too-many-rows", s.name)
    start = s.df.sparkSession.createDataFrame(starts, "__part long, __start long")
    numbered = rows.join(F.broadcast(start), F.shiftright("__at", 33) == F.col("__part")).withColumn("__n", F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1))
    numbered._rows = rows
    return numbered, n - 2


def _pieces(text: DataFrame, level: int):
    """The single string column of text in order, compressed by executors: an Arrow column's strings lie one after the other."""

    def run(batches):
        for b in batches:
            c = b.column(0).cast(pa.large_string())
            at, data = c.buffers()[1], c.buffers()[2]
            if not len(c) or data is None:
                continue
            ends = memoryview(at).cast("B").cast("q")
            raw = memoryview(data)[ends[c.offset] : ends[c.offset + len(c)]]
            packed, crc, n = piece(raw, level)
            yield pa.record_batch([pa.array([packed], pa.binary()), pa.array([crc], pa.int64()), pa.array([n], pa.int64())], ["data", "crc", "n"])

    for r in text.mapInArrow(run, "data binary, crc long, n long").toLocalIterator(prefetchPartitions=True):
        yield bytes(r["data"]), r["crc"], r["n"]


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _number(f: T.StructField) -> Column:
    return F.col(f"`{f.name}`").cast("string")


def _has_time(t: Column) -> Column:
    return F.date_trunc("day", t) != t


def _millis(f: T.StructField) -> Column:
    """A date cut to milliseconds, never rounded."""
    t = F.col(f"`{f.name}`").cast("timestamp_ntz")
    return t if isinstance(f.dataType, T.DateType) else F.date_trunc("millisecond", t)


def write_zip_of_csv(path: str, sheets: list[SheetOut], options: CsvOptions = CsvOptions(), level: int = 1) -> dict[str, int]:
    """The rows of each sheet that were written."""
    check_names(sheets, archive=True)
    out = {}
    with whole(path, level) as z:
        for s in sheets:
            df = s.df.select(s.row, *[f"`{c}`" for c in s.columns])
            out[s.name] = checked(df, s.row, options)
            text = lines(df.orderBy(f"`{s.row}`"), s.row, options).select(F.concat("value", F.lit("\r\n")).alias("value"))
            head = ("﻿" if options.byte_order_mark else "") + header_line(s.columns, options.resolved()) + "\r\n"
            z.stream(f"{s.name}.csv", _with(head, _pieces(text, level), ""))
    return out


def _with(head: str, pieces, tail: str):
    yield head
    yield from pieces
    if tail:
        yield tail


def _sheet(z: Package, name: str | None, s: SheetOut, row: Column, head: str, tail, form: str, level: int) -> tuple[int, object]:
    """Checks and renders a sheet: its number of rows, and its pieces."""
    rows, n = _numbered(s)
    try:
        first_problem(s.df, s.row, {f.name: problem(f, form) for f in s.fields})
        if any(r + h - 1 > n + 1 for r, _, h, _ in s.merges):
            raise WriteError("write.merge", s.name)
        text = rows.select(row.alias("value"), "__at")
        pieces = _with(head, _pieces(text.select("value"), level), tail(n))
        if name is None:
            return n, list(pieces)
        z.stream(name, pieces)
        return n, None
    finally:
        rows._rows.unpersist()


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _xlsx_text(text: Column) -> Column:
    return F.replace(_escaped(F.regexp_replace(text, "_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")), F.lit("\r"), F.lit("_x000D_"))


def _xlsx_cell(s: SheetOut, i: int, f: T.StructField, styles: _Styles) -> Column:
    c, t, at = F.col(f"`{f.name}`"), f.dataType, F.concat(F.lit(f'<c r="{letters(i)}'), F.col("__n").cast("string"))
    style = lambda kind="": styles.column(s, f, kind)
    if isinstance(t, T.BooleanType):
        body = F.concat(at, F.lit('" t="b" s="'), style(), F.lit('"><v>'), c.cast("int").cast("string"), F.lit("</v></c>"))
    elif isinstance(t, T.NumericType):
        body = F.concat(at, F.lit('" s="'), style(), F.lit('"><v>'), _number(f), F.lit("</v></c>"))
    elif isinstance(t, DATES):
        m = _millis(f)
        days = F.datediff(m, F.lit("1899-12-30").cast("date")).cast("double")
        days = F.when(days < 61, days - 1).otherwise(days)
        part = (F.hour(m) * 3_600_000 + F.minute(m) * 60_000 + F.floor(F.date_format(m, "ssSSS").cast("int"))) / F.lit(86_400_000.0)
        kind = F.when(_has_time(m), style("time")).otherwise(style("date")) if not isinstance(t, T.DateType) else style("date")
        body = F.concat(at, F.lit('" s="'), kind, F.lit('"><v>'), (days if isinstance(t, T.DateType) else days + part).cast("string"), F.lit("</v></c>"))
    else:
        body = F.concat(at, F.lit('" t="inlineStr" s="'), style(), F.lit('"><is><t xml:space="preserve">'), _xlsx_text(c.cast("string")), F.lit("</t></is></c>"))
    return F.coalesce(body, F.lit(""))


def write_xlsx(path: str, sheets: list[SheetOut], level: int = 1) -> dict[str, int]:
    """The rows of each sheet that were written."""
    check_names(sheets)
    styles, out = _Styles(sheets), {}

    def text(v: str) -> str:
        return escape(re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", v)).replace("\r", "_x000D_")

    with whole(path, level) as z:
        for k, s in enumerate(sheets):
            head = f'<?xml version="1.0" encoding="UTF-8"?><worksheet {_MAIN}>'
            if s.freeze_rows or s.freeze_columns:
                at = f"{letters(s.freeze_columns)}{s.freeze_rows + 1}"
                head += f'<sheetViews><sheetView workbookViewId="0"><pane{f" xSplit=\"{s.freeze_columns}\"" if s.freeze_columns else ""}{f" ySplit=\"{s.freeze_rows}\"" if s.freeze_rows else ""} topLeftCell="{at}" state="frozen"/></sheetView></sheetViews>'
            head += "<cols>" + "".join(f'<col min="{i + 1}" max="{i + 1}" width="{s.width(c)}" customWidth="1"/>' for i, c in enumerate(s.columns)) + "</cols><sheetData>"
            top = styles.of(s.header_style, "")
            head += '<row r="1">' + "".join(f'<c r="{letters(i)}1" t="inlineStr" s="{top}"><is><t xml:space="preserve">{text(c)}</t></is></c>' for i, c in enumerate(s.columns)) + "</row>"
            row = F.concat(F.lit('<row r="'), F.col("__n").cast("string"), F.lit('">'), *[_xlsx_cell(s, i, f, styles) for i, f in enumerate(s.fields)], F.lit("</row>"))

            def tail(n: int, s=s) -> str:
                own = f'<autoFilter ref="A1:{letters(len(s.columns) - 1)}{n + 1}"/>' if s.auto_filter else ""
                if s.merges:
                    own += f'<mergeCells count="{len(s.merges)}">' + "".join(f'<mergeCell ref="{letters(c)}{r}:{letters(c + w - 1)}{r + h - 1}"/>' for r, c, h, w in s.merges) + "</mergeCells>"
                return f"</sheetData>{own}</worksheet>"

            out[s.name], _ = _sheet(z, f"xl/worksheets/sheet{k + 1}.xml", s, row, head, tail, "xlsx", level)
        z.add("xl/styles.xml", _xlsx_styles(styles.at))
        z.add("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {_MAIN} xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(s.name)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>")
        own = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.add("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{own}">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets))) + f'<Relationship Id="rIdS" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.add("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{own}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.add("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(len(sheets))) + "</Types>")
    return out


def _xlsx_styles(styles: dict[tuple[Style, str], int]) -> str:
    formats, fonts, fills, borders, xfs = {"yyyy\\-mm\\-dd": 164, "yyyy\\-mm\\-dd hh:mm:ss": 165}, ["<font/>"], ["<fill><patternFill patternType=\"none\"/></fill>", "<fill><patternFill patternType=\"gray125\"/></fill>"], ["<border/>"], []

    def at(items: list[str], x: str) -> int:
        if x not in items:
            items.append(x)
        return items.index(x)

    for s, kind in styles:
        own = s.number_format if s.number_format and s.of_numbers == (kind == "") else None
        code = own or {"date": "yyyy\\-mm\\-dd", "time": "yyyy\\-mm\\-dd hh:mm:ss"}.get(kind)
        num = formats.setdefault(code, 164 + len(formats)) if code else 0
        font = at(fonts, "<font>" + "<b/>" * s.bold + "<i/>" * s.italic + (f'<color rgb="FF{s.color}"/>' if s.color else "") + "</font>") if s.bold or s.italic or s.color else 0
        fill = at(fills, f'<fill><patternFill patternType="solid"><fgColor rgb="FF{s.fill}"/></patternFill></fill>') if s.fill else 0
        edge = at(borders, "<border>" + "".join(f'<{e} style="thin"/>' for e in ("left", "right", "top", "bottom")) + "</border>") if s.border else 0
        align = f'<alignment{f" horizontal=\"{s.align}\"" if s.align else ""}{" wrapText=\"1\"" * s.wrap}/>' if s.align or s.wrap else ""
        xfs.append(f'<xf numFmtId="{num}" fontId="{font}" fillId="{fill}" borderId="{edge}" applyNumberFormat="1">{align}</xf>')
    many = lambda tag, items: f'<{tag} count="{len(items)}">{"".join(items)}</{tag}>'
    return f'<?xml version="1.0" encoding="UTF-8"?><styleSheet {_MAIN}>' + many("numFmts", [f"<numFmt numFmtId=\"{i}\" formatCode={quoteattr(c)}/>" for c, i in formats.items()]) + many("fonts", fonts) + many("fills", fills) + many("borders", borders) + "<cellStyleXfs count=\"1\"><xf/></cellStyleXfs>" + many("cellXfs", xfs) + "</styleSheet>"


_ODF = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{u}:1.0"' for p, u in (("office", "office"), ("table", "table"), ("text", "text"), ("style", "style"), ("number", "datastyle"), ("config", "config"), ("fo", "xsl-fo-compatible")))


def _ods_paragraphs(text: Column) -> Column:
    """Line breaks part paragraphs; spaces that would be folded, and tabs, are elements."""
    t = F.regexp_replace(_escaped(text), "\r\n|\r|\n", "\n")
    t = F.regexp_replace(t, "(?<= ) | (?= )|(?m:^ | $)", "<text:s/>")
    t = F.replace(F.replace(t, F.lit("\t"), F.lit("<text:tab/>")), F.lit("\n"), F.lit("</text:p><text:p>"))
    return F.concat(F.lit("<text:p>"), t, F.lit("</text:p>"))


def _ods_cell(s: SheetOut, f: T.StructField, styles: _Styles, spans: Column) -> Column:
    """spans: the attributes of a merge that begins here, else an empty text; null where another cell covers this one."""
    c, t = F.col(f"`{f.name}`"), f.dataType

    def begin(kind: str = "") -> Column:
        n = styles.column(s, f, kind)
        return F.concat(F.lit("<table:table-cell"), spans, F.when(n != "0", F.concat(F.lit(' table:style-name="ts'), n, F.lit('"'))).otherwise(F.lit("")))

    if isinstance(t, T.BooleanType):
        body = F.concat(begin(), F.lit(' office:value-type="boolean" office:boolean-value="'), c.cast("string"), F.lit('"/>'))
    elif isinstance(t, T.NumericType):
        own = s.styles.get(f.name)
        kind = "percentage" if own and own.of_numbers and number_parts(own.number_format).percent else "float"
        body = F.concat(begin(), F.lit(f' office:value-type="{kind}" office:value="'), _number(f), F.lit('"/>'))
    elif isinstance(t, DATES):
        m = _millis(f)
        text = F.when(_has_time(m), F.date_format(m, "yyyy-MM-dd'T'HH:mm:ss.SSS")).otherwise(F.date_format(m, "yyyy-MM-dd"))
        body = F.concat(F.when(_has_time(m), begin("time")).otherwise(begin("date")), F.lit(' office:value-type="date" office:date-value="'), text, F.lit('"/>'))
    else:
        text = c.cast("string")
        exact = _escaped(text)
        for raw, safe in (('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
            exact = F.replace(exact, F.lit(raw), F.lit(safe))
        exact = F.when(text.contains("\r"), F.concat(F.lit(' office:string-value="'), exact, F.lit('"'))).otherwise(F.lit(""))
        body = F.concat(begin(), F.lit(' office:value-type="string"'), exact, F.lit(">"), _ods_paragraphs(text), F.lit("</table:table-cell>"))
    return F.when(spans.isNull(), F.lit("<table:covered-table-cell/>")).otherwise(F.coalesce(body, F.concat(F.lit("<table:table-cell"), spans, F.lit("/>"))))


def _spans(s: SheetOut) -> dict[int, dict[int, str | None]]:
    """By row and column: a merge's attributes where it begins, None where it covers a cell."""
    out: dict[int, dict[int, str | None]] = {}
    for r, c, h, w in s.merges:
        for i in range(h):
            for j in range(w):
                out.setdefault(r + i, {})[c + j] = None
        out[r][c] = f' table:number-columns-spanned="{w}" table:number-rows-spanned="{h}"'
    return out


def write_ods(path: str, sheets: list[SheetOut], level: int = 1) -> dict[str, int]:
    """The rows of each sheet that were written."""
    check_names(sheets)
    styles, out = _Styles(sheets), {}
    widths = sorted({s.width(c) for s in sheets for c in s.columns})

    def content():
        yield f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {_ODF} office:version="1.3"><office:automatic-styles>'
        yield "".join(f'<style:style style:name="co{k}" style:family="table-column"><style:table-column-properties style:column-width="{(w * 7 + 5) / 96:.3f}in"/></style:style>' for k, w in enumerate(widths))
        yield "</office:automatic-styles><office:body><office:spreadsheet>"
        for s in sheets:
            spans = _spans(s)
            top = styles.of(s.header_style, "")
            own = spans.get(1, {})

            def named(i: int, c: str, own=own, top=top) -> str:
                if i in own and own[i] is None:
                    return "<table:covered-table-cell/>"
                style = f' table:style-name="ts{top}"' if top else ""
                return f'<table:table-cell{own.get(i, "")}{style} office:value-type="string"><text:p>{escape(c)}</text:p></table:table-cell>'

            head = f"<table:table table:name={quoteattr(s.name)}>" + "".join(f'<table:table-column table:style-name="co{widths.index(s.width(c))}"/>' for c in s.columns)
            head += "<table:table-row>" + "".join(named(i, c) for i, c in enumerate(s.columns)) + "</table:table-row>"
            cells = []
            for i, f in enumerate(s.fields):
                at = F.lit("")
                rows_of = {r: x[i] for r, x in spans.items() if i in x and r > 1}
                if rows_of:
                    covered = [r for r, x in rows_of.items() if x is None]
                    for r, x in rows_of.items():
                        if x is not None:
                            at = F.when(F.col("__n") == r, F.lit(x)).otherwise(at)
                    at = F.when(~F.col("__n").isin(covered), at) if covered else at
                cells.append(_ods_cell(s, f, styles, at))
            row = F.concat(F.lit("<table:table-row>"), *cells, F.lit("</table:table-row>"))
            out[s.name], pieces = _sheet(z, None, s, row, head, lambda n: "</table:table>", "ods", level)
            yield from pieces
        filters = "".join(f'<table:database-range table:name="__Filter{k}" table:target-range-address={quoteattr(f"{_quoted(s.name)}.A1:{_quoted(s.name)}.{letters(len(s.columns) - 1)}{out[s.name] + 1}")} table:display-filter-buttons="true"/>' for k, s in enumerate(sheets) if s.auto_filter)
        yield (f"<table:database-ranges>{filters}</table:database-ranges>" if filters else "") + "</office:spreadsheet></office:body></office:document-content>"

    with whole(path, level) as z:
        z.add("mimetype", "application/vnd.oasis.opendocument.spreadsheet", stored=True)
        z.stream("content.xml", content())
        z.add("styles.xml", _ods_styles(styles.at))
        z.add("settings.xml", _ods_settings(sheets))
        parts = "".join(f'<manifest:file-entry manifest:full-path="{p}" manifest:media-type="text/xml"/>' for p in ("content.xml", "styles.xml", "settings.xml"))
        z.add("META-INF/manifest.xml", f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.3"><manifest:file-entry manifest:full-path="/" manifest:media-type="application/vnd.oasis.opendocument.spreadsheet"/>{parts}</manifest:manifest>')
    return out


def _quoted(name: str) -> str:
    return "$'" + name.replace("'", "''") + "'"


def _ods_settings(sheets: list[SheetOut]) -> str:
    item = lambda name, kind, v: f'<config:config-item config:name="{name}" config:type="{kind}">{v}</config:config-item>'
    tables = ""
    for s in sheets:
        own = ""
        for side, n, pane in (("Horizontal", s.freeze_columns, "Right"), ("Vertical", s.freeze_rows, "Bottom")):
            if n:
                own += item(f"{side}SplitMode", "short", 2) + item(f"{side}SplitPosition", "int", n) + item(f"Position{pane}", "int", n)
        tables += f"<config:config-item-map-entry config:name={quoteattr(s.name)}>{own}</config:config-item-map-entry>" if own else ""
    views = f'<config:config-item-set config:name="ooo:view-settings"><config:config-item-map-indexed config:name="Views"><config:config-item-map-entry>{item("ViewId", "string", "view1")}<config:config-item-map-named config:name="Tables">{tables}</config:config-item-map-named></config:config-item-map-entry></config:config-item-map-indexed></config:config-item-set>' if tables else ""
    return f'<?xml version="1.0" encoding="UTF-8"?><office:document-settings {_ODF} office:version="1.3"><office:settings>{views}</office:settings></office:document-settings>'


def _ods_data(name: str, code: str, numbers: bool) -> str:
    """A data style of a number format or a date format."""
    text = lambda t: f"<number:text>{escape(t)}</number:text>" if t else ""
    if numbers:
        p = number_parts(code)
        tag = "percentage" if p.percent else "number"
        grouped = ' number:grouping="true"' if p.grouped else ""
        return f'<number:{tag}-style style:name="{name}">{text(p.before)}<number:number number:decimal-places="{p.most_decimals}" number:min-decimal-places="{p.least_decimals}" number:min-integer-digits="{p.whole_digits}"{grouped}/>{text("%" if p.percent else "")}{text(p.after)}</number:{tag}-style>'
    parts = {"y": "year", "m": "month", "d": "day", "h": "hours", "s": "seconds"}
    out = ""
    for t in date_format(code):
        if t in ("minute", "minutes"):
            out += f'<number:minutes{" number:style=\"long\"" * (t == "minutes")}/>'
        elif t[0] in parts:
            out += f'<number:{parts[t[0]]}{" number:style=\"long\"" * (len(t) > (2 if t[0] == "y" else 1))}/>'
        else:
            out += text(t[1:-1] if t[0] == '"' else t[1:] if t[0] == "\\" else t)
    return f'<number:date-style style:name="{name}">{out}</number:date-style>'


def _ods_styles(styles: dict[tuple[Style, str], int]) -> str:
    data, cells, names = [], [], {}
    for (s, kind), n in styles.items():
        code = s.number_format if s.number_format and s.of_numbers == (kind == "") else {"date": "yyyy-mm-dd", "time": "yyyy-mm-dd hh:mm:ss"}.get(kind)
        if code and (code, kind == "") not in names:
            names[code, kind == ""] = f"tn{len(names) + 1}"
            data.append(_ods_data(names[code, kind == ""], code, kind == ""))
        own = f' style:data-style-name="{names[code, kind == ""]}"' if code else ""
        look = (f' fo:background-color="#{s.fill}"' if s.fill else "") + (' fo:border="0.06pt solid #000000"' if s.border else "") + (' fo:wrap-option="wrap"' if s.wrap else "") + (' style:text-align-source="fix"' if s.align else "")
        align = f'<style:paragraph-properties fo:text-align="{ {"left": "start", "center": "center", "right": "end"}[s.align] }"/>' if s.align else ""
        font = (f' fo:color="#{s.color}"' if s.color else "") + (' fo:font-weight="bold"' if s.bold else "") + (' fo:font-style="italic"' if s.italic else "")
        cells.append(f'<style:style style:name="ts{n}" style:family="table-cell"{own}><style:table-cell-properties{look}/>{align}' + (f"<style:text-properties{font}/>" if font else "") + "</style:style>")
    return f'<?xml version="1.0" encoding="UTF-8"?><office:document-styles {_ODF} office:version="1.3"><office:styles>{"".join(data)}{"".join(cells)}</office:styles></office:document-styles>'
