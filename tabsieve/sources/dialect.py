"""What a file is, and how a delimited one is written: format by its bytes, encoding, delimiter, quote."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from dataclasses import dataclass

from ..errors import FormatError

DELIMITERS = ";,\t|"  # in the order in which ties are decided
PROBE_BYTES = 64 * 1024
PROBE_RECORDS = 20
MAX_QUOTED_LINES = 100
MAX_FIELD_CHARS = 16 * 1024 * 1024
MAX_COLUMNS = 16_384
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    quote: str | None = '"'
    encoding_source: str = "Detected"  # Specified, ByteOrderMark, Detected or Fallback
    delimiter_source: str = "Detected"


def tar_header(head: bytes) -> bool:
    """The ustar magic and a checksum that fits."""
    if len(head) < 512 or head[257:265] not in (b"ustar\x0000", b"ustar  \x00") and head[257:263] != b"ustar\x00":
        return False
    try:
        stated = int(head[148:156].split(b"\0")[0].strip() or b"0", 8)
    except ValueError:
        return False
    block = head[:148] + b" " * 8 + head[156:512]
    return stated in (sum(block), sum(b - 256 if b > 127 else b for b in block))


def detect_format(data: bytes) -> str:
    """Gzip, Tar, Xlsx, Ods, Zip or Csv, by content only."""
    if data[:2] == b"\x1f\x8b":
        return "Gzip"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = set(z.namelist())
                if "mimetype" in names:
                    kind = z.read("mimetype").strip()
                    if kind.startswith(b"application/vnd.oasis.opendocument.spreadsheet"):
                        return "Ods"
                    if kind.startswith(b"application/vnd.oasis.opendocument"):
                        raise FormatError("format.unsupported", "another kind of OpenDocument")
                return "Xlsx" if names & {"[Content_Types].xml", "_rels/.rels"} else "Zip"
        except zipfile.BadZipFile:
            return "Xlsx"  # its reader says that it is corrupt
    if tar_header(data[:512]):
        return "Tar"
    return "Csv"


def detect_encoding(probe: bytes, complete: bool) -> tuple[str, str, int]:
    """(encoding, how it was found, bytes of the mark)."""
    for mark, name in BOMS:
        if probe.startswith(mark):
            return name, "ByteOrderMark", len(mark)
    zeros = probe.count(0)
    if zeros >= 4 and zeros >= len(probe) / 1000:
        odd = sum(1 for i in range(1, len(probe), 2) if probe[i] == 0)
        even = zeros - odd
        if odd > 9 * even:
            return "utf-16-le", "Detected", 0
        if even > 9 * odd:
            return "utf-16-be", "Detected", 0
        raise FormatError("format.unsupported", "binary data")
    try:
        codecs.getincrementaldecoder("utf-8")().decode(probe, final=complete)
        return "utf-8", "Detected", 0
    except UnicodeDecodeError:
        return "cp1252", "Fallback", 0


def refuse(probe: bytes) -> None:
    """Raises for what no reader here reads."""
    if probe.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        raise FormatError("format.unsupported", "a legacy compound file")
    text = probe.lstrip(b"\xef\xbb\xbf \t\r\n")
    if text.startswith(b"<?xml") or text[:14].lower() == b"<!doctype html":
        raise FormatError("format.unsupported", "a markup document")


def _probe_records(text: str, quote: str | None, open_tail: bool) -> list[str]:
    """The probe's first records that hold anything; with a quote, line ends within quotes part none. open_tail: whether a
    last record that the probe cuts inside quotes counts."""
    pieces = re.split("\n", text)
    out, held = [], ""
    for i, piece in enumerate(pieces):
        held = f"{held}\n{piece}" if held else piece
        whole = not quote or held.count(quote) % 2 == 0
        if not whole and (i < len(pieces) - 1 or not open_tail):
            continue
        record, held = held.rstrip("\r"), ""
        if record:
            out.append(record)
        if len(out) == PROBE_RECORDS:
            break
    return out


def _unquoted(record: str, quote: str | None) -> str:
    return "".join(record.split(quote)[::2]) if quote else record


def _best_delimiter(lines: list[str], quote: str | None) -> tuple[str | None, bool]:
    """(the delimiter that more than half of the lines have, whether all that have it have it equally often). That weighs
    most, then how many lines have it, then how often the first of them does; ties go by the order of candidates."""
    bare, best, top = [_unquoted(x, quote) for x in lines], (None, False), (False, 0, 0)
    for d in DELIMITERS:
        counts = [n for n in (x.count(d) for x in bare) if n]
        if len(counts) * 2 <= len(bare):
            continue
        even = len(set(counts)) == 1
        if (even, len(counts), counts[0]) > top:
            best, top = (d, even), (even, len(counts), counts[0])
    return best


def _well_quoted(record: str, delimiter: str, quote: str) -> bool:
    """Whether quotes stand only where fields begin and end, or doubled inside of them."""
    q, d = re.escape(quote), re.escape(delimiter)
    field = f"(?:{q}(?:[^{q}]|{q}{q})*{q}\r?|[^{q}{d}][^{q}{d}]*|)"
    return re.fullmatch(f"{field}(?:{d}{field})*", record) is not None


def detect_delimiter(text: str, quote: str | None = '"', full: bool = False) -> tuple[str, str]:
    """(delimiter, how it was found). An odd number of quotes is a stray one, or a quoted field that the probe cuts: the
    whole records decide if they are even and well quoted, else quotes are taken for text."""
    if full and "\n" in text:
        text = text[: text.rindex("\n") + 1]
    if quote and text.count(quote) % 2:
        lines = _probe_records(text, quote, False)
        best, even = _best_delimiter(lines, quote)
        if best and even and all(_well_quoted(x, best, quote) for x in lines):
            return best, "Detected"
        quote = None
    best, _ = _best_delimiter(_probe_records(text, quote, True), quote)
    return (best, "Detected") if best else (";", "Fallback")


def detect_dialect(probe: bytes, complete: bool, encoding: str | None = None, delimiter: str | None = None, quote: str | None = '"') -> tuple[Dialect, int]:
    """(dialect, bytes of the byte order mark). What is stated wins, part by part."""
    refuse(probe)
    found, how, mark = detect_encoding(probe, complete)
    if encoding:
        found, how = encoding, "Specified"
    text = probe[mark:].decode(found, "replace")
    if delimiter:
        return Dialect(found, delimiter, quote, how, "Specified"), mark
    d, by = detect_delimiter(text, quote, not complete)
    return Dialect(found, d, quote, how, by), mark
