"""Any file of rows as one list of sheets: csv, xlsx, ods, and archives of them."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..errors import FormatError, LimitError, EngineError
from .dialect import PROBE_BYTES, Dialect, detect_dialect, detect_format
from .records import Repairs, records
from .workbooks import MAX_SHEETS, Cell, Ods, Sheet, Xlsx, text_cell

MAX_ENTRIES, MAX_ARCHIVE_BYTES = 16_384, 8 << 30
MAX_UNPACKED_BYTES = 2 << 30  # of a gzip file or an archive's entry, which one task holds
# Options of a csv (delimiter, encoding, quote and its bounds) and the bounds of archives and workbooks.
OPTIONS = {"delimiter", "encoding", "quote", "probe_bytes", "max_quoted_lines", "max_field_chars", "max_columns", "max_entries", "max_archive_bytes", "max_unpacked_bytes", "max_sheets", "max_workbook_bytes"}


@dataclass(frozen=True)
class Skipped:
    path: str
    reason: str


@dataclass
class File:
    """An opened file. rows(i) gives (row number, cells) of sheet i."""

    format: str
    sheets: list[Sheet]
    skipped: list[Skipped] = field(default_factory=list)
    dialects: list[Dialect | None] = field(default_factory=list)
    repairs: Repairs = field(default_factory=Repairs)
    _readers: list = field(default_factory=list)

    def rows(self, index: int = 0) -> Iterator[tuple[int, list[Cell]]]:
        return self._readers[index]()


def _csv(data: bytes | Callable[[], bytes], name: str, source: str | None, options: dict, repairs: Repairs):
    """data: the bytes, or what reads them again (an archive's entry isn't held)."""
    probe = options.get("probe_bytes", PROBE_BYTES)
    load = data if callable(data) else lambda: data
    first = load()
    dialect, mark = detect_dialect(first[:probe], len(first) <= probe, options.get("encoding"), options.get("delimiter"), options.get("quote", '"'))
    bounds = {to: options[x] for x, to in (("max_quoted_lines", "max_lines"), ("max_field_chars", "max_chars"), ("max_columns", "max_columns")) if x in options}

    def rows():
        text = load()[mark:].decode(dialect.encoding, "replace")
        for i, fields in enumerate(records(text, dialect, repairs, **bounds)):
            yield i + 1, [text_cell(x) for x in fields]

    return Sheet(0, name, "Csv", source), dialect, rows


class _Unpacked(io.RawIOBase):
    """A gzip file's content, unpacked as it is read: all members, checksums checked, bounded."""

    def __init__(self, data: bytes, most: int):
        self.data, self.at, self.most, self.total, self.d = memoryview(data), 0, most, 0, zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, out):
        while True:
            if self.d.eof:
                self.at -= len(self.d.unused_data)
                rest = bytes(self.data[self.at : self.at + 1024]).strip(b"\0")
                if not rest and not bytes(self.data[self.at :]).strip(b"\0"):
                    return 0
                self.d = zlib.decompressobj(31)
            held = self.d.unconsumed_tail
            if not held:
                held = bytes(self.data[self.at : self.at + (1 << 16)])
                self.at += len(held)
            try:
                got = self.d.decompress(held, len(out))
            except zlib.error as e:
                raise FormatError("format.corrupt", str(e)) from e
            if got:
                self.total += len(got)
                if self.total > self.most:
                    raise LimitError("limit.exceeded", f"unpacks to more than {self.most} bytes")
                out[: len(got)] = got
                return len(got)
            if not held and not self.d.eof:
                raise FormatError("format.truncated", "the gzip stream ends early")


@dataclass(frozen=True)
class _Entry:
    path: str
    reason: str | None  # why it is skipped
    read: Callable[[], bytes] | None


def _bounded(stream, size: int, most: int) -> bytes:
    if size > most:
        raise LimitError("limit.exceeded", f"an entry of {size} bytes")
    out = stream.read(most + 1)
    if len(out) > most:
        raise LimitError("limit.exceeded", f"an entry of more than {most} bytes")
    return out


def _entries(data: bytes, kind: str, options: dict) -> list[_Entry]:
    """An archive's files in order of their paths, none of them held. A gzipped tar is passed over once for the list, and again
    up to the entry that is read."""
    most = options.get("max_unpacked_bytes", MAX_UNPACKED_BYTES)
    most_entries, most_bytes = options.get("max_entries", MAX_ENTRIES), options.get("max_archive_bytes", MAX_ARCHIVE_BYTES)
    if kind == "Zip":
        tail = data[max(0, len(data) - 65_557) :]
        at = tail.rfind(b"PK\x05\x06")
        if at >= 0 and most_entries < int.from_bytes(tail[at + 10 : at + 12], "little") < 0xFFFF:  # before the directory is parsed
            raise LimitError("limit.exceeded", f"more than {most_entries} entries")
        try:
            z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise FormatError("format.corrupt", str(e)) from e

        def get(i):
            with z.open(i) as f:
                return _bounded(f, i.file_size, most)

        found = [(i.filename, i.file_size, "Encrypted" if i.flag_bits & 1 else None, lambda i=i: get(i)) for i in z.infolist() if not i.is_dir()]
    else:
        packed = kind == "TarGz"

        def opened():
            if packed:
                return tarfile.open(fileobj=io.BufferedReader(_Unpacked(data, most_bytes)), mode="r|")
            return tarfile.open(fileobj=io.BytesIO(data), mode="r:")

        def get(n):
            with opened() as t:
                for k, i in enumerate(t):
                    if k == n:
                        return _bounded(t.extractfile(i), i.size, most)
            raise FormatError("format.truncated", "an entry is missing")

        found = []
        try:
            with opened() as t:
                for n, i in enumerate(t):
                    if i.isfile():
                        found.append((i.name, i.size, "Unsupported" if i.issparse() else None, lambda n=n: get(n)))
                    if len(found) > most_entries:
                        break
        except tarfile.ReadError as e:
            raise FormatError("format.truncated", str(e)) from e
        if not packed and (data[-1024:].strip(b"\0") or len(data) < 1024):
            raise FormatError("format.truncated", "no end block")
    if len(found) > most_entries:
        raise LimitError("limit.exceeded", f"more than {most_entries} entries")
    if sum(size for _, size, _, _ in found) > most_bytes:
        raise LimitError("limit.exceeded", "the archive holds too much")
    return sorted((_Entry(path, reason, read) for path, _, reason, read in found), key=lambda e: e.path)


def open_file(data: bytes, name: str = "", **options) -> File:
    """Opens a file by its bytes. options: see OPTIONS."""
    unknown = set(options) - OPTIONS
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}; there are {sorted(OPTIONS)}")
    kind = detect_format(data)
    repairs = Repairs()
    if kind == "Gzip":
        most = options.get("max_unpacked_bytes", MAX_UNPACKED_BYTES)
        of = detect_format(io.BufferedReader(_Unpacked(data, most)).read(512))
        if of == "Tar":
            return _archive(data, "TarGz", repairs, options)
        inner = io.BufferedReader(_Unpacked(data, most)).read()
        of = detect_format(inner)
        if of in ("Gzip", "Zip"):
            raise FormatError("format.unsupported", f"{of} inside gzip")
        out = open_file(inner, name.removesuffix(".gz"), **options)
        out.format = "Gzip"
        return out
    if kind in ("Xlsx", "Ods"):
        book = (Xlsx if kind == "Xlsx" else Ods)(data, options.get("max_workbook_bytes"), options.get("max_sheets", MAX_SHEETS))
        return File(kind, book.sheets, [], [None] * len(book.sheets), repairs, [lambda i=i: book.rows(i) for i in range(len(book.sheets))])
    if kind == "Csv":
        sheet, dialect, rows = _csv(data, name, None, options, repairs)
        return File(kind, [sheet], [], [dialect], repairs, [rows])
    return _archive(data, kind, repairs, options)


# Why an entry is skipped, by what its reader says of it.
_REASONS = (("legacy", "LegacyWorkbook"), ("markup", "XmlDocument"), ("binary", "Binary"), ("OpenDocument", "OtherDocument"), ("encrypted", "Encrypted"))


def _archive(data: bytes, kind: str, repairs: Repairs, options: dict) -> File:
    """An archive as one workbook: every file that is read is a sheet (or its sheets)."""
    out, seen = File("Tar" if kind == "TarGz" else kind, [], [], [], repairs), set()
    for e in _entries(data, kind, options):
        parts = e.path.split("/")
        if any(p.startswith(".") for p in parts) or "__MACOSX" in parts:
            continue
        reason = "DuplicatePath" if e.path in seen else e.reason
        seen.add(e.path)
        if reason is None:
            try:
                content = e.read()
                of = detect_format(content)
                reason = "NestedArchive" if of in ("Zip", "Tar") else "Compressed" if of == "Gzip" else None
                if reason is None and of == "Csv":
                    sheet, dialect, rows = _csv(e.read, e.path, e.path, options, repairs)
                    out.sheets.append(Sheet(len(out.sheets), e.path, "Csv", e.path, sheet.visibility))
                    out.dialects.append(dialect)
                    out._readers.append(rows)
                    continue
                if reason is None:
                    inner = open_file(content, e.path, **options)
                    for i, s in enumerate(inner.sheets):
                        out.sheets.append(Sheet(len(out.sheets), s.name or e.path, s.format, e.path, s.visibility))
                        out.dialects.append(None)
                        out._readers.append(lambda e=e, i=i: open_file(e.read(), e.path, **options).rows(i))
                    continue
            except (zipfile.BadZipFile, zlib.error, NotImplementedError, tarfile.ReadError):
                reason = "Unreadable"
            except LimitError:
                raise
            except EngineError as x:
                reason = next((r for w, r in _REASONS if w in str(x)), "Unreadable")
        out.skipped.append(Skipped(e.path, reason))
    return out
