"""Zip packages whose large parts come in pieces that executors have compressed already.

A part's pieces are raw deflate streams that end at a byte (full flush), so the part is their concatenation and an empty
last block; its checksum is combined from theirs. Entries carry a fixed date, so the same content makes the same file.
The file lies under another name until it is complete, and any error removes it; a path in a store that Spark writes
to is filled from a local file at the end.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import zlib
from collections.abc import Iterable
from contextlib import contextmanager

_POLY = 0xEDB88320  # fixed value: CRC-32, bits reversed
_DATE = 0x0021  # 1980-01-01, the first date that an entry can carry
_ROOM = struct.pack("<HHHH", 0xA220, 16, 0xA028, 12) + b"\0" * 12  # a growth hint that gives way to sizes of 64 bits
_MAX32 = 0xFFFFFFFF


def _times(a: int, b: int) -> int:
    """a * b modulo the polynomial."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def crc32_combined(first: int, second: int, length: int) -> int:
    """The checksum of two pieces one after the other; length is the second one's."""
    shift, base, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            shift = _times(shift, base)
        base, n = _times(base, base), n >> 1
    return _times(shift, first) ^ second


def piece(data: bytes, level: int) -> tuple[bytes, int, int]:
    """(compressed piece, checksum, length)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FULL_FLUSH), zlib.crc32(data), len(data)


class Package:
    def __init__(self, file, level: int):
        self.file, self.level, self.entries = file, level, []

    def _begin(self, name: str, method: int, extra: bytes) -> int:
        at, raw = self.file.tell(), name.encode()
        self.file.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x0800, method, 0, _DATE, 0, 0, 0, len(raw), len(extra)) + raw + extra)
        return at

    def _end(self, name: str, at: int, method: int, crc: int, packed: int, length: int) -> None:
        end = self.file.tell()
        big = packed >= _MAX32 or length >= _MAX32
        self.file.seek(at + 14)
        self.file.write(struct.pack("<III", crc, _MAX32 if big else packed, _MAX32 if big else length))
        if big:
            self.file.seek(at + 4)
            self.file.write(struct.pack("<H", 45))
            self.file.seek(at + 30 + len(name.encode()))
            self.file.write(struct.pack("<HHQQ", 1, 16, length, packed))
        self.file.seek(end)
        self.entries.append((name, at, method, crc, packed, length))

    def add(self, name: str, data: bytes | str, stored: bool = False) -> None:
        data = data.encode() if isinstance(data, str) else data
        c = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        packed = data if stored else c.compress(data) + c.flush()
        at = self._begin(name, 0 if stored else 8, b"")
        self.file.write(packed)
        self._end(name, at, 0 if stored else 8, zlib.crc32(data), len(packed), len(data))

    def stream(self, name: str, pieces: Iterable[bytes | str | tuple[bytes, int, int]]) -> None:
        """An entry of pieces: plain ones, or such that piece() has made."""
        at, crc, packed, length = self._begin(name, 8, _ROOM), 0, 0, 0
        for p in pieces:
            data, own, n = p if isinstance(p, tuple) else piece(p.encode() if isinstance(p, str) else p, self.level)
            self.file.write(data)
            crc, packed, length = crc32_combined(crc, own, n), packed + len(data), length + n
        self.file.write(b"\x03\0")
        self._end(name, at, 8, crc, packed + 2, length)

    def finish(self) -> None:
        begin = self.file.tell()
        for name, at, method, crc, packed, length in self.entries:
            big = b"".join(struct.pack("<Q", x) for x in (length, packed, at) if x >= _MAX32)
            extra = struct.pack("<HH", 1, len(big)) + big if big else b""
            raw, low = name.encode(), lambda x: min(x, _MAX32)
            self.file.write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x0800, method, 0, _DATE, crc, low(packed), low(length), len(raw), len(extra), 0, 0, 0, 0, low(at)) + raw + extra)
        end, n = self.file.tell(), len(self.entries)
        if n >= 0xFFFF or end >= _MAX32:
            self.file.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, end - begin, begin) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self.file.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(end - begin, _MAX32), min(begin, _MAX32), 0))


def in_store(path: str) -> bool:
    """Whether the path is one of Spark's file systems: it names one, or Spark's default isn't the local one."""
    from pyspark.sql import SparkSession

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return True
    spark = SparkSession.getActiveSession() or SparkSession._instantiatedSession
    return spark is not None and not spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


@contextmanager
def whole(path: str, level: int):
    """A package that appears under its name only when it is complete."""
    if in_store(path):
        handle, part = tempfile.mkstemp(prefix="export-")
        os.close(handle)
    else:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        part = path + ".partial"
    try:
        with open(part, "wb") as f:
            p = Package(f, level)
            yield p
            p.finish()
        if in_store(path):
            put(part, path)
        else:
            os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def put(local: str, path: str) -> None:
    """Copies a local file to a path of any file system that Spark knows, first under another name."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # a thread of its own has no active one
    make = spark._jvm.org.apache.hadoop.fs.Path
    target, part = make(path), make(path + ".partial")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(False, True, make(local), part)
    fs.delete(target, False)
    fs.rename(part, target)
