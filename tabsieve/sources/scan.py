"""Scans: files of rows as DataFrames of rows (sheet, row number, cells).

Files are listed and read by Spark (binaryFile), so they may lie in any store that Spark reads; each file is one task's
work, as a repaired csv's records depend on what comes before them. A csv that is proven to hold no quote is split by
Spark like any text (`scan_plain_csv`).
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from .dialect import PROBE_BYTES, detect_dialect
from .files import open_file

CELLS = "array<struct<kind:string,text:string,num:double,date:timestamp_ntz>>"
ROWS = f"path string, sheet_index int, sheet string, source string, row_number long, cells {CELLS}"
BATCH = 4096
_CELL = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("num", pa.float64()), ("date", pa.timestamp("us"))]))


def _binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def scan(spark: SparkSession, path: str | list[str], sheet: int | None = None, after: int = 0, most: int | None = None, **options) -> DataFrame:
    """Every row of every sheet (or of one) of the files under path. A file that can't be read raises its code.
    most: only so many rows of each sheet, the first ones numbered above after; a file isn't read beyond them."""

    def run(batches):
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = open_file(data, os.path.basename(at), **options)
                for s in f.sheets:
                    if sheet is not None and s.index != sheet:
                        continue
                    numbers, rows = [], []
                    taken = (x for x in f.rows(s.index) if x[0] > after) if after else f.rows(s.index)
                    for n, cells in taken if most is None else islice(taken, most):
                        numbers.append(n)
                        rows.append(cells)
                        if len(rows) == BATCH:
                            yield _batch(at, s, numbers, rows)
                            numbers, rows = [], []
                    if rows:
                        yield _batch(at, s, numbers, rows)

    return _binary(spark, path).mapInArrow(run, ROWS)


def _batch(at, s, numbers, rows):
    n = len(rows)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    kinds, texts, numbers_, dates = zip(*(c for r in rows for c in r), strict=True) if ends[-1] else ((), (), (), ())
    parts = [pa.array(kinds, pa.string()), pa.array(texts, pa.string()), pa.array(numbers_, pa.float64()), pa.array(dates, pa.timestamp("us"))]
    empty = pc.equal(parts[0], "Empty")
    cells = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["kind", "text", "num", "date"], mask=empty))
    return pa.record_batch([pa.array([at] * n), pa.array([s.index] * n, pa.int32()), pa.array([s.name] * n), pa.array([s.source] * n, pa.string()), pa.array(numbers, pa.int64()), cells.cast(_CELL)], ["path", "sheet_index", "sheet", "source", "row_number", "cells"])


def catalog(spark: SparkSession, path: str | list[str], counted: bool = True, **options) -> DataFrame:
    """One row a sheet or skipped entry: format, visibility, dialect, repairs (all rows are read), or the error's code.
    Unless counted, no row is read, and rows and repairs are null."""

    def run(batches):
        for b in batches:
            out = []
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    f = open_file(data, os.path.basename(at), **options)
                    for s in f.sheets:
                        f.repairs.stray = f.repairs.unterminated = 0
                        facts = (sum(1 for _ in f.rows(s.index)), f.repairs.stray, f.repairs.unterminated) if counted else (None, None, None)
                        d = f.dialects[s.index]
                        out.append((at, s.index, s.name, s.source, s.format, s.visibility, d and d.encoding, d and d.delimiter, *facts, None))
                    out += [(at, None, None, s.path, None, None, None, None, None, None, None, s.reason) for s in f.skipped]
                except EngineError as e:
                    out.append((at, None, None, None, None, None, None, None, None, None, None, e.code))
            names = ["path", "sheet_index", "sheet", "source", "format", "visibility", "encoding", "delimiter", "rows", "stray_quotes", "unterminated_quotes", "skipped"]
            types = [pa.string(), pa.int32(), *[pa.string()] * 6, *[pa.int64()] * 3, pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return _binary(spark, path).mapInArrow(run, "path string, sheet_index int, sheet string, source string, format string, visibility string, encoding string, delimiter string, rows long, stray_quotes long, unterminated_quotes long, skipped string")


def heads(spark: SparkSession, path: str | list[str], sheet: int = 0, header_row: int = 0, **options) -> list[tuple[str, int, list[str | None]]]:
    """(path, row number, texts) of the header of each file that has one, by path; files aren't read beyond it."""
    found = scan(spark, path, sheet, header_row, 1, **options).select("path", "row_number", F.transform("cells", lambda c: c["text"]).alias("h"))
    return sorted((r["path"], r["row_number"], r["h"]) for r in found.collect())  # one row a file


def below(rows: DataFrame, found: list[tuple[str, int, list[str | None]]]) -> DataFrame:
    """Rows below the header of their own file."""
    if len({n for _, n, _ in found}) == 1:
        return rows.where(F.col("row_number") > found[0][1])
    own = rows.sparkSession.createDataFrame([x[:2] for x in found], "path string, __head long")
    return rows.join(F.broadcast(own), "path").where(F.col("row_number") > F.col("__head")).drop("__head")


def header(rows: DataFrame, header_row: int = 0) -> tuple[int, list[str | None]] | None:
    """(row number, texts) of the header: the first row after header_row."""
    head = rows.where(F.col("row_number") > header_row).orderBy("row_number").limit(1).select("row_number", F.transform("cells", lambda c: c["text"]).alias("h")).first()
    return None if head is None else (head["row_number"], head["h"])


def _last(cells: str = "cells") -> Column:
    """How many cells a row has up to its last value."""
    return F.coalesce(F.array_max(F.transform(cells, lambda c, i: F.when(c["text"].isNotNull(), i + 1).otherwise(0))), F.lit(0))


def body(rows: DataFrame, header_row: int = 0, found: list[tuple[str, int, list[str | None]]] | None = None) -> tuple[DataFrame, list[str]] | None:
    """(rows below the header that hold a value, column headers); None if there is no header row. Columns reach as far as
    the header's or any row's last value, so padding makes none; a header that is missing is empty.
    found: the headers of files alike, as heads() gives them; else the rows are one file's."""
    if found is None:
        head = header(rows, header_row)
        found = [] if head is None else [("", *head)]
    if not found:
        return None
    top, held = found[0][2], below(rows, found).where(F.exists("cells", lambda c: c["text"].isNotNull()))
    named = max((i + 1 for i, h in enumerate(top) if h), default=0)
    width = max(named, held.agg(F.max(_last())).first()[0] or 0)
    return held, [(top[i] if i < len(top) else None) or "" for i in range(width)]


def cells_of(below: DataFrame, headers: list[str]) -> DataFrame:
    """(row_number, column_index, name, kind, text, num, date) of rows below a header, one row a value, as the file types it."""
    one = below.select("row_number", F.posexplode("cells").alias("column_index", "c")).where("c.text is not null")
    return one.select("row_number", "column_index", F.get(F.array(*[F.lit(h) for h in headers]), F.col("column_index")).alias("name"), "c.kind", "c.text", "c.num", "c.date")


def table(rows: DataFrame, header_row: int = 0) -> DataFrame:
    """Rows of one sheet as columns named by the header (position added where a name is empty or repeated), as text."""
    found = body(rows, header_row)
    if found is None:
        return rows.select("row_number").limit(0)
    names, seen = [], set()
    for i, h in enumerate(found[1]):
        h = h or f"column_{i}"
        names.append(h if h.lower() not in seen else f"{h}_{i}")
        seen.add(names[-1].lower())
    return found[0].select("row_number", *[F.get("cells", i)["text"].alias(n) for i, n in enumerate(names)])


def scan_plain_csv(spark: SparkSession, path: str, delimiter: str | None = None, quote: str = '"') -> DataFrame:
    """(row_number, cells array<string>) of one file without any quote: lines are records, so Spark splits the file.

    The absence of quotes is checked over the whole file; with one, ValueError tells to use scan()."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    per = lines.groupBy("part").agg(F.min("file").alias("file"), F.min("block").alias("block"), F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").contains(quote)).alias("quotes")).collect()  # one row a partition
    if any(r["quotes"] for r in per):
        raise ValueError("the file holds quotes: read it with scan()")
    if delimiter is None:
        probe = "\n".join(r["value"] for r in lines.limit(200).select("value").collect()).encode()
        delimiter = detect_dialect(probe[:PROBE_BYTES], False)[0].delimiter
    starts, n = [], 0
    for r in sorted(per, key=lambda r: (r["file"], r["block"], r["line"])):
        starts.append((r["part"], r["line"], n))
        n += r["n"]
    if not starts:
        return lines.select(F.lit(1).cast("long").alias("row_number"), F.array("value").alias("cells")).limit(0)
    start = spark.createDataFrame(starts, "part int, first long, start long")
    text = F.regexp_replace("value", "\r$", "")
    import re

    return lines.join(F.broadcast(start), "part").select((F.col("start") + F.col("line") - F.col("first") + 1).alias("row_number"), F.split(text, re.escape(delimiter), -1).alias("cells"))
