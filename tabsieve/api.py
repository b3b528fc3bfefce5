"""The usual way through: profile a file, map it, check the mapping, import it, export rows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StructureError
from .operators.extract import Extraction, compile_plan
from .operators.profile import AnalysisOptions, SheetProfile, analyze_cells
from .plans.mapping import Plan, by_header, check_structure, normalized, validate
from .plans.precheck import Verdict, precheck
from .plans.schema import Schema
from .sinks.csv import CsvOptions, write_csv
from .sinks.workbooks import SheetOut, write_ods, write_xlsx, write_zip_of_csv
from .sources.scan import below, body, catalog, cells_of, heads, scan, table


@dataclass
class Workbook:
    """A file (or files alike) in a store that Spark reads."""

    spark: SparkSession
    path: str
    options: dict

    def sheets(self) -> DataFrame:
        return catalog(self.spark, self.path, **self.options)

    def rows(self, sheet: int = 0) -> DataFrame:
        return scan(self.spark, self.path, sheet, **self.options)

    def table(self, sheet: int = 0, header_row: int = 0) -> DataFrame:
        return table(self.rows(sheet), header_row)

    def profile(self, sheet: int = 0, header_row: int = 0, analysis: AnalysisOptions | None = None) -> SheetProfile:
        """The profile of a sheet's cells, with the kinds, numbers and dates that a workbook gives them."""
        rows = self.rows(sheet).persist()  # read once: the profile is several passes
        try:
            found = body(rows, header_row, self._heads(sheet, header_row))
            if found is None:
                return SheetProfile(0, [], header_row, sheet=sheet)
            held, headers = found
            own = rows.select("sheet", "source").first()
            out = analyze_cells(cells_of(held, headers), held.count(), headers, analysis, self._delimiter(sheet))
            out.header_row, out.sheet, out.name, out.source = header_row, sheet, own["sheet"], own["source"]
            return out
        finally:
            rows.unpersist()

    def _delimiter(self, sheet: int) -> str | None:
        found = self._listed().where(F.col("sheet_index") == sheet).select("delimiter").first()
        return found and found["delimiter"]

    def _listed(self) -> DataFrame:
        """sheets() without their rows being read."""
        return catalog(self.spark, self.path, False, **self.options)

    def _heads(self, sheet: int, header_row: int) -> list[tuple[str, int, list[str | None]]]:
        """Each file's header; files alike have the same one."""
        found = heads(self.spark, self.path, sheet, header_row, **self.options)
        for path, _, texts in found:
            if [normalized(t or "") for t in texts] != [normalized(t or "") for t in found[0][2]]:
                raise StructureError("structure.header-changed", f"{path} has other headers than {found[0][0]}")
        return found

    def headers(self, sheet: int = 0, header_row: int = 0) -> list[str | None] | None:
        found = self._heads(sheet, header_row)
        return found[0][2] if found else None

    def plan(self, schema: Schema, culture: str | None = None, sheet: int = 0, header_row: int = 0, matcher: Callable | None = None) -> Plan:
        return by_header(self.headers(sheet, header_row) or [], schema, culture, matcher, sheet, None, header_row)

    def check(self, plan: Plan, schema: Schema, profile: SheetProfile) -> Verdict:
        return precheck(self.spark, plan, schema, profile)

    def extract(self, plan: Plan, schema: Schema) -> Extraction:
        """The plan is validated before the file is opened; then sheet and header must be those of the plan."""
        validate(plan, schema)
        names: dict[str, list] = {}  # of each file
        for r in self._listed().where("sheet_index is not null").orderBy("path", "sheet_index").collect():
            names.setdefault(r["path"], []).append((r["sheet"], r["source"]))
        found = self._heads(plan.sheet, plan.header_row) if all(plan.sheet < len(x) for x in names.values()) else []
        own = {path: texts for path, _, texts in found}
        for path, sheets in names.items() or [("", [])]:
            check_structure(plan, sheets, own.get(path))
        rows = below(self.rows(plan.sheet), found).select("row_number", "cells")
        return compile_plan(rows, plan, schema, cells="cells")


def open_workbook(spark: SparkSession, path: str, **options) -> Workbook:
    """options: how a csv is written (delimiter, encoding, quote), and bounds; see sources.files.OPTIONS."""
    return Workbook(spark, path, options)


def export(path: str, sheets: list[SheetOut], options: CsvOptions = CsvOptions(), level: int = 1) -> dict[str, int]:
    """By the name's ending: .xlsx, .ods, .zip (of csv sheets), or a folder of csv parts of one sheet. Paths may lie in any
    store that Spark writes to. Returns the rows written of each sheet."""
    if path.endswith(".xlsx"):
        return write_xlsx(path, sheets, level)
    if path.endswith(".ods"):
        return write_ods(path, sheets, level)
    if path.endswith(".zip"):
        return write_zip_of_csv(path, sheets, options, level)
    if len(sheets) != 1:
        raise ValueError("a csv holds one sheet")
    return {sheets[0].name: write_csv(sheets[0].df.select(sheets[0].row, *[f"`{c}`" for c in sheets[0].columns]), path, sheets[0].row, options)}


def export_files(spark: SparkSession, files: dict[str, list[SheetOut]], options: CsvOptions = CsvOptions(), level: int = 1, at_once: int = 6) -> dict[str, dict[str, int]]:
    """export() of several files, some at once, as the pieces of one come to the driver in order and leave cores idle."""
    with ThreadPoolExecutor(max_workers=min(at_once, max(1, len(files)))) as pool:
        started = {path: pool.submit(inheritable_thread_target(spark)(export), path, sheets, options, level) for path, sheets in files.items()}
        try:
            return {path: f.result() for path, f in started.items()}
        except BaseException:
            for f in started.values():
                f.cancel()
            raise
