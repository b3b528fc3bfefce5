"""Checked extraction of a stream: the same projection, as it has no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.extract import Extraction, compile_plan
from ..plans.mapping import Plan
from ..plans.schema import Schema


def extract_stream(stream: DataFrame, plan: Plan, schema: Schema, row: str = "row_number", cells: str | None = None) -> Extraction:
    """accepted() and rejected() of the result are streams; summaries are per batch, by foreachBatch."""
    if schema.policy == "AllOrNothing":
        raise ValueError("a stream never ends, so all-or-nothing can't be decided")
    return compile_plan(stream, plan, schema, row, cells)
