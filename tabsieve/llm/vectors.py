"""What the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ensure


def numbered(vectors: DataFrame) -> DataFrame:
    """(vec_id long, label int, v array<double>): v is null unless every component is there and finite."""
    rows = ensure(vectors, {"vec_id": "long", "embedding": "array<double>", "label": "int"})
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select("vec_id", "label", F.when(sound & (F.size("embedding") > 0), F.col("embedding")).alias("v"))
