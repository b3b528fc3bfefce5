"""A corpus pipeline out of the operators of tabsieve.llm: language, near-duplicates, secrets, mix, windows.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm import language_id, minhash_dedup, mixing, packing, secrets
from tabsieve.llm._shared import written

MADE = ("lang_pred", "score", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted", "size", "source_size", "target", "copies", "taken", "own copy")


def _apart(docs: DataFrame) -> DataFrame:
    """docs, its columns named like an operator's outputs renamed for the time being."""
    return docs.withColumnsRenamed({c: f"own {c}" for c in docs.columns if c in MADE})


def _as(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of docs, in order and with their types."""
    return out.select(*[F.col(f"`own {f.name}`" if f.name in MADE else f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema.fields])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose language can't be told: those without any letter. A missing label is filled in."""
    found = language_id.identify(_apart(docs), language_id.train(docs)).where(F.col("lang_pred") != "und")
    return _as(docs, found.withColumn("lang", F.coalesce("lang", "lang_pred")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every finding by its kind; every document stays."""
    found = secrets.find_secrets(_apart(docs))
    return _as(docs, found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(_apart(docs)).where("copies > 0")
    return _as(docs, mixed.withColumn("own copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training windows: their pieces, with the ids."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix),
    ("pack", pack_windows),
]

ORACLE_SQL = None  # SQL can't express the stages; tests/llm holds them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
