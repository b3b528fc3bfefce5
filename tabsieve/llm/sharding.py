"""Two-pass external shuffle into training shards (DataFrame functions only).

Pass 1 scatters every record by seeded hashes: rendezvous hashing of the id picks the shard, another seeded hash picks
one of the shard's buckets, each small enough for a task's memory. Pass 2 brings each bucket into one task, shuffles
it by Fisher-Yates (Spark's `shuffle` with a seed) and writes it. A record's slot is its bucket's start in the shard
plus its place in the shuffled bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import forget, written

BUCKET_BYTES = 32 << 20


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is largest. One more shard moves only the keys that it wins."""
    weights = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(s).alias("s")) for s in range(shards)])
    return F.array_max(weights)["s"]


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 7, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of docs with size, shard, grown_shard (the shard if there were one more) and slot (gapless from 0 in its shard).

    Nulls: a null key is hashed as its own value, a null text counts 8 bytes. Repeated rows stay, each with a slot of
    its own. Equal texts scatter like any others. Empty input gives no rows. Columns of docs named like an output are
    replaced. The order of a bucket's rows before the shuffle is by key, then hash of the text, so reruns agree (rows
    alike in both are told by their numbers in docs).
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("size", "shard", "grown_shard", "slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    k, t = F.col("row").getField(key), F.col("row").getField(text)
    rows = rows.withColumn("size", F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8)
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    rows = rows.select("row", "size", rendezvous(k, shards, seed).alias("shard"), rendezvous(k, shards + 1, seed).alias("grown_shard"), F.xxhash64(F.lit(seed), k, t).alias("tie"))
    # Rows that are all alike scatter by their numbers, if together they would make up much of a bucket.
    alike = rows.groupBy("shard", "tie").agg(F.sum("size").alias("n")).where(F.col("n") > bucket_bytes // 8).select(F.col("shard").alias("s2"), F.col("tie").alias("t2"), F.lit(True).alias("alike"))
    small = shards * per_shard <= 100_000  # then there are 800,000 such rows at most
    rows = rows.withColumn("number", F.monotonically_increasing_id()).join(F.broadcast(alike) if small else alike, (F.col("shard") == F.col("s2")) & (F.col("tie") == F.col("t2")), "left").drop("s2", "t2")
    number = F.when(F.col("alike"), F.col("number"))
    rows = rows.withColumn("bucket", F.col("shard") * per_shard + F.pmod(F.xxhash64(F.lit(seed + 1), k, F.col("tie"), number), F.lit(per_shard)).cast("int")).drop("alike", "number")
    # Pass 2: the bucket's number is its partition's number, which with the seed fixes the permutation.
    buckets = rows.repartitionById(shards * per_shard, F.col("bucket")).groupBy("bucket", "shard").agg(
        F.sort_array(F.collect_list(F.struct(k.alias("k"), "tie", "size", "grown_shard", "row"))).alias("rows")
    )
    placed = written(buckets.select("bucket", "shard", F.posexplode(F.shuffle("rows", seed)).alias("place", "r")).select("bucket", "shard", "place", "r.size", "r.grown_shard", "r.row"), "sharding")
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))
    if shards * per_shard <= 1_000_000:
        start = F.broadcast(start)  # a pair of numbers for each bucket
    out = placed.join(start, "bucket").select("row.*", "size", "shard", "grown_shard", (F.col("start") + F.col("place")).alias("slot"))
    out._written_path = placed._written_path
    return out


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes the shards as folders shard=0, 1, ...; the records of each file are in slot order."""
    shuffled.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = external_shuffle(docs)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


__all__ = ["external_shuffle", "forget", "op7_external_shuffle", "rendezvous", "write_shards"]
