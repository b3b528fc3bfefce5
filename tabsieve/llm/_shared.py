"""What the operators share: the shared folder, written tables, connected components, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's default: with whole texts, batches make up a worker's memory. Plans are
    made when results are read, so the setting stays; a caller's smaller one is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, rows)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written as Parquet to the shared folder and read again. Cuts lineage; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ensure(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with just these columns, cast to these types; one that is missing is null. Other columns, whatever their names, are left behind."""
    have = {f.name for f in df.schema.fields}
    return df.select(*[(F.col(f"`{c}`").cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp the smallest node that links reach.

    Every round takes the smallest label among a node and its neighbours, then the label's own label (pointer
    jumping), so that the rounds grow with the logarithm of a path's length. Each round is written to the shared
    folder. Minima are aggregated on the map side, so a node with a third of all links is no hot key.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(near, "node", "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("comp").alias("top"))
        once = new.join(up, "next", "left").select("node", F.col("comp").alias("was"), F.least("next", F.coalesce("top", "next")).alias("next"))
        jumped = written(once.join(up, "next", "left").select("node", F.least("next", F.coalesce("top", "next")).alias("comp"), "was"), f"{name}-labels")
        changed = jumped.where("comp < was").limit(1).count()
        forget(labels)
        labels = jumped.drop("was")
        labels._written_path = jumped._written_path
        if not changed:
            forget(both)
            return labels


# Words: maximal runs of bytes that are not ASCII white space, ASCII letters lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0] = 255  # a byte that UTF-8 never holds: only white space is 0
_LOWER[[9, 10, 11, 12, 13, 32]] = 0
_PRIME, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PINV = pow(_PRIME, -1, 1 << 64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_PRIME**i and its inverse, mod 2**64, for i < n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()

        def table(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers = table(_PRIME), table(_PINV)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_PRIME)
    h ^= h >> np.uint64(32)
    return h


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of many texts at once: lower-cased buffer, start and end of each word, 64-bit hash of each word, and
    the index of each text's first word (one entry more than texts)."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(_LOWER.tobytes()), np.uint8)
    ends_of = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    solid = buf != 0
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.concatenate(([0], np.searchsorted(starts, ends_of))) if len(texts) else np.zeros(1, np.int64)
    hashes = np.empty(len(starts), np.uint64)
    step = 1 << 15  # bytes hashed at once
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, "right")))
        s0, e0 = int(starts[lo]), int(ends[hi - 1])
        p, inv = _power(e0 - s0 + 1)
        sums = np.zeros(e0 - s0 + 1, np.uint64)
        np.cumsum(buf[s0:e0].astype(np.uint64) * p[: e0 - s0], out=sums[1:])
        a, b = starts[lo:hi] - s0, ends[lo:hi] - s0
        hashes[lo:hi] = (sums[b] - sums[a]) * inv[a]
        lo = hi
    hashes += (ends - starts).astype(np.uint64)
    return buf, starts, ends, mix(hashes), first


def portions(texts: list[bytes | None], size: int = 1 << 22):
    """(first, end) of runs of texts of about size bytes, so that what is made of them at once is bounded."""
    lo = n = 0
    for i, t in enumerate(texts):
        n += len(t or b"")
        if n >= size or i == len(texts) - 1:
            yield lo, i + 1
            lo, n = i + 1, 0


def batch_texts(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
