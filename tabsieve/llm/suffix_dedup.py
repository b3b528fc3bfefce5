"""Removal of repeated passages: every byte covered by a LENGTH-byte string that also starts earlier.

Suffixes are compared by their first LENGTH bytes only, so the order inside a bucket needs no full suffix array. Two
steps, both blockwise:

1. Cover sample. A difference cover D of period V holds, for any two positions, a shift below V that brings both onto
   the cover. So of two equal strings at p and q, some sampled string of LENGTH - V + 1 bytes at p + d equals the one at
   q + d. Sampled strings are ranked bucket by bucket (by fingerprint): those of rank groups with one member drop out,
   and only suffixes within V bytes of a repeated sample go on.
2. Suffix buckets. Each remaining suffix belongs to one bucket by its fingerprint; a bucket is sorted at a time, its
   suffixes in the order of the corpus, and all but the first of equal ones are repeats.

Texts stay in chunks of about CHUNK bytes, in order of doc_id, in a table bucketed by chunk in the warehouse. Between
chunks and buckets only sorted fingerprints (3 bytes a sampled string, 6 a suffix, about) and bits go back and forth,
each distinct string once a chunk, so neither a frequent line nor a large group of copies makes a task large.
Fingerprints have 64 bits for suffixes.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import _power, batch_texts, bounded_batches, forget, mix, written

LENGTH = 100
# A perfect difference set modulo 57; every residue is a difference of two of them.
V, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = LENGTH - V + 1
CHUNK = 8 << 20
BLOCK = 1 << 15


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the string of this length at each position at which one fits."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    p, inv = _power(BLOCK + length + 1)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        part = data[lo : hi + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=sums[1:])
        out[lo:hi] = mix((sums[length : length + hi - lo] - sums[: hi - lo]) * inv[: hi - lo])
    return out


def packed(x: np.ndarray, width: int) -> bytes:
    """Sorted distinct numbers as differences of `width` bytes; in full where one doesn't fit."""
    d = np.diff(x, prepend=x[:1])
    if not len(x) or int(d.max()) >= 1 << (8 * width):
        return b"\0" + x.astype("<u8").tobytes()
    return b"\1" + int(x[0]).to_bytes(8, "little") + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(b: bytes, width: int) -> np.ndarray:
    if b[0] == 0:
        return np.frombuffer(b, "<u8", offset=1)
    raw = np.frombuffer(b, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel()) + np.uint64(int.from_bytes(b[1:9], "little"))


class Chunk:
    """A chunk's texts, one after the other."""

    def __init__(self, data: bytes, lens: list[int]):
        self.data = np.frombuffer(data, np.uint8)
        self.lens = np.array(lens, np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def _fits(self, length: int) -> np.ndarray:
        """Whether a string of this length at the position stays within its text."""
        n = max(0, len(self.data) - length + 1)
        edge = np.zeros(n + 1, np.int32)
        ok = self.lens >= length
        np.add.at(edge, self.starts[ok], 1)
        np.add.at(edge, self.starts[ok] + self.lens[ok] - length + 1, -1)
        return np.cumsum(edge)[:n] > 0

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the cover sample, their fingerprints)."""
        cover = np.zeros(V, bool)
        cover[list(COVER)] = True
        shape = [cover[: n % V] if n < V else np.resize(cover, n) for n in self.lens.tolist()]
        on = np.concatenate(shape) if shape else np.zeros(0, bool)
        ok = self._fits(SAMPLE)
        at = np.flatnonzero(on[: len(ok)] & ok)
        return at, fingerprints(self.data, SAMPLE)[at]

    def suspects(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions within V of a repeated sample whose string fits, their fingerprints)."""
        ok = self._fits(LENGTH)
        if not len(ok):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hit = np.zeros(len(self.data) + V + 1, np.int32)
        hit[repeated + 1] = 1
        upto = np.cumsum(hit)
        at = np.flatnonzero(ok & (upto[V : V + len(ok)] > upto[: len(ok)]))
        return at, fingerprints(self.data, LENGTH)[at] if len(at) else np.zeros(0, np.uint64)


def _cut(x: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of fingerprints begins in sorted ones, and the end."""
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))


def _bits(of: dict[int, bytes], cut: np.ndarray) -> np.ndarray:
    """The buckets' answers, put together in the order of the sorted fingerprints."""
    return np.concatenate([np.unpackbits(np.frombuffer(of[k], np.uint8), count=int(cut[k + 1] - cut[k])).astype(bool) if cut[k + 1] > cut[k] else np.zeros(0, bool) for k in range(len(cut) - 1)])


def _sample_groups(c: Chunk):
    """(positions, distinct fingerprints, each position's one, whether it occurs twice here). Sampled strings are told by the
    upper 56 bits less the lowest: equal ones are never missed."""
    at, h = c.samples()
    u, inv, n = np.unique(h >> np.uint64(24) << np.uint64(24), return_inverse=True, return_counts=True)
    return at, u, inv, n > 1


def chunked(docs: DataFrame, text: str, chunk_bytes: int) -> tuple[DataFrame, int, str]:
    """(table (chunk, ids, lens, data) bucketed by chunk, number of chunks, the table's name). Chunks follow the order of doc_id, null first.

    Rows of one id (or without any) that make up more than a chunk are dealt to chunks of their own, by row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), F.monotonically_increasing_id().alias("row"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    bounds = rows.stat.approxQuantile("doc_id", [k / chunks for k in range(1, chunks)], 0.1 / chunks) if chunks > 1 else []
    edges = np.array(sorted({int(x) for x in bounds}), np.int64)
    least = -(1 << 63)
    # Ids of which one alone would fill a chunk: there are fewer of them than chunks.
    large = rows.groupBy(F.coalesce("doc_id", F.lit(least)).alias("id")).agg(F.sum(F.octet_length("t")).alias("n")).where(F.col("n") > chunk_bytes).collect()
    # Where chunks begin: (id, part of the id). A large id has parts of its own, and the next id begins a chunk.
    starts = {(int(e) + 1, 0) for e in edges} | {(least, 0)}
    parts = {r["id"]: math.ceil(r["n"] / chunk_bytes) for r in large}
    starts |= {(i, k) for i, n in parts.items() for k in range(n)} | {(i + 1, 0) for i in parts}
    starts = sorted(starts)
    at = spark.sparkContext.broadcast((np.array([i for i, _ in starts], np.int64), parts))

    def place(batches):
        begin, large_ids = at.value
        for b in batches:
            ids = b.column(0).fill_null(least).to_numpy()
            c = np.searchsorted(begin, ids, "right") - 1  # a large id's last part
            for i, n in large_ids.items():
                own = np.flatnonzero(ids == i)
                c[own] -= (mix(b.column(2).to_numpy()[own].astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)
            yield pa.record_batch([b.column(0), pa.array(batch_texts(b.column(1)), pa.binary()), pa.array(c.astype(np.int64))], ["doc_id", "t", "chunk"])

    def build(t: pa.Table) -> pa.Table:
        texts, ids = t.column("t").to_pylist(), t.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or b""))
        own = [texts[i] or b"" for i in order]
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "ids": pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), "lens": pa.array([[len(x) for x in own]], pa.list_(pa.int32())), "data": pa.array([b"".join(own)], pa.binary())})

    name, chunks = f"tabsieve_chunks_{uuid.uuid4().hex}", len(starts)
    made = rows.mapInArrow(place, "doc_id long, t binary, chunk long").repartition(chunks, "chunk").groupBy("chunk").applyInArrow(build, "chunk long, ids array<long>, lens array<int>, data binary")
    made.write.option("compression", "zstd").bucketBy(min(chunks, 100_000), "chunk").saveAsTable(name)
    return spark.table(name), chunks, name


def drop(out: DataFrame) -> None:
    """Removes the tables behind a result of remove_repeats(), once it has been used."""
    table, *written_ = out._behind
    out.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    for df in written_:
        forget(df)


def remove_repeats(docs: DataFrame, text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) of every row: the removed spans in bytes, and what is left.

    A null text is empty. A null doc_id sorts before all others; rows with equal ids sort by their text (where they fill
    several chunks: within a chunk). Repeated rows are texts of their own, of which the first is kept. Texts below LENGTH bytes lose nothing. Empty input gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    table, ranges, name = chunked(docs, text, chunk_bytes)

    def send(chunk: int, u: np.ndarray, width: int) -> pa.Table:
        cut = _cut(u, ranges)
        some = [k for k in range(ranges) if cut[k + 1] > cut[k]]
        shift = np.uint64(24 if width == 3 else 0)
        return pa.table({"range": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int64()), "keys": pa.array([packed(u[cut[k] : cut[k + 1]] >> shift, width) for k in some], pa.binary())})

    def sample(batches):
        for b in batches:
            for chunk, lens, data in zip(*(b.column(x).to_pylist() for x in ("chunk", "lens", "data")), strict=True):
                _, u, _, _ = _sample_groups(Chunk(data, lens))
                yield from send(chunk, u, 3).to_batches()

    def answer(width: int, first: bool):
        """Per bucket: which of each chunk's strings occur in another chunk (or, if first, in an earlier one)."""

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("chunk")
            parts = [unpacked(b, width) for b in t.column("keys").to_pylist()]
            x = np.concatenate(parts)
            order = np.argsort(x, kind="stable")
            same = x[order][1:] == x[order][:-1]
            flag = np.zeros(len(x), bool)
            flag[order[1:]] = same
            if not first:
                flag[order[:-1]] |= same
            ends = np.cumsum([len(p) for p in parts])
            return pa.table({"chunk": t.column("chunk"), "range": t.column("range"), "bits": pa.array([np.packbits(flag[e - len(p) : e]).tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())})

        return run

    keys, bits = "range int, chunk long, keys binary", "chunk long, range int, bits binary"
    repeated = written(table.mapInArrow(sample, keys).groupBy("range").applyInArrow(answer(3, False), bits), "suffix-samples")

    def suspects(c: Chunk, of: dict[int, bytes]):
        at, u, inv, twice = _sample_groups(c)
        flag = twice | _bits(of, _cut(u, ranges)) if len(u) else twice
        p, h = c.suspects(at[flag[inv]] if len(at) else at)
        return p, *np.unique(h, return_index=True, return_inverse=True)

    def suffixes(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"range": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})
        of = dict(zip(right.column("range").to_pylist(), right.column("bits").to_pylist(), strict=True))
        _, u, _, _ = suspects(Chunk(left.column("data")[0].as_py(), left.column("lens")[0].as_py()), of)
        return send(key[0].as_py(), u, 6)

    found = table.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(suffixes, keys)
    later = written(found.groupBy("range").applyInArrow(answer(6, True), bits), "suffix-buckets")

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in types})
        steps, ranges_, given = (right.column(x).to_pylist() for x in ("step", "range", "bits"))
        of = [{r: b for s, r, b in zip(steps, ranges_, given, strict=True) if s == k} for k in (1, 2)]
        c = Chunk(left.column("data")[0].as_py(), left.column("lens")[0].as_py())
        p, u, index, inv = suspects(c, of[0])
        gone = np.zeros(len(c.data) + 1, np.int32)
        if len(p):
            again = np.ones(len(p), bool)  # all but the first here ...
            again[index] = _bits(of[1], _cut(u, ranges))  # ... and the first, if an earlier chunk has it
            np.add.at(gone, p[again], 1)
            np.add.at(gone, np.minimum(p[again] + LENGTH, len(c.data)), -1)
        covered = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for s, n in zip(c.starts.tolist(), c.lens.tolist(), strict=True):
            m = covered[s : s + n]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], m, [False])).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            kept.append(c.data[s : s + n][~m].tobytes())
        values = (left.column("ids")[0].as_py(), c.lens.tolist(), spans, kept)
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(types, values, strict=True)})

    both = repeated.withColumn("step", F.lit(1)).unionByName(later.withColumn("step", F.lit(2)))
    out = table.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    out._behind = (name, repeated, later)
    return out


def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    digests = written(digests, "suffix-digests")
    drop(out)
    return digests
