"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors at cosine c or more are at squared distance 2 - 2c or less. After one rotation (seeded, the same for all)
the vectors are cut into low-dimensional blocks; a pair within the whole budget is within its proportional share in one
block at least. Each block is range-joined on its own: a vector goes to the bin of its leading coordinate, and as a
probe to the next bin if its share reaches there. Crowded bins are cut into cells by the block's next coordinates, and a
cell that stays crowded (vectors that are all alike) into parts, each pair of which is one task; so a task's size doesn't
grow with a hot label.

The range join moves the blocks' few coordinates only. Vectors that have a partner in a cell are fetched whole and the
union of candidates is verified by the cosine in double precision; a pair found in several blocks counts in the first
of them only. Equal vectors are collapsed first. No pairs are emitted: a task returns each vector's number of links and
a spanning forest of the links it found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import components, forget, written
from .vectors import numbered

COSINE = 0.98
BLOCK = 8  # dimensions of a block
WIDTH = 2.0  # of a bin, in radii of a block's share
CROWD = 2000  # vectors on each side of a task, about


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _forest(n: int, a: np.ndarray, b: np.ndarray):
    """The links that join two trees, in order."""
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield i, j


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither vanish nor overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def shares(dims: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance: its part of the dimensions."""
    first = np.arange(0, dims, BLOCK)
    return (2 - 2 * cosine) * np.minimum(BLOCK, dims - first) / dims


def candidates(part: np.ndarray, left: np.ndarray, right: np.ndarray, share: float, order: np.ndarray, both: np.ndarray):
    """Pairs (i, j) of rows left x right within the share in this block; two rows that are on both sides once, in this order."""
    sq = (part * part).sum(axis=1)
    for lo in range(0, len(left), 256):
        i = left[lo : lo + 256]
        d = sq[i][:, None] + sq[right][None, :] - 2 * (part[i] @ part[right].T)
        a, b = np.nonzero(d <= share)
        a, b = i[a], right[b]
        ok = ~both[a] | (order[a] < order[b])
        yield a[ok], b[ok]


def placed(reps: DataFrame, cosine: float, seed: int) -> DataFrame:
    """(uid, kind, block, bin, probe, low) of each vector and block: its bin, and as a probe the next one if its share
    reaches there; low holds the block's coordinates, kind the label and the number of dimensions."""

    def place(batches):
        for b in batches:
            uid, label = b.column("uid").to_numpy(), b.column("label").to_numpy()
            vs = b.column("v")
            sizes = np.diff(vs.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                v = vs.take(pa.array(own)).flatten().to_numpy().reshape(-1, d)
                y = units(v) @ rotation(d, seed)
                for k, share in enumerate(shares(d, cosine).tolist()):
                    part = y[:, k * BLOCK : (k + 1) * BLOCK]
                    r = math.sqrt(share) + 1e-6
                    home = np.floor(part[:, 0] / (WIDTH * r)).astype(np.int64)
                    reach = np.flatnonzero(part[:, 0] + r >= (home + 1) * WIDTH * r)
                    at = np.concatenate((np.arange(len(own)), reach))
                    low = part[at].astype(np.float32)
                    cols = {
                        "uid": uid[own][at],
                        "kind": (label[own][at].astype(np.int64) << 32) + d,
                        "block": np.full(len(at), k, np.int32),
                        "bin": np.concatenate((home, home[reach] + 1)),
                        "probe": np.arange(len(at)) >= len(own),
                        "low": pa.ListArray.from_arrays(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32), low.ravel()),
                    }
                    yield pa.record_batch([pa.array(x) for x in cols.values()], list(cols))

    return reps.select("uid", "label", "v").mapInArrow(place, "uid long, kind long, block int, bin long, probe boolean, low array<float>")


def dealt(rows: DataFrame, cosine: float) -> DataFrame:
    """placed(), dealt to tasks: (kind, block, task, uid, side, low). Side 0 meets side 1, and 2 is on both sides.

    A row is on the left in one cell; on the right (unless a probe) in every cell that its share reaches. So each pair
    meets in one cell, and there in one task.
    """
    where = ["kind", "block", "bin"]
    crowd = rows.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    # The number of further coordinates that cut a crowded bin: each has some five cells that matter.
    crowd = crowd.withColumn("cuts", F.when(F.col("n") > 64 * CROWD, 3).when(F.col("n") > 8 * CROWD, 2).otherwise(1)).drop("n")
    rows = rows.join(written(crowd, "near-vectors-crowd"), where, "left")
    dims = F.col("kind").bitwiseAND((1 << 32) - 1)
    r = F.sqrt(F.lit(2 - 2 * cosine) * F.least(F.lit(BLOCK), dims - F.col("block") * BLOCK) / dims) + 1e-6

    def cell(k, by=0):
        """The cell of the row's coordinate k, moved by so many shares."""
        x = F.coalesce(F.get("low", F.lit(k)), F.lit(0.0)).cast("double")
        return F.when(F.col("cuts") >= k, F.floor((x + by * r) / (r * WIDTH))).otherwise(F.lit(0)).cast("long")

    whole = rows.where("cuts is null").select(*where, F.lit(0).cast("long").alias("cell"), "uid", F.when(F.col("probe"), 0).otherwise(2).alias("side"), "low")
    cut = rows.where("cuts is not null")
    left = cut.select(*where, F.xxhash64(cell(1), cell(2), cell(3)).alias("cell"), "uid", F.lit(0).alias("side"), "probe", "low")
    right = cut.where("not probe")
    for k in (1, 2, 3):
        right = right.withColumn(f"c{k}", F.explode(F.sequence(cell(k, -1), cell(k, 1))))
    right = right.select(*where, F.xxhash64("c1", "c2", "c3").alias("cell"), "uid", F.lit(1).alias("side"), "probe", "low")
    cells = left.unionByName(right)
    full = cells.groupBy(*where, "cell").agg(F.greatest(F.sum((F.col("side") == 0).cast("int")), F.sum(F.col("side"))).alias("n")).where(F.col("n") > CROWD)
    full = full.select(*where, "cell", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    cells = cells.join(written(full, "near-vectors-cells"), [*where, "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own, other = F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = cells.withColumn("own", own).withColumn("other", other)
    p, q = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    # Side 0 of a vector that isn't a probe meets its own row on side 1: told by uid. Probes are 0, the others 3.
    cells = cells.select("kind", "block", F.xxhash64("bin", "cell", p, q).alias("task"), "uid", F.when((F.col("side") == 0) & ~F.col("probe"), 3).otherwise(F.col("side")).alias("side"), "low")
    return whole.select("kind", "block", F.xxhash64("bin").alias("task"), "uid", "side", "low").unionByName(cells)


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows on the left, on the right, whether a left row belongs to a vector that is on the right side as well)."""
    return np.flatnonzero(side != 1), np.flatnonzero((side == 1) | (side == 2)), side >= 2


def near_vectors(vectors: DataFrame, cosine: float = COSINE, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, and their cosine is `cosine` or more. A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, and neither do vectors of unlike lengths.
    Components may be as small or large as doubles can be. Repeated rows count as vectors of their own (a row of equal
    id links too). A null vec_id stays null; it is the component's id only if no other is there. Empty input gives no
    rows.
    """
    rows = numbered(vectors)
    rows = rows.withColumn("v", F.when(F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = written(rows.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json("v")).cast("binary"), 256)).alias("key")), "near-vectors")
    reps = written(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("uid", F.monotonically_increasing_id()), "near-vectors-reps")

    def search(t: pa.Table) -> pa.Table:
        """Of a task's rows, those with a partner in this block."""
        kind, block = t.column("kind")[0].as_py(), t.column("block")[0].as_py()
        uid, side = t.column("uid").to_numpy(), t.column("side").to_numpy()
        low = t.column("low").combine_chunks().flatten().to_numpy().reshape(len(uid), -1).astype(np.float64)
        share = shares(kind & 0xFFFFFFFF, cosine)[block] + 1e-6
        hit = np.zeros(len(uid), bool)
        left, right, both = _sides(side)
        for i, j in candidates(low, left, right, share, uid, both):
            hit[i] = hit[j] = True
        return t.select(["kind", "block", "task", "uid", "side"]).filter(pa.array(hit))

    at = written(placed(reps, cosine, seed), "near-vectors-placed")
    found = dealt(at, cosine).groupBy("kind", "block", "task").applyInArrow(search, "kind long, block int, task long, uid long, side int")
    found = written(found, "near-vectors-candidates")
    forget(at)

    def verify(t: pa.Table) -> pa.Table:
        """Links of a task's candidates: counted, and a spanning forest."""
        d, block = t.column("kind")[0].as_py() & 0xFFFFFFFF, t.column("block")[0].as_py()
        uid, copies, side = t.column("uid").to_numpy(), t.column("copies").to_numpy(), t.column("side").to_numpy()
        unit = units(t.column("v").combine_chunks().flatten().to_numpy().reshape(len(uid), d))
        y = unit @ rotation(d, seed)
        share = shares(d, cosine) + 1e-9  # a little more, as sums round

        def near(i, j, k):
            x = y[i, k * BLOCK : (k + 1) * BLOCK] - y[j, k * BLOCK : (k + 1) * BLOCK]
            return (x * x).sum(axis=1) <= share[k]

        u, node = np.unique(uid, return_inverse=True)  # a vector can be on both sides, in a row each
        links, a, b = np.zeros(len(u), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right, both = _sides(side)
        for i, j in candidates(y[:, block * BLOCK : (block + 1) * BLOCK], left, right, share[block] + 1e-7, uid, both):
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                ok = near(p, q, block)
                for k in range(block):
                    ok[ok] = ~near(p[ok], q[ok], k)
                p, q = p[ok], q[ok]
                ok = (unit[p] * unit[q]).sum(axis=1) >= cosine
                x, z = node[p[ok]], node[q[ok]]
                np.add.at(links, x, copies[q[ok]])
                np.add.at(links, z, copies[p[ok]])
                edges = np.array(list(_forest(len(u), x, z)), np.int64).reshape(-1, 2)
                a.append(edges[:, 0])
                b.append(edges[:, 1])
        edges = np.array(list(_forest(len(u), np.concatenate(a), np.concatenate(b))), np.int64).reshape(-1, 2)
        has = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate((u[has], u[edges[:, 0]])), pa.int64()),
            "b": pa.array([None] * len(has) + u[edges[:, 1]].tolist(), pa.int64()),
            "links": pa.array(links[has].tolist() + [None] * len(edges), pa.int64()),
        })

    fetched = found.join(reps.select("uid", "copies", "v"), "uid")
    links = written(fetched.groupBy("kind", "block", "task").applyInArrow(verify, "a long, b long, links long"), "near-vectors-links")
    forget(found)
    comp = components(links.where("b is not null").select("a", "b"), "near-vectors")
    sums = links.where("links is not null").groupBy(F.col("a").alias("uid")).agg(F.sum("links").alias("links"))
    label = reps.select("key", "uid", "least", "copies").join(sums, "uid", "left").join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    label = label.join(label.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select(F.col("key").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "key").join(label, F.col("key") == F.col("k2"), "left")
    comp_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


def op1_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# Cosines of scaled vectors, in the operator's order of steps; components as the fixed point of smallest labels.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS uid, vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings
), p AS (
  SELECT a.uid AS a, b.uid AS b
  FROM v a JOIN v b ON a.label = b.label AND a.uid <> b.uid AND len(a.e) = len(b.e)
  WHERE a.sound AND b.sound AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT uid, uid AS other FROM v
  UNION
  SELECT reach.uid, p.b FROM reach JOIN p ON p.a = reach.other
), comp AS (
  SELECT reach.uid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.uid = reach.other GROUP BY reach.uid
), n AS (SELECT a AS uid, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, coalesce(v.vec_id = comp.component_id, false) AS kept
FROM v JOIN comp USING (uid) LEFT JOIN n USING (uid)
"""
