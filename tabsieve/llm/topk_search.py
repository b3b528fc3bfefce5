"""Exact top-k search by integer inner product: the no-random-access algorithm (NRA), in blocks.

Each dimension is a list of the candidates, sorted by the component; a query reads it from the end that its own
component's sign favours, a round of entries at a time. A candidate's unread components are bounded by the list's value
at the present depth (upper bound) and by the list's last value (lower bound). Each query stops on its own: once no
outsider's upper bound reaches the k-th lower one, only the candidates that still overlap are resolved by final scores.

Blocks of queries meet blocks of candidates (the stated query set against all rows), each block keeps its own lists,
and only k rows of each query and block go on to the final merge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import written
from .vectors import numbered

SCALE = 256
ROUNDS = (0.25, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)  # shares of the lists that are read when bounds are taken
FEW = 8  # times k: so few candidates that overlap are resolved at once
PART = 256  # queries bounded at once
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


class Lists:
    """A block's lists: each dimension's components in order."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n, self.dims = x.shape
        self.values = np.sort(x, axis=0)

    def _bounds(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's components as far as reading to this depth tells, at best and at worst, for lists read from their upper
        ends and (second half) from their lower ends. A component that is read is itself; an unread one is at best the
        list's present value, at worst its last one."""
        top, bottom = self.values[self.n - depth], self.values[depth - 1]
        high = np.concatenate((np.maximum(self.x, top), np.minimum(self.x, bottom)), axis=1)
        low = np.concatenate((np.where(self.x >= top, self.x, self.values[0]), np.where(self.x <= bottom, self.x, self.values[-1])), axis=1)
        return high.astype(np.float32), low.astype(np.float32)

    def candidates(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query, (rows that can be among its k best, with all of these among them; entries it read of each list).
        own: each query's row to leave out, or -1.

        Lists are read on together; each query has bounds of its own and stops by itself, once few rows are left. With
        the components clipped to what is read, the bounds of many queries are one matrix product.
        """
        n, q = self.n, len(queries)
        alive = np.ones((q, n), bool)
        at = np.flatnonzero(own >= 0)
        alive[at, own[at]] = False
        depth = np.full(q, n)
        going = np.flatnonzero(alive.sum(axis=1) > k)
        depth[alive.sum(axis=1) <= k] = 0
        # A query reads a list from the end that its own component's sign favours.
        signed = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1).astype(np.float32)
        # Products are in single precision: what they can be off.
        off = 1.2e-7 * 4 * self.dims * (np.abs(queries) @ np.maximum(np.abs(self.values[0]), np.abs(self.values[-1])))
        for share in ROUNDS:
            t = int(n * share)
            if not len(going) or t < 1:
                continue
            high, low = self._bounds(t)
            lower = signed[going] @ low.T
            lower[~alive[going]] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k]
            alive[going] &= signed[going] @ high.T >= (kth - off[going])[:, None]
            few = alive[going].sum(axis=1) <= FEW * k
            depth[going[few]] = t
            going = going[~few]
        return [np.flatnonzero(x) for x in alive], depth


def nra_block(q: np.ndarray, own: np.ndarray, rid: np.ndarray, x: np.ndarray, k: int):
    """For each query, its k best (query, row, score) among the block's rows, ties to the smaller id; never the row own.

    Rows are given in order of their ids. Final scores are exact: all products are integers below 2**53.
    """
    lists = Lists(x)
    for lo in range(0, len(q), PART):
        found, _ = lists.candidates(q[lo : lo + PART], k, own[lo : lo + PART])
        for i, alive in enumerate(found, lo):
            final = x[alive] @ q[i]
            for c in np.lexsort((alive, -final))[:k]:
                yield i, alive[c], int(final[c])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best other rows.

    Components are floor(scale * x). Vectors that are null, empty or hold null or non-finite components take no part,
    nor do rows with a null vec_id. A query meets the vectors of its own length. Repeated rows are candidates each, and
    queries each: two rows of one id give two lists under it, each holding the other row. Ties go to the smaller
    vec_id. A query without candidates gives no rows.
    """
    rows = numbered(vectors).where("v is not null and vec_id is not null").select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    rows = written(rows.withColumns({"dims": F.size("v"), "uid": F.monotonically_increasing_id()}), "topk")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("queries")).first()
    qb, rb = max(1, math.ceil(n["queries"] / QUERY_BLOCK)), max(1, math.ceil(n["rows"] / ROW_BLOCK))
    block = lambda m, salt: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(m)).cast("int")
    whole = ["dims", "uid", "vec_id", "v"]
    queries = rows.where(F.col("vec_id") % every == 0).select(F.lit(True).alias("q"), block(qb, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("j"), *whole)
    cands = rows.select(F.lit(False).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("i"), block(rb, 2).alias("j"), *whole)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        is_q = t.column("q").to_numpy()
        ids, uid = t.column("vec_id").to_numpy(), t.column("uid").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        qi, ri, s = [], [], []
        if is_q.any() and not is_q.all():
            at = {u: i for i, u in enumerate(uid[~is_q].tolist())}
            own = np.array([at.get(u, -1) for u in uid[is_q].tolist()])
            for a, b, c in nra_block(v[is_q], own, ids[~is_q], v[~is_q], k):
                qi.append(a)
                ri.append(b)
                s.append(c)
        q, r = (np.array(x, np.int64) for x in (qi, ri))
        cols = {"query": uid[is_q][q], "query_id": ids[is_q][q], "vec_id": ids[~is_q][r], "uid": uid[~is_q][r], "score": s}
        return pa.table({c: pa.array(x, pa.int64()) for c, x in cols.items()})

    best = queries.unionByName(cands).groupBy("dims", "i", "j").applyInArrow(run, "query long, query_id long, vec_id long, uid long, score long")
    by = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
