"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs, beside an additive unigram baseline.

Each word (and the end of a text, which is the word before a text's first one) has a restaurant of its own: its customers
are the words that follow it. Their tables are customers of the one restaurant of words, whose base is uniform over all
words seen and one unseen. A word's probability is that of its restaurant's context, unseen words share one dish.

Seating is sampled by Gibbs in blocks: all customers of one dish in one restaurant leave and sit down again one after
the other by the Chinese-restaurant rule, given the tables and the parent's probabilities of the sweep before. Long queues
sit down in parties of an eighth of those seated, whose new tables are drawn at once. Numbers drawn hang on the words
alone. Scores take the seats' averages over the samples, so each context's probabilities sum to one.

Nothing that grows with the corpus is broadcast or sent to the driver. Texts are cut into chunks; a chunk's distinct pairs
go to parts by their second word (hash ranges), those of the most common words by both words. A part keeps its pairs as
arrays, so words' customers are at hand; the tables of contexts are summed in other parts, by blocks of arrays, each sweep.
At the end parts answer each chunk in the order of its pairs, and its texts, read again, meet the answers.
"""

from __future__ import annotations

import gc
import pickle
import time
import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_folder
from ._shared import batch_texts, bounded_batches, forget, mix, words, written
from .language_id import held_out

SYMBOLS = 64
DISCOUNT = (0.5, 0.6, 0.7, 0.75)  # of symbols, by their number in the context
STRENGTH = (1.0, 1.0, 1.0, 1.0)
WORD_STRENGTH, PAIR_STRENGTH = 10.0, 1.0
BURN_IN, SAMPLES = 1, 3
ALPHA = 0.1
COMMON = 10_000  # words with a larger share of all than one in COMMON: there are no more than that
CHUNK = 1 << 23  # bytes of text whose pairs are told apart at once
PART_TOKENS, MOST_PARTS = 1 << 21, 1 << 13
END, REST = -1, -2  # the end of a text as a word; all words that are not common, in sums
STATE, REPLY = -1, -(1 << 40)  # tags of blocks: replies come first, then the state, then what chunks have
BLOCK = "q int, tag long, blob binary"


def _word_ids(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64)


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of each word: ranges of hashes, so sorted words are sorted by part."""
    return np.maximum((ids >> 32) * parts >> 31, 0)


def _pair_hash(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix(w.astype(np.uint64) ^ mix(u.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def _pack(*values) -> bytes:
    """Values as bytes. Integers from 0 on take as few bytes as the largest one needs; arrays are written as all
    their numbers' first bytes, then all second ones and so on, which compresses better."""
    out = []
    for x in values:
        if isinstance(x, np.ndarray):
            if x.dtype == np.int64 and x.min(initial=0) >= 0:
                x = x.astype(np.min_scalar_type(x.max(initial=0)))
            x = (x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
        out.append(x)
    raw = pickle.dumps(out, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list:
    """What _pack was given, integers as int64 again."""
    out = []
    for x in pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)):
        if isinstance(x, tuple):
            size = np.dtype(x[0]).itemsize
            raw = np.frombuffer(x[1], np.uint8)
            x = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(x[0])
            x = x.astype(np.int64) if x.dtype.kind in "iu" else x
        out.append(x)
    return out


def _steps(ids: np.ndarray) -> np.ndarray:
    """Sorted words as steps from one to the next, which are shorter."""
    return np.diff(ids, prepend=END)


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps) + END


def _blocks(rows):
    q, tag, blob = zip(*rows, strict=True)
    return pa.record_batch([pa.array(q, pa.int32()), pa.array(tag, pa.int64()), pa.array(blob, pa.binary())], ["q", "tag", "blob"])


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py()


def _grouped(blocks: DataFrame, parts: int, run) -> DataFrame:
    """run(q, iterator of (tag, blob) by tag) of each part, which yields rows of other blocks."""

    def each(batches):
        for q, rows in groupby(_rows(batches), key=lambda r: r[0]):
            for row in run(q, (r[1:] for r in rows)):
                yield _blocks([row])

    return blocks.repartition(parts, "q").sortWithinPartitions("q", "tag").mapInArrow(each, BLOCK)


def _chunks(batches):
    """(number, texts, ids, whether to learn from each) of about CHUNK bytes of text; the same whenever rows are read."""
    number, size, kept = TaskContext.get().partitionId() << 32, 0, ([], [], [])
    for b in batches:
        for row in zip(batch_texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for x, y in zip(kept, row, strict=True):
                x.append(y)
            size += len(row[0] or b"")
            if size >= CHUNK:
                yield number, *kept
                number, size, kept = number + 1, 0, ([], [], [])
    if kept[0]:
        yield number, *kept


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """The words and ends of texts, and the number of each text's."""
    _, _, _, h, first = words(texts)
    return np.insert(_word_ids(h), first[1:], END), np.diff(first) + 1


def _pairs(w: np.ndarray, parts: int, common: np.ndarray):
    """Distinct words, sorted; distinct pairs as part, word and word before (places among those), sorted; each token's pair."""
    ids, at = np.unique(w, return_inverse=True)
    before = np.concatenate((np.zeros(1, np.int64), at[:-1]))  # an end is the smallest word
    q = _home(ids, parts)[at]
    spread = np.flatnonzero(np.isin(ids, common)[at])
    q[spread] = _home(_word_ids(_pair_hash(w[spread], ids[before[spread]])), parts)
    if len(ids) >= 1 << 25:
        raise ValueError("a text has more than 2**25 different words")
    key, place = np.unique(q << 50 | at << 25 | before, return_inverse=True)
    return ids, key >> 50, key >> 25 & (1 << 25) - 1, key & (1 << 25) - 1, place


def common_words(docs: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """(words, at most most, whose share of a chunk and of all is above one in COMMON; the number of tokens)."""

    def run(batches):
        for _, texts, _, _ in _chunks(batches):
            w = _tokens(texts)[0]
            ids, n = np.unique(w, return_counts=True)
            often = n > len(w) / COMMON
            yield pa.record_batch([pa.array(np.append(ids[often], REST)), pa.array(np.append(n[often], len(w)))], ["id", "n"])

    sums = docs.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = (sums.where(F.col("id") == REST).agg(F.sum("n")).first()[0]) or 0
    often = sums.where((F.col("id") != REST) & (F.col("n") > total / COMMON)).orderBy(F.desc("n"), "id").limit(most).collect() if most and total else []
    return np.array(sorted(r["id"] for r in often), np.int64), total


def binomial_by_hash(key: np.ndarray, seed: int):
    """A binomial draw of the customers at hand, by numbers that hang on each one's key and its earlier draws alone: the same
    whatever batch a key is in. The gaps between successes are geometric."""
    used = np.full(len(key), seed << 32, np.uint64)

    def draw(live: np.ndarray, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        out, left, going = np.zeros(len(m), np.int64), m.astype(np.float64), np.arange(len(m))
        fails = np.log1p(-np.minimum(p, 1 - 1e-12))
        while len(going):
            at = live[going]
            used[at] += np.uint64(1)
            x = mix(key[at] ^ mix(used[at] * np.uint64(0x9E3779B97F4A7C15)))
            left[going] -= np.floor(np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / fails[going]) + 1
            going = going[left[going] >= 0]
            out[going] += 1
            going = going[left[going] > 0]
        return out

    return draw


def seat(c: np.ndarray, new: np.ndarray, other: np.ndarray, d: float, strength: float, draw) -> np.ndarray:
    """Tables of c customers of one dish, seated one after the other. new: the parent's probability of the dish; other:
    the restaurant's tables of other dishes; draw(live, m, p): binomial numbers for the dishes that live tells."""
    t = np.ones(len(c), np.int64)
    n = np.ones(len(c), np.int64)
    live = np.flatnonzero(c > 1)
    while len(live):
        m = np.minimum(np.maximum(1, n[live] // 8), c[live] - n[live])
        w = (strength + d * (other[live] + t[live])) * new[live]
        t[live] += draw(live, m, w / (n[live] - d * t[live] + w))
        n[live] += m
        live = live[n[live] < c[live]]
    return t


def hierarchical_pitman_yor(g: np.ndarray, counts: np.ndarray, order: int, burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = 1) -> np.ndarray:
    """P(symbol | order - 1 symbols) for all 64**order, averaged over Gibbs samples of the seating: a hierarchy in memory,
    of deeper contexts than word pairs. The query has no part in it."""
    rng = np.random.default_rng(seed)
    mean = np.zeros(SYMBOLS**order, np.float32)
    # Cells of each order: the n-gram by its last symbols; cells[k] of order k + 1.
    cells = [np.unique(g % SYMBOLS ** (k + 1)) for k in range(order)]
    up = [np.searchsorted(cells[k - 1], cells[k] % SYMBOLS**k) for k in range(1, order)]
    tables = [np.ones(len(x), np.int64) for x in cells]

    def customers(k):
        return counts if k == order - 1 else np.bincount(up[k], weights=tables[k + 1], minlength=len(cells[k])).astype(np.int64)

    def room(k, x):
        """Sums over the restaurant of each cell of order k + 1."""
        return np.bincount(cells[k] // SYMBOLS, weights=x, minlength=SYMBOLS**k)

    def predictive(upto):
        """Dense probabilities of orders 1 to upto."""
        p, out = np.full(SYMBOLS, 1 / SYMBOLS, np.float32), []
        for k in range(upto):
            c = customers(k)
            total, seated = room(k, c), room(k, tables[k])
            back = ((STRENGTH[k] + DISCOUNT[k] * seated) / (STRENGTH[k] + total)).astype(np.float32)
            up_to = SYMBOLS ** max(0, k - 1)
            q = (back.reshape(-1, up_to, 1) * p.reshape(1, up_to, SYMBOLS)).reshape(-1)
            q[cells[k]] += ((c - DISCOUNT[k] * tables[k]) / (STRENGTH[k] + total[cells[k] // SYMBOLS])).astype(np.float32)
            p = q
            out.append(q)
        return out  # the last one has 64 MB, the others 1 MB and less

    for sweep in range(burn_in + samples):
        probs = predictive(order - 1)
        for k in range(order - 1, -1, -1):
            parent = probs[k - 1][cells[k] % SYMBOLS**k].astype(np.float64) if k else np.full(len(cells[0]), 1 / SYMBOLS)
            other = room(k, tables[k])[cells[k] // SYMBOLS] - tables[k]
            tables[k] = seat(customers(k), parent, other, DISCOUNT[k], STRENGTH[k], lambda _, m, p: rng.binomial(m, p))
        if sweep >= burn_in:
            mean += predictive(order)[-1]
    mean /= samples
    return mean


class Part:
    """The pairs of one part, sorted by word and word before: counts, tables, tables summed over samples."""

    FIELDS = ("w", "runs", "u", "at", "n", "t", "sat", "tau", "tau_sat")

    def __init__(self, *values):
        self.__dict__.update(zip(self.FIELDS, values, strict=True))
        self.of = np.repeat(np.arange(len(self.w)), self.runs)

    def blob(self) -> bytes:
        return _pack(_steps(self.w), self.runs, _steps(self.u), *(getattr(self, f) for f in self.FIELDS[3:]))

    @classmethod
    def of_blob(cls, blob: bytes) -> Part:
        w, runs, u, *x = _unpack(blob)
        return cls(_from_steps(w), runs, _from_steps(u), *x)

    def by_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=x, minlength=len(self.w)).astype(np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=x, minlength=len(self.u)).astype(np.int64)


def _known(ids: np.ndarray, mine: np.ndarray, common: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """A value of each word: the part's own, that of all parts for common words."""
    if not len(common):
        return mine
    at = np.minimum(np.searchsorted(common, ids), len(common) - 1)
    return np.where(common[at] == ids, theirs[at], mine)


def _merged(q: int, rows):
    """One state of what chunks counted, and each chunk's places in it."""
    tags, got = [], []
    for tag, blob in rows:
        tags.append(tag)
        ws, runs, us, *x = _unpack(blob)
        got.append((_from_steps(ws), runs, _from_steps(us), *x))
    w, of = np.unique(np.concatenate([x[0] for x in got]), return_inverse=True)
    u, at = np.unique(np.concatenate([x[2] for x in got]), return_inverse=True)
    of = np.repeat(of, np.concatenate([x[1] for x in got]))
    start = np.cumsum([0] + [len(x[2]) for x in got])
    at = at[np.concatenate([x[3] + i for x, i in zip(got, start[:-1], strict=True)])]
    n = np.concatenate([x[4] for x in got])
    cut = np.cumsum([0] + [len(x[4]) for x in got])
    del got
    key, place = np.unique(of << 32 | at, return_inverse=True)
    n = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)
    none, t = np.zeros(len(key), np.int64), (n > 0).astype(np.int64)
    of = key >> 32
    seen = np.bincount(of, weights=n, minlength=len(w)) > 0
    yield q, STATE, Part(w, np.bincount(of, minlength=len(w)), u, key & (1 << 32) - 1, n, t, none, seen.astype(np.int64), np.zeros(len(w), np.int64)).blob()
    for tag, i, j in zip(tags, cut[:-1], cut[1:], strict=True):
        yield q, tag, _pack(np.diff(place[i:j], prepend=0))


def _summed(r: int, rows):
    """Sums over all parts for the contexts at home in r, told to each part in its own order."""
    got = [(tag, *_unpack(blob)) for tag, blob in rows]
    u, at = np.unique(np.concatenate([_from_steps(x[1]) for x in got]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate(x), minlength=len(u)).astype(np.int64) for x in zip(*(x[2:] for x in got), strict=True)]
    cut = np.cumsum([0] + [len(x[1]) for x in got])
    for (q, *_), i, j in zip(got, cut[:-1], cut[1:], strict=True):
        yield q, REPLY + r, _pack(*(x[at[i:j]] for x in sums))


def _with_contexts(rows):
    """(sums of the contexts, the state) of a part, before what chunks have."""
    told = []
    for tag, blob in rows:
        if tag == STATE:
            return [np.concatenate(x) for x in zip(*told, strict=True)], Part.of_blob(blob)
        told.append(_unpack(blob))
    raise ValueError("a part has no state")


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", mod: int = 10, remainder: int = 0, broadcast_words: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learned from the rows that
    aren't held out. broadcast_words: so many common words at most are spread over all parts, their counts broadcast.

    A null text is empty: one token, the end. A null id counts as the text '' when rows are held out. Repeated rows
    teach and are scored each. With nothing to learn from, all counts are 0 and every token is the one unseen word.
    Empty input gives no rows. Other columns are not read. Rows are read again for their scores, in the same order.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 64)  # blocks are larger than texts
    rows = docs.select(F.col(text).cast("string").alias("t"), F.col(key).cast("long").alias("doc_id")).withColumn("learn", ~held_out("doc_id", mod, remainder))
    common, tokens = common_words(rows, min(broadcast_words, COMMON))
    parts = min(MOST_PARTS, tokens // PART_TOKENS + 1)

    def drop_shuffles():
        """Spark deletes the files of shuffles that nothing refers to any more, once both collectors ran. Another thread
        tells the JVM what Python let go of, so it's given a moment, twice."""
        for _ in range(2):
            gc.collect()
            time.sleep(0.3)
            spark._jvm.System.gc()

    def stored(blocks: DataFrame, name: str) -> DataFrame:
        out = written(blocks, name)
        del blocks
        drop_shuffles()
        return out

    def counted(batches):
        for number, texts, _, learn in _chunks(batches):
            w, size = _tokens(texts)
            ids, q, of, before, place = _pairs(w, parts, common)
            n = np.bincount(place, weights=np.repeat(np.array(learn, bool), size), minlength=len(q)).astype(np.int64)
            del w, place
            cut = np.searchsorted(q, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)).tolist():
                at = slice(cut[p], cut[p + 1])
                ws, runs = np.unique(of[at], return_counts=True)
                us, u = np.unique(before[at], return_inverse=True)
                yield _blocks([(p, number, _pack(_steps(ids[ws]), runs, _steps(ids[us]), u, n[at]))])

    path = f"{shared_folder(spark)}/lm-pairs-{uuid.uuid4().hex}"
    _grouped(rows.mapInArrow(counted, BLOCK), parts, _merged).withColumn("state", F.when(F.col("tag") == STATE, 1).otherwise(0)).write.option("compression", "zstd").partitionBy("state").parquet(path)
    drop_shuffles()

    def part_of(kind: int) -> DataFrame:
        """The first states or the places, which are let go of apart; none if there are no rows."""
        out = spark.read.schema(BLOCK).parquet(f"{path}/state={kind}") if tokens else spark.createDataFrame([], BLOCK)
        out._written_path = f"{path}/state={kind}"
        return out

    state, places = part_of(1), part_of(0)

    def sums(state: DataFrame):
        """Of all words but common ones: (n, customers, tables, summed tables, words, met once, twice), of pairs: once, twice; of common words: n, customers."""

        def run(batches):
            for _, _, blob in _rows(batches):
                s = Part.of_blob(blob)
                n, c = s.by_word(s.n), s.by_word(s.t)
                own = ~np.isin(s.w, common)
                x = [n[own].sum(), c[own].sum(), s.tau[own].sum(), s.tau_sat[own].sum(), (n[own] > 0).sum(), (c[own] == 1).sum(), (c[own] == 2).sum(), (s.n == 1).sum(), (s.n == 2).sum()]
                some = ~own
                cols = [np.append(s.w[some], REST), np.append(n[some], x[0]), np.append(c[some], x[1])] + [np.append(np.zeros(some.sum(), np.int64), y) for y in x[2:]]
                yield pa.record_batch([pa.array(y.astype(np.int64)) for y in cols], ["id", *(f"x{i}" for i in range(9))])

        got = state.mapInArrow(run, "id long, " + ", ".join(f"x{i} long" for i in range(9))).groupBy("id").agg(*(F.sum(f"x{i}").alias(f"x{i}") for i in range(9))).collect()
        by = {r["id"]: list(r)[1:] for r in got}
        return np.array(by.get(REST, [0] * 9), np.int64), np.array([by.get(i, [0, 0])[0] for i in common.tolist()], np.int64), np.array([by.get(i, [0, 0])[1] for i in common.tolist()], np.int64)

    rest, common_n, common_c = sums(state)
    n, v = int(rest[0] + common_n.sum()), int(rest[4] + (common_n > 0).sum())
    once, twice = rest[5] + (common_c == 1).sum(), rest[6] + (common_c == 2).sum()
    d, d_pair = (once + 1) / (once + 2 * twice + 2), (rest[7] + 1) / (rest[7] + 2 * rest[8] + 2)
    uniform = 1 / (v + 1)

    def contexts(state: DataFrame, *fields: str) -> DataFrame:
        """Sums of these fields of the pairs over each context."""

        def run(batches):
            for q, _, blob in _rows(batches):
                s = Part.of_blob(blob)
                x = [s.by_context(getattr(s, f)) for f in fields]
                cut = np.searchsorted(_home(s.u, parts), np.arange(parts + 1))
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    yield _blocks([(r, q, _pack(_steps(s.u[cut[r] : cut[r + 1]]), *(y[cut[r] : cut[r + 1]] for y in x)))])

        return _grouped(state.mapInArrow(run, BLOCK), parts, _summed)

    def seated_words(ids, c, tau, total, sweep):
        """Tables of the words' customers, seated anew."""
        out, some = np.zeros(len(c), np.int64), np.flatnonzero(c)
        out[some] = seat(c[some], np.full(len(some), uniform), total - tau[some], d, WORD_STRENGTH, binomial_by_hash(mix(ids[some].astype(np.uint64)), 2 * sweep))
        return out

    common_tau = (common_c > 0).astype(np.int64)
    common_sat, customers_sat = np.zeros(len(common), np.int64), 0
    common_c_sat = np.zeros(len(common), np.int64)
    for sweep in range(BURN_IN + SAMPLES):
        keep = sweep >= BURN_IN
        customers, total = int(rest[1] + common_c.sum()), int(rest[2] + common_tau.sum())

        def seated(q, rows, customers=customers, total=total, common_c=common_c, common_tau=common_tau, sweep=sweep, keep=keep):
            (tables,), s = _with_contexts(rows)
            c, tau = _known(s.w, s.by_word(s.t), common, common_c), _known(s.w, s.tau, common, common_tau)
            p = (c - d * tau + (WORD_STRENGTH + d * total) * uniform) / (WORD_STRENGTH + customers)
            live = np.flatnonzero(s.n)
            of, at = s.of[live], s.at[live]
            t = seat(s.n[live], p[of], tables[at] - s.t[live], d_pair, PAIR_STRENGTH, binomial_by_hash(_pair_hash(s.w[of], s.u[at]), 2 * sweep + 1))
            s.t[live] = t
            s.tau = seated_words(s.w, s.by_word(s.t), s.tau, total, sweep)
            if keep:
                s.sat, s.tau_sat = s.sat + s.t, s.tau_sat + s.tau
            yield q, STATE, s.blob()

        before, state = state, stored(_grouped(state.unionAll(contexts(state, "t")), parts, seated), "lm-seats")
        forget(before)
        rest, _, common_c = sums(state)
        common_tau = seated_words(common, common_c, common_tau, total, sweep)
        if keep:
            common_sat, common_c_sat = common_sat + common_tau, common_c_sat + common_c
            customers_sat += int(rest[1] + common_c.sum())
    customers, total = customers_sat / SAMPLES, (int(rest[3]) + int(common_sat.sum())) / SAMPLES

    def answered(q, rows):
        (met, tables), s = _with_contexts(rows)
        c = _known(s.w, s.by_word(s.sat), common, common_c_sat) / SAMPLES
        tau = _known(s.w, s.tau_sat, common, common_sat) / SAMPLES
        p = (c - d * tau + (WORD_STRENGTH + d * total) * uniform) / (WORD_STRENGTH + customers)
        p = p[s.of] * (PAIR_STRENGTH + d_pair * tables[s.at] / SAMPLES) + s.n - d_pair * s.sat / SAMPLES
        p = np.log10(p / (PAIR_STRENGTH + met[s.at])).astype(np.float32)
        counts = _known(s.w, s.by_word(s.n), common, common_n)
        for number, blob in rows:
            place = np.cumsum(_unpack(blob)[0])
            of = s.of[place]
            yield q, number, _pack(p[place], counts[of[np.flatnonzero(np.diff(of, prepend=-1))]])

    def placed(batches):
        for number, texts, ids, _ in _chunks(batches):
            w, size = _tokens(texts)
            _, q, of, _, place = _pairs(w, parts, common)
            new = np.diff(q << 25 | of, prepend=-1) != 0
            yield pa.record_batch([pa.array([number]), pa.array([-1]), pa.array([_pack(ids, size, place, len(new), np.packbits(new))], pa.binary())], ["chunk", "part", "blob"])

    denominator = float(np.log10(n + ALPHA * (v + 1)))

    def scored(batches):
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            (_, first, blob), *answers = group
            ids, size, place, pairs, new = _unpack(blob)
            of = np.cumsum(np.unpackbits(new.astype(np.uint8), count=pairs), dtype=np.int64) - 1
            answers = [_unpack(a[2]) for a in answers]
            p, c = (np.concatenate(x) for x in zip(*answers, strict=True))
            if first != -1 or len(p) != len(of) or len(c) != of[-1] + 1:
                raise ValueError("the documents were read in another order the second time")
            text_of, c = np.repeat(np.arange(len(size)), size), c[of]
            sums = [np.bincount(text_of, weights=x[place], minlength=len(size)) for x in (c > 0, np.log10(c + ALPHA) - denominator, p.astype(np.float64))]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(size), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    answers = stored(_grouped(state.unionAll(contexts(state, "n", "sat")).unionAll(places), parts, answered), "lm-answers")
    forget(state)
    forget(places)
    answers = answers.select(F.col("tag").alias("chunk"), F.col("q").cast("long").alias("part"), "blob")
    out = rows.mapInArrow(placed, "chunk long, part long, blob binary").unionAll(answers).repartition(parts, "chunk").sortWithinPartitions("chunk", "part")
    out = out.mapInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out("doc_id", mod, remainder).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op8_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
