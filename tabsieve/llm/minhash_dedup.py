"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF word shingles, banded and verified.

Shingles are five words (a shorter text is one shingle). A shingle's weight is (1 + ln tf) times the sum of its words'
inverse document frequencies, which are counted over all documents; words are counted by hash in a table of fixed size,
so what is broadcast doesn't grow with the data. Shingle counts of the whole corpus would be as large as the corpus.

The unit of work is the distinct text (words lower-cased, white space folded), so copies are never compared. Texts
that share a band of their signatures are linked through stars: everyone is compared with the bucket's CENTRES most
central members, those whose buckets are the largest. Members that this leaves apart from the bucket's first component
are compared with all the bucket's other components block by block, and only links leave a block. No step emits all
pairs of a group, and none stops early.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import batch_texts, bounded_batches, components, forget, mix, portions, words, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4  # finds a pair of similarity 0.8 with probability 0.9994, one of 0.85 with 0.99999
SLOTS = 1 << 18  # hashed words in the table of document frequencies
PART = 400  # members of a part of a bucket
CENTRES = 4  # of each bucket's stars
SPLIT = 20_000  # members of a bucket that are joined by bucket in one part
SURELY_LESS = 0.57  # a pair of which fewer samples agree is not verified: at similarity 0.8 that has a chance below 0.0001


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """(documents in which each hashed word occurs, number of documents), over all rows."""

    def count(batches):
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            texts = batch_texts(b.column(0))
            n += len(texts)
            for lo, hi in portions(texts):
                _, _, _, h, first = words(texts[lo:hi])
                slot = (h >> np.uint64(64 - 18)).astype(np.int64)
                of = np.repeat(np.arange(hi - lo), np.diff(first))
                order = np.unique(of << 18 | slot)
                total += np.bincount(order & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, SLOTS)), pa.array(np.append(total[at], n))], ["slot", "n"])

    rows = docs.select(text).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS + 1, np.int64)
    df[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n + 1.0) / (df + 1.0)).astype(np.float32)


def weighted_shingles(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, sorted; their weights) of a text's word hashes; none for a text without words."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    n = max(1, len(h) - SHINGLE + 1)
    w = idf[(h >> np.uint64(64 - 18)).astype(np.int64)]
    k = min(SHINGLE, len(h))
    s, weight = np.full(n, k, np.uint64), np.zeros(n, np.float32)
    for j in range(k):
        s = (s + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(31)
        weight += w[j : j + n]
    shingles, at, tf = np.unique(s, return_index=True, return_counts=True)
    return shingles, weight[at] * (1 + np.log(tf.astype(np.float32)))


@lru_cache(1)
def _hash_salts() -> np.ndarray:
    return mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(2, -1)


def signature(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ICWS: for each hash function, a 64-bit hash of the sampled (shingle, level)."""
    salts = _hash_salts()
    k = salts.shape[1]
    best, pick = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
    lw = np.log(weights)
    unit = np.float32(2.0**-21)
    for lo in range(0, len(shingles), 512):
        s = shingles[lo : lo + 512, None]
        a = mix(s ^ salts[0])
        b = (s + salts[1]) * np.uint64(0x9E3779B97F4A7C15)
        b ^= b >> np.uint64(29)
        b *= np.uint64(0xD6E8FEB86659FD93)
        low = np.uint64((1 << 21) - 1)

        def u(x, shift, low=low):
            return ((x >> np.uint64(shift)) & low).astype(np.float32) * unit + unit / 2

        r = -np.log(u(a, 0) * u(a, 21))
        lc = np.log(-np.log(u(a, 42) * u(b, 43)))
        beta = u(b, 22)
        t = np.floor(lw[lo : lo + 512, None] / r + beta)
        la = lc - r * (t - beta) - r
        i = la.argmin(axis=0)
        col = np.arange(k)
        la = la[i, col]
        better = la < best
        best[better] = la[better]
        chosen = mix(shingles[lo + i] + t[i, col].astype(np.int64).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        pick[better] = chosen[better]
    return pick


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima. Two texts without words are alike."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low)


def _signatures(docs: DataFrame, idf, text: str) -> DataFrame:
    """(doc_id, th, tkey, bands, sig, total) of every row: hash of the text as it is, key of the distinct text, band keys, 15 bits of each sample, weight."""

    def run(batches):
        table = idf.value
        for b in batches:
            texts = batch_texts(b.column("t"))
            keys, bands, sigs, totals = [], [], [], []
            for lo, hi in portions(texts, 1 << 20):
                part = texts[lo:hi]
                _, _, _, h, first = words(part)
                for i in range(len(part)):
                    own = h[first[i] : first[i + 1]]
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    s, w = weighted_shingles(own, table)
                    sig = signature(s, w)
                    by = np.zeros(BANDS, np.uint64)
                    for j in range(ROWS):
                        by = mix(by * np.uint64(0x9E3779B97F4A7C15) + sig[j::ROWS])
                    bands.append(by.view(np.int64) if len(s) else np.zeros(0, np.int64))
                    sigs.append((sig >> np.uint64(49)).astype(np.int16))
                    totals.append(float(w.sum(dtype=np.float64)))
            yield pa.record_batch([b.column("doc_id"), b.column("th"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int16())), pa.array(totals)], ["doc_id", "th", "tkey", "bands", "sig", "total"])

    return docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, th long, tkey binary, bands array<long>, sig array<smallint>, total double")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Of distinct pairs (a, b) of text keys, those whose weighted Jaccard similarity is THRESHOLD or more.

    salt parts the partners of a central text: its text is sent once to each part, ahead of the partners' texts, and
    parts are read as they come, so neither a task nor a worker's memory grows with a centre.
    """
    partners = pairs.join(texts.select(F.col("tkey").alias("b"), "t"), "b").select("a", "salt", "b", "t")
    centres = pairs.select("a", "salt").distinct().join(texts.select(F.col("tkey").alias("a"), "t"), "a").select("a", "salt", F.lit(None).cast("binary").alias("b"), "t")

    def check(batches):
        table, left = idf.value, None
        for x in batches:
            a, b, texts_ = x.column("a").to_pylist(), x.column("b").to_pylist(), batch_texts(x.column("t"))
            ok = []
            for i in range(len(a)):
                own = weighted_shingles(words([texts_[i]])[3], table)
                if b[i] is None:
                    left = own
                elif weighted_jaccard(left, own) >= THRESHOLD:
                    ok.append(i)
            yield pa.record_batch([pa.array([a[i] for i in ok], pa.binary()), pa.array([b[i] for i in ok], pa.binary())], ["a", "b"])

    dealt = centres.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "t").mapInArrow(check, "a binary, b binary")


def _salts(n: str = "n") -> Column:
    """Into how many parts a bucket of n members is cut where it is joined by bucket."""
    return F.ceil(F.col(n) / SPLIT).cast("int")


def _all_salts(df: DataFrame) -> DataFrame:
    """One row of df (bucket, n, ...) for each part of the bucket, as (bucket, salt, ...)."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts() - 1))).drop("n")


def _compared(now: DataFrame, rest: DataFrame, unit: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b) between the members of rest (bucket, tkey) and their buckets' members of other components.

    A bucket is cut into parts of about PART members; each part of rest meets each part of the bucket in one task, so no
    task grows with a bucket. A pair is looked at in the smallest bucket that both have, once.
    """
    whole = now.join(_all_salts(rest.select("bucket", "n").distinct()), ["bucket", "salt"], "left_semi").select("tkey", "bucket", "comp").join(rest.select("bucket", "tkey", F.lit(True).alias("rest")), ["bucket", "tkey"], "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    sizes = whole.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    lists = now.groupBy("tkey").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # BANDS at most
    full = whole.join(sizes, "bucket").join(lists, "tkey").join(unit.select("tkey", "sig", "total"), "tkey").join(texts, "tkey")
    full = full.withColumn("own", F.pmod(F.xxhash64("tkey"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    left = full.where("rest").select(F.lit(True).alias("left"), "bucket", F.col("own").alias("p"), F.explode(every).alias("q"), "tkey", "comp", "rest", "buckets", "sig", "total", "t")
    right = full.select(F.lit(False).alias("left"), "bucket", F.explode(every).alias("p"), F.col("own").alias("q"), "tkey", "comp", "rest", "buckets", "sig", "total", "t")

    def run(t: pa.Table) -> pa.Table:
        table = idf.value
        side, rest_ = t.column("left").to_numpy(), t.column("rest").to_numpy()
        bucket = t.column("bucket")[0].as_py()
        key, comp = np.array(t.column("tkey").to_pylist(), object), np.array(t.column("comp").to_pylist(), object)
        total = t.column("total").to_numpy()
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
        lists_ = t.column("buckets").to_pylist()
        lefts, rights = np.flatnonzero(side), np.flatnonzero(~side)
        out = [], []
        if len(lefts) and len(rights):
            texts_ = batch_texts(t.column("t"))
            _, _, _, h, first = words([texts_[i] for i in rights])
            sets = [weighted_shingles(h[first[i] : first[i + 1]], table) for i in range(len(rights))]
            for x in lefts:
                ok = (comp[rights] != comp[x]) & (~rest_[rights] | (key[rights] > key[x]))
                ok &= np.minimum(total[rights], total[x]) >= (THRESHOLD - 1e-4) * np.maximum(total[rights], total[x])
                at = np.flatnonzero(ok)
                at = at[(sig[rights[at]] == sig[x]).sum(axis=1) >= int(BANDS * ROWS * SURELY_LESS)]
                mine = set(lists_[x])
                at = [i for i in at if min(mine.intersection(lists_[rights[i]])) == bucket]
                if not at:
                    continue
                s, w = weighted_shingles(words([texts_[x]])[3], table)
                flat, weight = np.concatenate([sets[i][0] for i in at]), np.concatenate([sets[i][1] for i in at])
                place = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                low = np.where(s[place] == flat, np.minimum(w[place], weight), 0).astype(np.float64)
                low = np.add.reduceat(low, np.cumsum([0, *(len(sets[i][0]) for i in at[:-1])]))
                for i, v in zip(at, low, strict=True):
                    if v / (total[x] + total[rights[i]] - v) >= THRESHOLD:
                        out[0].append(key[x])
                        out[1].append(key[rights[i]])
        return pa.table({"a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})

    return left.unionByName(right).groupBy("bucket", "p", "q").applyInArrow(run, "a binary, b binary")


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    """(tkey, comp) of every member."""
    found = components(links, "minhash").withColumnRenamed("node", "tkey")
    return written(member.select("tkey").distinct().join(found, "tkey", "left").select("tkey", F.coalesce("comp", "tkey").alias("comp")), "minhash-comp")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, class_id, kept, text_hash) for every row: class_id is the smallest doc_id among texts that links reach, kept is
    true for one row of each class.

    Nulls: a null text counts as empty; empty and white-space texts are one class. A null doc_id stays null and is
    never the class id unless its class has no other. Unrelated texts whose ids are all null, or that repeat an id, have
    the same class_id but are classes of their own, and one row of each is kept. Repeated rows share their class; one
    of them is kept. Empty input gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias(text))
    idf = spark.sparkContext.broadcast(idf_table(*document_frequencies(rows, text)))
    signed = written(_signatures(rows, idf, text), "minhash-signed")
    # One line for each distinct text; in each bucket its members, if there are two.
    unit = written(signed.groupBy("tkey").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("total").alias("total")), "minhash-texts")
    member = unit.select("tkey", F.posexplode("bands").alias("band", "key"))
    crowded = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = member.join(crowded, ["band", "key"]).select("tkey", F.xxhash64("band", "key").alias("bucket"), "n")
    central = member.groupBy("tkey").agg(F.sum("n").alias("crowd"))
    member = written(member.join(central, "tkey").select("tkey", "bucket", "crowd", "n", F.pmod(F.xxhash64("tkey"), _salts()).cast("int").alias("salt")), "minhash-members")
    # Texts of the members, one line for each.
    holder = signed.groupBy("tkey").agg(F.min(F.struct("doc_id", "th")).alias("h")).select("tkey", "h.*").join(member.select("tkey").distinct(), "tkey", "left_semi")
    texts = _texts_of(rows, holder, text)
    texts = written(texts, "minhash-members-texts")

    # Stars: everyone with the bucket's most central members.
    by = W.partitionBy("bucket").orderBy(F.desc("crowd"), "tkey")
    centre = member.withColumn("place", F.row_number().over(by)).where(F.col("place") <= CENTRES).select("bucket", "n", F.col("tkey").alias("a"))
    pairs = member.select("bucket", "salt", F.col("tkey").alias("b"), "n").join(_all_salts(centre), ["bucket", "salt"]).where("a != b")
    # The same two texts can meet in several buckets, and be centres to each other: one pair, the smaller key's.
    pairs = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.col("a") < F.col("b")).alias("first"), F.max("n").alias("n"))
    pairs = pairs.select(F.when(F.col("first"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("first"), F.col("y")).otherwise(F.col("x")).alias("b"), "n")
    pairs = written(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PART)).cast("int").alias("salt")), "minhash-pairs")
    links = written(_verified(pairs, texts, idf), "minhash-links")
    forget(pairs)
    comp = _labelled(member, links)
    # Left: members outside the bucket's first component that were no centre, with all the bucket's other components.
    now = written(member.select("tkey", "bucket", "n", "salt").join(comp, "tkey"), "minhash-now")
    stats = now.groupBy("bucket").agg(F.min("comp").alias("main"), F.max("comp").alias("other"), F.max("n").alias("n")).where("main < other")
    rest = now.join(_all_salts(stats), ["bucket", "salt"]).where("comp != main").join(centre.select("bucket", F.col("a").alias("tkey")), ["bucket", "tkey"], "left_anti").select("bucket", "tkey", "n")
    rest = written(rest, "minhash-rest")
    more = written(_compared(now, rest, unit, texts, idf), "minhash-links")
    if more.limit(1).count():
        comp = _labelled(member, links.unionByName(more))
    for done in (texts, now, rest, more, links):
        forget(done)
    label = unit.select("tkey", "least").join(comp, "tkey", "left").withColumn("comp", F.coalesce("comp", "tkey"))
    label = label.join(label.groupBy("comp").agg(F.min("least").alias("class_id")), "comp").select("tkey", "comp", "class_id")
    label = written(label, "minhash-labels")
    out = signed.select("doc_id", "th", "tkey", F.monotonically_increasing_id().alias("line")).join(label, "tkey")
    # By component: unrelated classes can have the same class_id, or none.
    first = out.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "line")).alias("m")).select(F.col("m.line").alias("kept_line"))
    return out.join(first, F.col("line") == F.col("kept_line"), "left").select("doc_id", "class_id", F.col("kept_line").isNotNull().alias("kept"), F.col("th").alias("text_hash"))


def _texts_of(rows: DataFrame, holder: DataFrame, text: str) -> DataFrame:
    """(tkey, t), once for each tkey: the text of its first holder."""
    rows = rows.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    return rows.join(holder, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).groupBy("tkey").agg(F.first("t").alias("t"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, one of each class. Rows that repeat a kept row's doc_id and text go as well."""
    found = written(near_duplicates(docs, text), "minhash-classes")
    keys = ["doc_id", "text_hash"]
    # A key is dropped if no row of it is kept; rows with the same key are the same text under the same id.
    by = found.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    by = written(by.where("not kept or n > 1"), "minhash-dropped")
    gone = by.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("gone_hash")), "left_anti")
    return out.dropDuplicates(["doc_id", text]) if by.where("kept").limit(1).count() else out


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
