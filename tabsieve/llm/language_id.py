"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of letters (one space between words) of a bounded, documented sample of labelled texts; the
log-probability matrix (languages x 65,536 buckets) is broadcast. Scoring hashes a batch of whole texts at once in
numpy, a long text block by block, sums the rows of the matrix that the n-grams hit, and never moves a text.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import batch_texts, bounded_batches, portions

ORDERS = (1, 2, 3)
BITS = 16
DOCS_PER_LANG = 4000  # bound of the training sample: about so many documents of each language, by hash of the id
MAX_LANGS = 1000  # the matrix is broadcast: more languages than this raise an error
STEP = 1 << 18  # bytes hashed at once
HITS = 1 << 22  # log probabilities looked up at once, whatever the number of languages

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else itself."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((i if unicodedata.category(chr(i))[0] == "L" else 0 for i in range(0x110000)), np.uint32, 0x110000)
    return _letter


def _buckets(flat: np.ndarray, last: np.ndarray) -> np.ndarray:
    """buckets x orders of the n-grams from each position on. Rows whose n-gram holds no letter, or that begin at a
    position marked last, have bucket 2**BITS."""
    out = np.full((len(flat), len(ORDERS)), 1 << BITS, np.int32)
    some = flat != 0
    for j, n in enumerate(ORDERS):
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B9, np.uint64)
        any_letter = np.zeros(m, bool)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            any_letter |= some[k : k + m]
        out[:m, j] = np.where(any_letter & ~last[:m], (h >> np.uint64(64 - BITS)).astype(np.int32), 1 << BITS)
    return out


def _points(text: str) -> np.ndarray:
    """The letters' code points; 0 for others."""
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets x orders, first row of each text and the end, number of letters of each text)."""
    width = max(ORDERS) - 1
    points = [_points(t.decode("utf-8", "replace").lower()) if t else np.zeros(0, np.uint32) for t in texts]
    pad = np.zeros(width, np.uint32)
    flat = np.concatenate([x for p in points for x in (pad[:1], p, pad)]) if points else pad
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 + width for p in points]))).astype(np.int64)
    last = np.zeros(len(flat), bool)
    for k in range(width):
        last[starts[1:] - 1 - k] = True
    # Runs of other characters count as one space.
    keep = (flat != 0) | last
    keep[1:] |= flat[:-1] != 0
    keep[starts[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    flat, last, starts = flat[keep], last[keep], kept[starts]
    letters = np.add.reduceat(flat != 0, starts[:-1]) if len(points) else np.zeros(0, np.int64)
    return _buckets(flat, last), starts, letters


def _grams_of_long(text: bytes):
    """The rows of _grams for one long text, a block at a time (an n-gram across blocks is counted once), each with the
    block's number of letters."""
    width = max(ORDERS) - 1
    points = text.decode("utf-8", "replace").lower()
    carry, before = np.zeros(1, np.uint32), 0  # the space before the text
    for lo in range(0, len(points), STEP):
        p = _points(points[lo : lo + STEP])
        keep = p != 0
        keep[1:] |= p[:-1] != 0
        keep[0] |= before != 0
        before = p[-1]
        p = p[keep]
        flat = np.concatenate((carry, p, np.zeros(width if lo + STEP >= len(points) else 0, np.uint32)))
        rows, carry = _buckets(flat, np.zeros(len(flat), bool))[: max(0, len(flat) - width)], flat[-width:]
        yield rows, int((p != 0).sum())


def _pieces(texts: list[bytes | None]):
    """(first, end) of runs of short texts, and of each text of more than STEP bytes alone."""
    lo = 0
    for i, t in enumerate(texts):
        if t and len(t) > STEP:
            yield from ((lo + a, lo + b) for a, b in portions(texts[lo:i], STEP))
            yield i, i + 1
            lo = i + 1
    yield from ((lo + a, lo + b) for a, b in portions(texts[lo:], STEP))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages by name, matrix of log probabilities; its last column is 0). docs: the labelled rows to learn from;
    rows with a null label or text teach nothing. A language of more than docs_per_lang documents is sampled by hash."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("l is not null")
    n = {r["l"]: r["n"] for r in docs.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the matrix would be too large to broadcast")
    if not n:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    names = sorted(n)
    rate = F.lit(0.0)
    for x in names:
        rate = F.when(F.col("l") == x, min(1.0, docs_per_lang / n[x])).otherwise(rate)
    sample = docs.where((F.pmod(F.xxhash64(F.lit("language"), "k"), F.lit(1 << 30)) < rate * (1 << 30)) & F.col("t").isNotNull())
    code = {x: i for i, x in enumerate(names)}

    def count(batches):
        total = np.zeros((len(names), (1 << BITS) + 1), np.int64)
        for b in batches:
            texts, of = batch_texts(b.column("t")), np.array([code[x] for x in b.column("l").to_pylist()])
            for lo, hi in _pieces(texts):
                if len(texts[lo] or b"") > STEP:
                    for rows, _ in _grams_of_long(texts[lo]):
                        total[of[lo]] += np.bincount(rows.ravel(), minlength=total.shape[1])
                    continue
                rows, starts, _ = _grams(texts[lo:hi])
                for i in range(hi - lo):
                    total[of[lo + i]] += np.bincount(rows[starts[i] : starts[i + 1]].ravel(), minlength=total.shape[1])
        at = np.nonzero(total[:, :-1])
        yield pa.record_batch([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[:, :-1][at])], ["l", "bucket", "n"])

    counts = sample.select("t", "l").mapInArrow(count, "l int, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toArrow()
    m = np.full((len(names), (1 << BITS) + 1), 0.5)
    m[counts["l"].to_numpy(), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    m = np.log(m / m[:, :-1].sum(axis=1, keepdims=True))
    m[:, -1] = 0
    return names, m.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the posterior probability of the prediction at equal priors.

    A text that is null, empty or without any letter gives `und` and score 0, as does every text if nothing was
    learned. Ties go to the language first by name. Repeated rows are predicted alike; other columns pass through,
    except such named lang_pred or score, which are replaced.
    """
    names, matrix = model
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = keep.index(text)

    rows_at_once = max(1000, HITS // max(1, len(names)))

    def summed(table, rows, starts=None):
        """The log probabilities of each text's rows (all of them one text's, if starts is None)."""
        out = np.zeros((1 if starts is None else len(starts) - 1, len(names)))
        for lo in range(0, len(rows), rows_at_once):
            hit = table[rows[lo : lo + rows_at_once, 0]]
            for j in range(1, rows.shape[1]):
                hit += table[rows[lo : lo + rows_at_once, j]]
            if starts is None:
                out[0] += hit.sum(axis=0, dtype=np.float64)
                continue
            first, end = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, lo + len(hit), "left")
            out[first:end] += np.add.reduceat(hit, np.maximum(starts[first:end] - lo, 0), axis=0, dtype=np.float64)
        return out

    def predict(batches):
        table = shared.value
        for b in batches:
            texts = batch_texts(b.column(at))
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for lo, hi in _pieces(texts) if names else ():
                if len(texts[lo] or b"") > STEP:
                    sums, letters = np.zeros((1, len(names))), np.zeros(1, np.int64)
                    for rows, n in _grams_of_long(texts[lo]):
                        sums += summed(table, rows)
                        letters += n
                else:
                    rows, starts, letters = _grams(texts[lo:hi])
                    sums = summed(table, rows, starts)
                best = sums.argmax(axis=1)
                p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                ok = np.flatnonzero(letters)
                pred[lo + ok], score[lo + ok] = np.array(names, object)[best[ok]], p[ok]
            yield pa.record_batch([*b.columns, pa.array(pred, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(predict, schema)


def held_out(key: str | Column, mod: int = 4, remainder: int = 2) -> Column:
    """Whether the document is kept from training: crc32 of its id as text; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == remainder


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
