"""Lexical retrieval packing: documents into training windows, each filled with a seed's nearest unused neighbours.

Texts are tokenized whole and written as ids. Document frequencies of the ids are counted over all documents (a table
of the vocabulary's size). Documents are dealt by hash into shards of about SHARD_TOKENS ids; a shard builds a BM25
inverted index of its documents, and every window asks it for the unused documents nearest to its seed, which fill the
window in that order. A document that no longer fits is cut, and its rest seeds the next window, so only a shard's last
window is padded.
"""

from __future__ import annotations

import math
import os
import zlib
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import batch_texts, bounded_batches, words, written

WINDOW = 2048
END = 1
SHARD_TOKENS = 2_000_000
ASKED = 64  # neighbours ranked at first; further ones are ranked while the window has room
K1, B = 1.2, 0.75
CACHED_WORDS = 1_800_000  # a worker's cache of words is emptied beyond this

_encoders: dict = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts. The tokenizer splits at white space, so each distinct word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self._clear()

    def _clear(self):
        self.at, self.start, self.length, self.flat = {}, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END; where each text's ids begin, and the end)."""
        special = [i for i, t in enumerate(texts) if t and b"<|" in t]  # may hold a special token: encoded as a whole
        texts = [None if t and b"<|" in t else t for t in texts] if special else texts
        whole = {i: np.array(e.ids, np.uint16) for i, e in zip(special, self.tok.encode_batch_fast([self._orig[i].decode("utf-8", "replace") for i in special], add_special_tokens=False), strict=True)} if special else {}
        _, s, e, h, first = words(texts)
        inv, uniq = pd.factorize(h)  # by hash, without a sort
        where = np.zeros(len(uniq), np.int64)
        where[inv[::-1]] = np.arange(len(inv) - 1, -1, -1)  # of a word's places, the first stays
        if len(self.at) > CACHED_WORDS:
            self._clear()
        at = self.at
        rows = np.fromiter(map(at.get, uniq.tolist(), repeat(-1)), np.int64, len(uniq))
        new = np.flatnonzero(rows < 0)
        if len(new):
            raw = b" ".join(t or b"" for t in texts)  # as written: buf is lower-cased
            first_at = where[new]
            ids = [x.ids for x in self.tok.encode_batch_fast([raw[i:j].decode("utf-8", "replace") for i, j in zip(s[first_at].tolist(), e[first_at].tolist(), strict=True)], add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = len(self.flat) + np.cumsum(length) - length
            rows[new] = len(self.start) + np.arange(len(new))
            at.update(zip(uniq[new].tolist(), rows[new].tolist(), strict=True))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint16, int(length.sum()))))
            self.start, self.length = np.concatenate((self.start, begin.astype(np.int32))), np.concatenate((self.length, length.astype(np.int32)))
        row = rows[inv]
        n = self.length[row]
        upto = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))  # of a few MB of text: fits 32 bits
        ids = self.flat[np.repeat(self.start[row] - upto[:-1].astype(np.int32), n) + np.arange(upto[-1], dtype=np.int32)]
        bounds = upto[first]
        parts = []
        for i in range(len(texts)):
            parts += [whole[i] if i in whole else ids[bounds[i] : bounds[i + 1]], np.array([END], np.uint16)]
        sizes = np.array([len(whole[i]) + 1 if i in whole else bounds[i + 1] - bounds[i] + 1 for i in range(len(texts))], np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), np.concatenate(([0], np.cumsum(sizes)))

    def __call__(self, texts: list[bytes | None], step: int = 1 << 22):
        """Arrays of ids, text by text, a few MB of text at a time."""
        lo = size = 0
        for i in range(len(texts)):
            size += len(texts[i] or b"")
            if size >= step or i == len(texts) - 1:
                self._orig = texts[lo : i + 1]
                ids, at = self.encode(self._orig)
                for k in range(i + 1 - lo):
                    yield ids[at[k] : at[k + 1]]
                lo, size = i + 1, 0


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, n) of every row; ids little-endian unsigned 16-bit numbers, the last of them END."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = batch_texts(b.column("t"))
            for lo in range(0, len(texts), 1000):
                ids = list(enc(texts[lo : lo + 1000]))
                yield pa.record_batch([b.column("doc_id").slice(lo, 1000), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, ids binary, n long")


def id_frequencies(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id occurs, over all of them."""

    def count(batches):
        total, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                ids = np.frombuffer(x, np.uint16)
                place = np.arange(len(ids))
                last[ids] = place  # of an id's places in the document, one stays
                total[ids[last[ids] == place]] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


class Index:
    """BM25 over one shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(docs)
        of = np.repeat(np.arange(self.n, dtype=np.int64), [len(d) for d in docs])
        key, tf = np.unique(of << 16 | np.concatenate(docs), return_counts=True)
        own = key & 0xFFFF != END  # every document has it
        key, tf = key[own], tf[own]
        self.doc, self.term = key >> 16, key & 0xFFFF
        size = np.array([len(d) for d in docs])[self.doc]
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))
        order = np.argsort(self.term, kind="stable")
        self.posting, self.weight = self.doc[order], weight[order].astype(np.float64)
        self.at = np.searchsorted(self.term[order], np.arange((1 << 16) + 1))
        # Terms of an eighth of the documents or more have a row for all documents: together 8 x the postings at most.
        common = np.flatnonzero(np.diff(self.at) * 8 >= max(1, self.n))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for i, t in enumerate(common):
            a, b = self.at[t], self.at[t + 1]
            self.rows[i, self.posting[a:b]] = self.weight[a:b]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for all of the seed's terms."""
        terms = self.term[self.first[seed] : self.first[seed + 1]]
        rows = self.row[terms]
        rare = terms[rows < 0]
        spans = list(zip(self.at[rare].tolist(), self.at[rare + 1].tolist(), strict=True))
        if spans:
            out = np.bincount(np.concatenate([self.posting[a:b] for a, b in spans]), np.concatenate([self.weight[a:b] for a, b in spans]), self.n)
        else:
            out = np.zeros(self.n)
        common = rows[rows >= 0]
        for lo in range(0, len(common), 64):  # row by row for each document alike, so equal documents' sums are equal
            out += np.add.reduce(self.rows[common[lo : lo + 64]], axis=0)
        return out


def ranked(score: np.ndarray, asked: int = ASKED):
    """The documents of positive score, best first and equal ones in order; ranked as far as they are asked for."""
    at = np.flatnonzero(score > 0)
    while len(at):
        now, s = at, score[at]
        if len(at) > asked:
            least = np.partition(s, len(at) - asked)[len(at) - asked]
            now, at = at[s >= least], at[s < least]
        else:
            at = at[:0]
        yield from now[np.lexsort((now, -score[now]))].tolist()
        asked *= 4


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) in order of sequence and offset."""
    index = Index(docs, idf, mean)
    free = np.ones(len(docs), bool)
    seq, room, seed, start, nxt = 0, window, -1, 0, 0
    while True:
        if seed < 0:  # a new seed: the next unused document
            while nxt < len(docs) and not free[nxt]:
                nxt += 1
            if nxt == len(docs):
                return
            seed, start = nxt, 0
            free[seed] = False
        left = len(docs[seed]) - start
        take = min(left, room)
        yield seed, start, take, seq, window - room
        room -= take
        if not room:
            seq, room = seq + 1, window
            if left > take:
                start += take
                continue
            seed = -1
            continue
        score = np.where(free, index.scores(seed), 0)
        seed = -1
        for k in ranked(score):
            free[k] = False
            take = min(len(docs[k]), room)
            yield k, 0, take, seq, window - room
            room -= take
            if not room:
                seq, room = seq + 1, window
                if take < len(docs[k]):
                    seed, start = k, take
                break


def pack(docs: DataFrame, path: str | None = None, text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, seed: int = 5) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit) and
    ids_crc32. Every id of every row of docs lies in one piece.

    A null or empty text has only the id END. A null doc_id stays null. Repeated rows are packed each for itself.
    Documents with equal scores go by their order in the shard (doc_id, then ids). Empty input gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokens = written(tokenized(docs, path or tokenizer_file(), text), "packing-ids")
    df = id_frequencies(tokens)
    total = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).first()
    n, count = total["n"] or 0, total["docs"]
    idf = spark.sparkContext.broadcast(np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32))  # one number an id of the vocabulary
    mean = n / max(1, count)
    shards = max(1, math.ceil(n / shard_tokens))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        names, arrays = table.column("doc_id").to_pylist(), [np.frombuffer(x, np.uint16) for x in table.column("ids").to_pylist()]
        pieces = list(fill(arrays, idf.value, mean, window))
        ids = [arrays[d][s : s + k].astype("<u4").tobytes() for d, s, k, _, _ in pieces]
        long = pa.int64()
        return pa.table(
            {
                "doc_id": pa.array([names[p[0]] for p in pieces], long),
                "start": pa.array([p[1] for p in pieces], long),
                "length": pa.array([p[2] for p in pieces], long),
                "doc_tokens": pa.array([len(arrays[p[0]]) for p in pieces], long),
                "sequence_id": pa.array([(shard << 32) + p[3] for p in pieces], long),
                "offset": pa.array([p[4] for p in pieces], long),
                "ids": pa.array(ids, pa.binary()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in ids], long),
            }
        )

    dealt = tokens.select("doc_id", "ids", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("ids")), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long")


def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
