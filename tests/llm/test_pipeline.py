"""Each stage of the pipeline against what it should keep, and the whole of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabsieve.llm import secrets
from tests.llm.test_operators import DOC, EDGES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns(spark, docs):
    edges = spark.createDataFrame(EDGES, DOC)
    empty = edges.limit(0)
    for _, stage in C.STAGES[:-1]:
        for df in (edges, empty):
            out = stage(spark, df, SF)
            assert out.dtypes == df.dtypes
            assert df is edges or out.count() == 0
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "secrets", "mix", "pack"]


def test_language_stage(spark, docs):
    extra = spark.createDataFrame([(9001, "123 !!", "en", "s", 6), (9002, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = C.identify_language(spark, docs.unionByName(extra), SF)
    assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in out.select("doc_id").collect()}


def test_duplicates_stage(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(20):
        w = [f"w{x}" for x in rng.integers(0, 9999, 150)]
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w)), (10 * i + 2, " ".join([*w[:-1], "other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.drop_near_duplicates(spark, df, SF).collect()) == [10 * i for i in range(20)]


def test_secrets_stage(spark, docs):
    out = {r["doc_id"]: r for r in C.redact_secrets(spark, docs, SF).collect()}
    for r in docs.collect():
        spans = secrets.scan(r["text"])[1]
        want = secrets.redact(r["text"], spans)
        assert out[r["doc_id"]]["text"] == want and (not spans or out[r["doc_id"]]["n_chars"] == len(want))


def test_mix_stage(spark, docs):
    from tabsieve.llm.mixing import mix_sources

    want = {r["doc_id"]: r["copies"] for r in mix_sources(docs).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in C.mix(spark, docs, SF).groupBy("doc_id").count().collect()} == want


def test_run(spark, docs):
    """The whole pipeline against plain versions of its stages: each document's ids, as often as the mix takes it."""
    from tokenizers import Tokenizer

    from tabsieve.llm import minhash_dedup as M
    from tabsieve.llm import mixing, packing
    from tabsieve.llm._shared import words

    rows = {r["doc_id"]: r.asDict() for r in docs.collect() if any(ch.isalpha() for ch in r["text"] or "")}
    idf = M.idf_table(*M.document_frequencies(docs))
    sets = {k: M.weighted_shingles(words([r["text"].encode()])[3], idf) for k, r in rows.items()}
    kept = []
    group = {k: k for k in rows}  # smallest id among those that links reach

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if M.weighted_jaccard(sets[a], sets[b]) >= M.THRESHOLD:
                group[max(top(a), top(b))] = min(top(a), top(b))
    kept = [k for k in ids if top(k) == k]
    for k in kept:
        rows[k]["text"] = secrets.redact(rows[k]["text"], secrets.scan(rows[k]["text"])[1])
    left = spark.createDataFrame([rows[k] for k in kept], docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(left).collect()}
    tok = Tokenizer.from_file(packing.tokenizer_file())
    want = {k: n * (len(tok.encode(rows[k]["text"], add_special_tokens=False).ids) + 1) for k, n in copies.items() if n}
    out = C.run(spark, SF)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    n = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert n.where("n > 2048 or n != end").count() == 0 and n.count() > 0
