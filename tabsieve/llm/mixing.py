"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its words should have: the whole part is given to
every document for certain, the fraction is the inclusion probability p of one copy more. Documents are ranked by the
Pareto value (u / (1 - u)) / (p / (1 - p)), u a seeded uniform number of the document, and taken from the smallest on
until the source's words are reached: a fixed-size unequal-probability sample, where size is counted in words. A weight
column makes p unequal within a source too.

No source is ever gathered in one task. Each source's ranks are summed in a histogram (map-side), the cut is found in
it, and only the documents of the few bins at the cut are looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import written

WEIGHTS = (3, 1, 2)
EDGE = 512  # documents at each source's cut that are looked at one by one, at least
PER_BIN = 128  # documents in a histogram's bin, about
MANY_SOURCES = 100_000  # up to here the table of sources (five numbers each) is broadcast


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with target. Sources by code point, null last, have these weights in turn, and share
    `share` of all sizes; a target stops at `most` times its source's size and the excess goes to the others by weight.

    The fixed point of resharing is target = min(weight * level, most * size) with one level for all: sources are
    sorted by the level at which they are full, and running sums tell how many are. One row a source: the windows
    without a key hold no documents.
    """
    cap = F.col("source_size") * F.lit(float(most))
    t = sizes.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    t = t.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")))
    t = t.withColumn("full", cap / F.col("w"))
    upto = W.orderBy("full", "n").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    t = t.withColumn("given", F.coalesce(F.sum(cap).over(upto), F.lit(0.0))).withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # The level if just the sources before this one are full; the first one that it doesn't fill sets it for all.
    t = t.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("given")) / F.col("left_w"))
    t = t.withColumn("level", F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "n", "level"))).over(whole)["level"])
    return t.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("w") * F.col("level") > cap), cap).otherwise(F.col("w") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, seed: int = 11, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, carry: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Every row of docs (columns in carry; all if None) with size, source_size, target, copies and taken = copies * size.

    docs needs doc_id, source and text. weight: a column of relative inclusion weights within a source (null counts
    as 1); a document's expected copies never exceed `most`. Nulls: a null text has size 0, a null source is a source
    of its own. Documents of size 0 get the whole copies only, as they add no words, and so does every document of a
    source whose target is a whole multiple of its size: no rank is needed there. Repeated rows (also with a null
    doc_id) count each for itself, with random numbers of their own; ties in rank go by row number of the written
    table. Empty input gives no rows.
    Columns of docs named like an output are replaced.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    have = docs.columns
    keep = [c for c in (have if carry is None else carry) if c not in made]
    rel = F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)), F.lit(0.0)) if weight else F.lit(1.0)
    base = written(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(None).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"), rel.alias("rel"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("uid")), "mixing"
    )
    # Rows that repeat an id and a text get random numbers of their own, by their row; all others by id and text.
    again = base.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.lit(True).alias("again"))
    sums = base.groupBy(F.col("src").alias("source")).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("rel")).alias("rel_size"), F.count(F.lit(1)).alias("docs"))
    sums = written(sums, "mixing-sources")
    n = sums.agg(F.count(F.lit(1)).alias("sources"), F.max("docs").alias("docs")).first()
    small = F.broadcast if n["sources"] <= MANY_SOURCES else (lambda df: df)
    per = targets(sums.select("source", "source_size"), share, most, weights)
    per = written(per.join(sums.select(F.col("source").alias("s2"), "rel_size", "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mixing-targets")

    # Expected copies; the Pareto value q as q / (1 + q), from 0 to 1, the expected cut at a half.
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "th", F.when(F.col("again"), F.col("uid"))), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = base.join(written(again, "mixing-again"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left").drop("id2", "th2")
    rows = rows.join(small(per), F.col("src").eqNullSafe(F.col("source")))
    lam = F.least(F.lit(float(most)), F.when(F.col("rel_size") > 0, F.col("target") / F.col("rel_size") * F.col("rel")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("lam", lam).withColumn("whole", F.floor("lam")).withColumn("p", F.col("lam") - F.col("whole")).withColumn("u", u)
    rows = rows.withColumn("v", F.when((F.col("p") > 0) & (F.col("size") > 0), F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))))
    bins = max(16, min(1 << 20, (n["docs"] or 0) // PER_BIN))
    rows = rows.withColumn("bin", F.when(F.col("v").isNotNull(), F.least(F.floor(F.col("v") * bins), F.lit(bins - 1))).cast("int"))  # least skips nulls

    # Words still wanted by each source, and the bins at which its cut lies.
    hist = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.count(F.lit(1)).alias("docs"), F.first("target").alias("target"))
    by = W.partitionBy("source")
    run = by.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumn("want", F.col("target") - F.sum("certain").over(by)).withColumn("cum", F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("words"))).over(run), F.lit(0)))
    hist = hist.withColumn("past", (F.col("cum") > F.col("want")) & F.col("bin").isNotNull())
    hist = hist.withColumn("seen", F.sum(F.when(F.col("past"), F.col("docs")).otherwise(0)).over(run))
    edge = hist.groupBy("source").agg(
        F.first("want").alias("want"),
        F.min(F.when(F.col("past"), F.col("bin"))).alias("lo"),
        F.min(F.when(F.col("seen") >= EDGE, F.col("bin"))).alias("hi"),
        F.coalesce(F.max(F.when(~F.col("past"), F.col("cum"))), F.lit(0)).alias("below"),
    )
    edge = written(edge.select(F.col("source").alias("s2"), "want", "lo", F.coalesce("hi", F.lit(bins)).alias("hi"), "below"), "mixing-edges")
    rows = rows.join(small(edge), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    near = rows.where("bin >= lo and bin <= hi").select("source", "uid", "size", "v", (F.col("want") - F.col("below")).alias("gap"))
    near = written(near, "mixing-near")  # EDGE documents and a bin of each source

    def fill(t):
        """In rank order, each document that the words left still hold; then the one that ends nearest to none left."""
        t = t.sort_values(["v", "uid"])
        gap, took = float(t["gap"].iloc[0]), []
        for s in t["size"]:
            took.append(s <= gap)
            gap -= s if took[-1] else 0
        rest = [i for i, x in enumerate(took) if not x]
        if rest:
            i = min(rest, key=lambda i: (abs(t["size"].iloc[i] - gap), i))
            took[i] = abs(t["size"].iloc[i] - gap) < gap
        t["chosen"] = took
        return t[["uid", "chosen"]]

    chosen = near.groupBy("source").applyInPandas(fill, "uid long, chosen boolean").where("chosen").select(F.col("uid").alias("uid2"))
    chosen = written(chosen, "mixing-chosen")
    rows = rows.join(chosen, F.col("uid") == F.col("uid2"), "left")
    extra = F.when(F.col("bin").isNull(), 0).when(F.col("lo").isNull() | (F.col("bin") < F.col("lo")), 1).otherwise(F.when(F.col("uid2").isNotNull(), 1).otherwise(0))
    rows = rows.withColumn("copies", (F.col("whole") + extra).cast("int"))
    return rows.select(*(["row.*"] if keep else []), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
