"""Near copies by five-word shingles, for a stage that keeps one row of each group: SimHash first, then the exact join.

Rows are known by a written key, never by doc_id.  Rows with the same set of five-word
shingles fall into one class.  The SimHash index over the five-word fingerprints of the
classes names the first pairs: its three bits find nearly all pairs of similarity 0.98 and
few at 0.8, where some ten of 64 bits differ.  The token-family join links all pairs of sets
that reach 0.8.  A fingerprint counts repeats and a set does not, so of the pairs that SimHash
names (spanning edges of its groups) those link as well that reach 0.8 when repeats count.

Defined cases: words are runs of anything but ASCII white space in ASCII lower case; fewer
than five words make one shingle; texts without words, null included, are copies of each
other; doc_id may repeat or be null, and null comes last when the row to keep is chosen.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.llm import jaccard
from skycat.llm.common import bucketed, written
from skycat.llm.simhash import fingerprints, link_edges

WIDTH, PERCENT = 5, 80


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): classes (cid, fp) that share a fingerprint, or whose fingerprints the index links, by one class of each fingerprint."""
    chosen = classes.groupBy("fp").agg(F.min("cid").alias("chosen"))
    same = classes.join(chosen, "fp").where("cid <> chosen").select(F.col("cid").alias("u"), F.col("chosen").alias("v"))
    edges = link_edges(chosen.select("fp"))
    of = lambda c: chosen.select(F.col("fp").alias(c), F.col("chosen").alias(f"{c}_cid"))
    near = edges.join(of("u"), "u").join(of("v"), "v").select(F.greatest("u_cid", "v_cid").alias("u"), F.least("u_cid", "v_cid").alias("v"))
    return same.union(near).distinct()


def counted_links(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) of rows whose texts are similar enough when each repeat of a shingle counts."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        from collections import Counter

        def counted(text):
            w = text.encode("utf-8", "surrogatepass").lower().split()
            return Counter(zip(*(w[i:] for i in range(WIDTH)))) if len(w) >= WIDTH else Counter([tuple(w)])

        def reach(x, y):
            both = (x & y).total()
            return 100 * both >= percent * (x.total() + y.total() - both)

        return pd.Series([reach(counted(x), counted(y)) for x, y in zip(a, b)], dtype=bool)

    of = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"{c}_text"))
    return pairs.join(of("u"), "u").join(of("v"), "v").where(alike("u_text", "v_text")).select("u", "v")


def grouped(texts: DataFrame) -> DataFrame:
    """(row, component) for written rows (row, text); the component of texts without words is -1."""
    numbered = texts.select(F.col("row").alias("doc_id"), "text")
    every = written(jaccard.described(numbered, WIDTH), "described")
    rows = every.where("slot is null").select("digest", F.col("doc_id").alias("row"), "n")
    seen = every.where("slot is not null").select("slot", "seen")
    classes = written(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("cid"), F.min("n").alias("n")), "classes")
    prints = fingerprints(numbered, WIDTH).withColumnRenamed("doc_id", "cid").join(classes.select("cid"), "cid")
    first = written(simhash_pairs(written(prints, "fingerprints")), "simhash-pairs")
    labels = jaccard.class_labels(texts, classes, seen, WIDTH, PERCENT, first)
    labelled = written(classes.join(labels, "cid", "left").select("digest", "cid", F.coalesce("label", "cid").alias("label")), "near-labels")
    label = lambda c: labelled.select(F.col("cid").alias(c), F.col("label").alias(f"{c}_label"))
    apart = written(first.join(label("u"), "u").join(label("v"), "v").where("u_label <> v_label").select("u", "v"), "simhash-apart")
    links = written(counted_links(apart, texts), "simhash-links")
    of = jaccard.relabelled(labelled.select("cid", "label"), links).join(labelled.select("digest", "cid"), "cid").select("digest", F.col("label").alias("component"))
    return rows.join(of, "digest", "left").select("row", F.coalesce("component", F.lit(-1).cast("long")).alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs less all but one row of each group: that of the smallest doc_id.

    The texts move once, into buckets of the row key, and are read from there without a
    shuffle; all joins for groups and for the rows to keep move keys and sets of candidates.
    """
    columns = [f"c{i}" for i in range(len(docs.columns))]
    # the columns are found as Spark finds them, in whatever case
    place = {c.lower(): f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = bucketed(docs.toDF(*columns).withColumn("row", F.monotonically_increasing_id()), "row", "keyed")
    ids = keyed.select("row", F.col(place["doc_id"]).cast("long").alias("doc_id"))
    labelled = grouped(keyed.select("row", F.col(place["text"]).alias("text"))).join(ids, "row")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = written(labelled.groupBy("component").agg(F.min(order).alias("first")).select("first.row"), "kept")
    return keyed.join(kept.hint("merge"), "row", "left_semi").select(columns).toDF(*docs.columns)
