"""Stages of the pipeline against brute force, with null and repeated doc_ids."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline as cp
from skycat.llm import byte_bpe, jaccard, packing, quality_classifier, quality_rules
from skycat.llm.common import tokenizer_file


def shingle_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows, similarity=0.8):
    """One (doc_id, text) of each component; rows of one group and doc_id count as one."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or (min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y)):
                group[top(a)] = top(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(top(k), []).append((i is None, i or 0))
    return Counter(min(v) for v in best.values())


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_dedup_links_pairs_down_to_similarity(spark):
    rng, rows, pairs = random.Random(5), [], 0
    for k in range(120):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, changed(rng, words, rng.choice([1, 2, 3, 4, 5, 7, 9])))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        pairs += len(a & b) / len(a | b) >= 0.8
    assert pairs > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id is None, r.doc_id or 0) for r in cp.near_dedup_stage(spark, docs, DATA).collect())
    assert got == brute_kept(rows) and got.total() == 240 - pairs


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for rounds, members in ((jaccard.HUBS, jaccard.MEMBERS), (0, 3)):
        monkeypatch.setattr(jaccard, "HUBS", rounds)
        monkeypatch.setattr(jaccard, "MEMBERS", members)
        kept = cp.near_dedup_stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        assert Counter((False, r.doc_id) for r in kept.collect()) == brute_kept(rows)


def test_near_dedup_compares_a_dense_group_in_blocks(spark, monkeypatch):
    """Copies of one text of which many pairs lie just below the similarity and some just above."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(k, changed(rng, words, rng.choice([2, 3, 3, 4, 4, 4]))) for k in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert 3 < want.total() < 60
    for rounds, members in ((1, 8), (0, 5)):
        monkeypatch.setattr(jaccard, "HUBS", rounds)
        monkeypatch.setattr(jaccard, "MEMBERS", members)
        assert Counter((False, r.doc_id) for r in cp.near_dedup_stage(spark, docs, DATA).collect()) == want


def test_near_dedup_links_what_simhash_links(spark):
    """Texts that differ little when repeats count: their sets of shingles share less than 0.8."""
    rng = random.Random(3)
    line = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    tails = [" ".join(f"t{rng.randrange(10**6)}" for _ in range(15)) for _ in range(2)]
    rows = [(i, f"{line} " * 200 + tail) for i, tail in enumerate(tails)] + [(2, line), (3, tails[0])]
    a, b = (shingle_set(t) for _, t in rows[:2])
    assert len(a & b) < 0.8 * len(a | b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup_stage(spark, docs, DATA).collect()) == [0, 2, 3]


def test_near_dedup_on_null_and_repeated_ids(spark):
    rows = [(None, "a text without an id of its own here"), (None, "a text without an id of its own here"), (5, "the same row twice in the table"), (5, "the same row twice in the table"),
            (6, "one id"), (6, "and another text under it"), (None, None), (7, ""), (8, " \n"), (None, "copy of a row with an id"), (9, "copy of a row with an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in cp.near_dedup_stage(spark, docs, DATA).collect()]
    assert Counter((i is None, i or 0) for i, _ in kept) == brute_kept(rows)
    assert Counter(kept) == Counter([rows[0], rows[2], rows[4], rows[5], (7, ""), rows[10]])
    assert cp.near_dedup_stage(spark, docs.where(F.lit(False)), DATA).count() == 0


def test_stages_take_columns_of_any_name(spark):
    """Names with dots and other capitals than the contract's, as Spark itself takes them."""
    rows = [(i, f"A text of some words, number {i}, and more of them to read than that.", "x", 1.5) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, `a.b` string, `c d` double")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert [c.lower() for c in out.columns][:4] == ["doc_id", "text", "a.b", "c d"] and out.count() <= 6
    assert cp.near_dedup_stage(spark, docs, DATA).count() == 6
    assert byte_bpe.encode(docs.withColumnRenamed("TEXT", "text"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN).count() == 6


def edge_rows(spark):
    """Good and bad texts, each under an id of its own, under no id, and twice under one id with another text."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:30]] + [(7, t) for t in texts[30:]] + [(7, texts[30]), (None, None), (1, None), (2, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def pairs_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_rules_judge_each_row(spark):
    rows, docs = edge_rows(spark)
    alone = {t: bool(quality_rules.ledger(spark.createDataFrame([(0, t)], "doc_id long, text string")).where(quality_rules.CLEAN.keeps()).count()) for t in (rows[0][1], rows[31][1], None, "")}
    kept = pairs_of(cp.quality_rule_stage(spark, docs, DATA))
    assert all((kept[r] == Counter(rows)[r]) if alone[r[1]] else r not in kept for r in rows if r[1] in alone)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r[1]].add(kept[r] == Counter(rows)[r] if r in kept else None)
    assert all(v in ({True}, {None}) for v in by_text.values()) and kept and kept != Counter(rows)


def test_classifier_judges_each_row(spark):
    rows, docs = edge_rows(spark)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_classifier.fit_on_labels(quality_classifier.statistics(spark.read.parquet(f"{DATA}/documents.parquet")), labels)
    score = {t: float(model.scores(np.array([quality_classifier.document_statistics(t)]))[0]) for _, t in rows}
    want = Counter(r for r in rows if score[r[1]] >= 0.3)
    assert 0 < want.total() < len(rows) and any(i is None for i, _ in want)
    kept = cp.classifier_stage(spark, docs, DATA)
    assert kept.columns == docs.columns and pairs_of(kept) == want
    assert cp.classifier_stage(spark, docs.where(F.lit(False)), DATA).count() == 0


def test_pii_and_packing_hold_every_row(spark):
    rows, docs = edge_rows(spark)
    out = cp.pii_stage(spark, docs, DATA)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(i for i, _ in rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    whole = [(r.doc_id, r.text) for r in out.collect()]
    one = {r.text for r in out.where("doc_id is null").collect()}
    assert one <= {t for i, t in whole if i is not None}
    packed = cp.packing_stage(spark, out, DATA).toPandas()
    first = packed[packed.start == 0]
    assert first.doc_tokens.sum() == packed.length.sum()
    want = Counter(i for i, _ in whole)  # a text without words has one piece too
    assert Counter(None if np.isnan(i) else int(i) for i in first.doc_id.astype(float)) == want
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy()[1:] >= (g.offset + g.length).to_numpy()[:-1]).all() and (g.offset + g.length).max() <= packing.LIMIT
    for stage in (cp.quality_rule_stage, cp.pii_stage, cp.packing_stage):
        assert stage(spark, docs.where(F.lit(False)), DATA).count() == 0


def test_packing_leaves_no_cache_in_the_worker(spark, monkeypatch):
    """A worker outlives its task, so what the encoder keeps counts beside the later stages."""

    class Planned(Exception):
        pass

    class Docs:
        def select(self, *_):
            return self

        def mapInPandas(self, cut, schema):
            self.cut = cut

    def stop(*_):
        raise Planned

    from skycat.llm.word_tokens import word_tokens

    docs = Docs()
    monkeypatch.setattr(cp, "written", stop)
    with pytest.raises(Planned):
        cp.packing_stage(spark, docs, "")
    out = pd.concat(docs.cut(iter([pd.DataFrame({"row": [1], "doc_id": [1], "text": ["some words stay behind"]})])))
    held = word_tokens(tokenizer_file("word_bpe_49k.json"))
    assert len(out) == 1 and not held.chunks and not held.words
