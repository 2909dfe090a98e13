"""Scoring, classifiers and their search with small models."""

import pytest
from pyspark.sql import functions as F

from skycat.operators import components, metrics, scoring


def test_scores_and_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, float("nan")]), (3, None), (4, [5.0]), (5, [])], "id int, values array<float>")
    models = lambda: [lambda x: x.sum(1), lambda x: x.max(1, initial=0)]
    assert [r.score for r in scoring.score_arrays(df, models).orderBy("id").collect()] == [2.5, 3.0, None, 5.0, 0.0]
    assert [r.vector for r in scoring.embed_arrays(df, lambda: lambda x: x * 2).orderBy("id").collect()] == [[2.0, 4.0], [6.0, 0.0], None, [10.0], []]
    assert scoring.score_arrays(df.limit(0), models).count() == 0


def test_errors_stay_with_their_rows(spark):
    def models():
        def picky(x):
            if (x < 0).any():
                raise ValueError("negative")
            return x.sum(1)

        return [picky]

    df = spark.createDataFrame([(i, [float(i), -1.0 if i % 5 == 0 else 1.0]) for i in range(20)] + [(20, None)], "id int, values array<float>")
    got = {r.id: (r.score, r.error) for r in scoring.score_or_error(df, models, batch=8).collect()}
    assert got == {i: ((None, "ValueError: negative") if i % 5 == 0 else (i + 1.0, None)) for i in range(20)} | {20: (None, "no array")}


@pytest.fixture
def table(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 20 > 14).cast("int").alias("label"))
    return df.withColumn("key", F.floor(F.col("id") / 4))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_classifier_beside_components(spark, table, kind):
    """A model fitted before connected_components works after it, and one fitted after it works too."""
    first, importance = scoring.train_classifier(table, ["a", "b"], trees=10, kind=kind)
    components.connected_components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")).count()
    second, _ = scoring.train_classifier(table, ["a", "b"], trees=10, kind=kind)
    assert importance["a"] > 0.8
    for model in (first, second):
        assert scoring.classify(table, model).where("label = 1").count() == scoring.classify(table, model).count() == table.where("label = 1").count()


def test_search_returns_the_best_setting(table):
    choices = {"numTrees": [3, 5], "maxDepth": [1, 4]}
    model, tries = scoring.search_classifier(table, ["a", "b"], "key", tries=4, folds=3, choices=choices)
    assert len(tries) == 4 and sorted(map(str, (s for s, _ in tries))) == sorted(str({"numTrees": n, "maxDepth": d}) for n in (3, 5) for d in (1, 4))
    best = max(tries, key=lambda t: t[1])[0]
    forest = model.stages[-1]
    assert (forest.getOrDefault("numTrees"), forest.getOrDefault("maxDepth")) == (best["numTrees"], best["maxDepth"])
    assert scoring.feature_importance(model, ["a", "b"])[0][0] == "a"
    assert scoring.classify(table, model, None).where("prediction = label").count() > 380
    _, auc = scoring.search_classifier(table, ["a", "b"], "key", kind="boosted", metric="roc_auc", tries=1, folds=2, choices={"maxIter": [3], "maxDepth": [2]})
    assert auc[0][1] > 0.9


def test_settings_and_split_are_fixed_by_the_seed(table):
    assert scoring.random_settings("forest", 6, 4) == scoring.random_settings("forest", 6, 4) != scoring.random_settings("forest", 6, 5)
    assert len(scoring.random_settings("forest", 99, choices={"maxDepth": [1, 2]})) == 2
    train, test = scoring.split_by_key(table, "key")
    assert train.count() + test.count() == 400 and 40 < test.count() < 130
    assert train.select("key").intersect(test.select("key")).count() == 0


@pytest.mark.parametrize("keys, kind", [([None, 4_000_000_000, 2**62, -5, 7, 8, None, 9], "long"), ([None, "x", "", "é", "a", "b", None, "c"], "string")])
def test_folds_and_balance_keep_all_rows(spark, keys, kind):
    rows = spark.createDataFrame([(k, i % 4 == 0, None if i == 3 else i / 8) for i, k in enumerate(keys)], f"k {kind}, pos boolean, v double").withColumn("y", F.col("pos").cast("int"))
    folded = metrics.stratified_folds(rows, "k", "v", k=2, bins=2)
    assert folded.count() == 8 and folded.where("bin is null").count() == 1 and folded.where("fold is null").count() == 0
    assert metrics.balance(rows, "k", ratio=3).count() == 8
    assert metrics.balance(rows, "k", ratio=1).count() == 4


def test_a_search_works_its_examples_out_once(spark):
    """All folds, settings and trees go over held columns, not over the table's own plan again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(k):
        made.add(1)
        return float(k % 7)

    rows = spark.range(60).select(F.col("id").alias("k"), feature("id").alias("a"), (F.col("id") % 2).cast("int").alias("label"), F.lit("wide").alias("other"))
    _, tries = scoring.search_classifier(rows, ["a"], "k", tries=2, folds=2, choices={"numTrees": [2, 3], "maxDepth": [1]})
    assert len(tries) == 2 and made.value == 60
    model, _ = scoring.train_classifier(rows, ["a"], trees=2, depth=1, kind="boosted")
    assert made.value == 120 and scoring.classify(rows, model, None).count() == 60
