"""User-given models over array columns: scores, vectors, classifiers and their search."""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_length(arrays, predict, batch):
    """(positions, outputs) of arrays that are not null, stacked by length in slices of ``batch``."""
    import numpy as np

    held = [(i, np.asarray(a, np.float64)) for i, a in enumerate(arrays) if a is not None]
    for size in sorted({len(a) for _, a in held}):
        same = [(i, a) for i, a in held if len(a) == size]
        for at in range(0, len(same), batch):
            part = same[at : at + batch]
            yield [i for i, _ in part], predict(np.nan_to_num(np.stack([a for _, a in part])))


def _mean_of(models):
    import numpy as np

    return lambda x: np.mean([m(x) for m in models], axis=0)


def score_arrays(df: DataFrame, make_models, column: str = "values", batch: int = 128, out: str = "score") -> DataFrame:
    """Mean over models of their score; ``make_models`` runs once per Python worker.

    Each model takes an (n, d) float array and gives n scores.  NaN counts as zero, arrays
    may differ in length (rows of one length go to the model together), and a null array has
    a null score.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = _mean_of(make_models())
        for arrays in batches:
            got = [None] * len(arrays)
            for places, values in _by_length(arrays, predict, batch):
                for i, v in zip(places, values):
                    got[i] = float(v)
            yield pd.Series(got, dtype="Float64")

    return df.withColumn(out, score(F.col(column)))


def embed_arrays(df: DataFrame, make_model, column: str = "values", batch: int = 128, out: str = "vector") -> DataFrame:
    """A vector per row from one model; NaN counts as zero, a null array has no vector."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for arrays in batches:
            got = [None] * len(arrays)
            for places, values in _by_length(arrays, model, batch):
                for i, v in zip(places, values):
                    got[i] = v.astype("float32")
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, embed(F.col(column)))


def score_or_error(df: DataFrame, make_models, column: str = "values", batch: int = 128) -> DataFrame:
    """Adds ``score`` and ``error``: where a model fails on a slice, its rows are tried one by one, and a row that fails alone keeps the message."""

    @F.pandas_udf("score double, error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = _mean_of(make_models())
        for arrays in batches:
            scores, errors = [None] * len(arrays), [None if a is not None else "no array" for a in arrays]

            def careful(x, predict=predict):
                try:
                    return [(float(v), None) for v in predict(x)]
                except Exception as e:
                    if len(x) == 1:
                        return [(None, f"{type(e).__name__}: {e}")]
                    return [careful(x[i : i + 1])[0] for i in range(len(x))]

            for places, values in _by_length(arrays, careful, batch):
                for i, (v, e) in zip(places, values):
                    scores[i], errors[i] = v, e
            yield pd.DataFrame({"score": pd.Series(scores, dtype="Float64"), "error": pd.Series(errors, dtype=object)})

    return df.withColumn("_out", score(F.col(column))).select(*df.columns, "_out.score", "_out.error")


# --- classifiers -------------------------------------------------------------------------
def class_weights(df: DataFrame, label: str):
    """Weight of each row, so that every class weighs the same in all."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row per class
    return F.coalesce(*(F.when(F.col(label) == k, F.lit(sum(n.values()) / (len(n) * v))) for k, v in n.items()))


def _hashed(key: str, seed: int, parts: int):
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts))


def split_by_key(df: DataFrame, key: str, share: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: all rows of a key are on one side."""
    low = _hashed(key, seed, 1_000_000) < int(share * 1_000_000)
    return df.where(~low), df.where(low)


def _estimator(kind: str, label: str, seed: int):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    if kind not in ("forest", "boosted"):
        raise ValueError(f"no classifier {kind}")
    one = RandomForestClassifier if kind == "forest" else GBTClassifier
    return one(labelCol=label, featuresCol="features", weightCol="_weight", seed=seed)


@contextmanager
def _examples(df: DataFrame, features: list[str], label: str, **more):
    """The columns a classifier needs, held for as long as it is fitted: every tree and fold goes over them, the table is worked out once."""
    rows = df.withColumns({"_weight": class_weights(df, label)} | more).select(*dict.fromkeys([*features, label, "_weight", *more])).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def _light(model):
    """The pipeline model without the training summary, which holds on to the session."""
    from pyspark import SparkContext

    tree = model.stages[-1]
    if getattr(tree, "hasSummary", False):
        tree._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def feature_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, share) by falling share; shares add up to 1 unless no tree splits."""
    share = map(float, model.stages[-1].featureImportances.toArray())
    return sorted(zip(features, share), key=lambda r: (-r[1], r[0]))


def train_classifier(df: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 5, seed: int = 1, kind: str = "forest"):
    """A random forest or boosted trees on weighted classes; returns (pipeline model, importance by feature)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    tree = _estimator(kind, label, seed).setMaxDepth(depth)
    tree = tree.setNumTrees(trees) if kind == "forest" else tree.setMaxIter(trees)
    with _examples(df, features, label) as rows:
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), tree]).fit(rows)
    return _light(model), dict(feature_importance(model, features))


#: What the search draws from, by kind of trees.
CHOICES = {
    "forest": {"numTrees": [10, 20, 40, 80], "maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [1, 2, 5], "subsamplingRate": [0.6, 0.8, 1.0]},
    "boosted": {"maxIter": [10, 20, 40], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3], "subsamplingRate": [0.6, 0.8, 1.0]},
}


def random_settings(kind: str, tries: int, seed: int = 1, choices: dict | None = None) -> list[dict]:
    """Different random settings, the same for the same seed; fewer if the choices have fewer."""
    from math import prod

    choices, draw, out = choices or CHOICES[kind], random.Random(seed), []
    while len(out) < min(tries, prod(map(len, choices.values()))):
        one = {k: draw.choice(v) for k, v in choices.items()}
        if one not in out:
            out.append(one)
    return out


def search_classifier(df: DataFrame, features: list[str], key: str, label: str = "label", kind: str = "forest", metric: str = "f1", tries: int = 10, folds: int = 5, seed: int = 1, choices: dict | None = None):
    """(best pipeline model, [(setting, mean metric)] in the order tried): random search with cross-validation.

    Folds go by a hash of the key, so rows of one key never train and test each other.
    ``metric`` is f1 (of class 1) or roc_auc.  The best setting is fitted on all rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator

    judges = {"f1": lambda: MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0), "roc_auc": lambda: BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")}
    if metric not in judges:
        raise ValueError(f"no metric {metric}")
    tree = _estimator(kind, label, seed)
    settings = random_settings(kind, tries, seed, choices)
    grid = [{tree.getParam(k): v for k, v in s.items()} for s in settings]
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), tree])
    with _examples(df, features, label, _fold=_hashed(key, seed + 1, folds).cast("int")) as rows:
        found = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judges[metric](), numFolds=folds, foldCol="_fold", seed=seed).fit(rows)
    return _light(found.bestModel), list(zip(settings, map(float, found.avgMetrics)))


def classify(df: DataFrame, model, keep: float | None = 1.0) -> DataFrame:
    """Predictions of a fitted pipeline, by default only the positive class."""
    out = model.transform(df).drop("features", "rawPrediction", "probability")
    return out if keep is None else out.where(F.col("prediction") == keep)
