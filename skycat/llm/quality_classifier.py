"""Regularised quadratic discriminant over transformed document statistics.

Each class has its own mean and covariance; the covariance is shrunk towards the pooled
one and towards a sphere.  Scores are the logistic of the difference of Mahalanobis
log-densities, computed with Cholesky factors that are made once and cached per worker.
The class moments are summed over all labelled rows by Spark; only two rows of moments
reach the driver.

Defined cases: null text counts as empty and gets a score like any other; labels that are
null, or whose document is missing, are not learnt from; a document labelled twice counts
once per label; a null doc_id is in no fold (held_out is false) and has no label; without rows of both classes the score is the share of label 1 (0.5 if
none); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "log_words", "word_length", "symbol_share", "upper_share", "digit_share", "punctuation_share", "distinct_share",
    "run_share", "single_mark_share", "repeat_lines", "bang_share", "accent_share", "top_word_share", "short_share", "sentence_words",
)
DIM = len(STATISTICS)


def document_statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text: logs of counts, square roots of shares."""
    from collections import Counter
    from math import log1p, sqrt

    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(1, sum(map(len, words)))
    count = data.count
    symbols = sum(map(count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    upper = size - len(b"".join(words).translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(count(b"%d" % d) for d in range(10))
    marks = sum(map(count, (b".", b",", b";", b":", b"?", b"'", b'"')))
    accents = size - len(b"".join(words).translate(None, bytes(range(128, 256))))
    lines = [x for x in data.split(b"\n") if x.strip()]
    tally = Counter(words)
    m = max(1, n)
    return [
        log1p(n),
        sqrt(size / m),
        sqrt(min(4.0, symbols / m)),
        sqrt(upper / size),
        sqrt(digits / size),
        sqrt(min(4.0, marks / m)),
        log1p(m) - log1p(len(tally)),
        sqrt(sum(map(bytes.__eq__, words, words[1:])) / m),
        sqrt(sum(v for w, v in tally.items() if len(w) == 1 and not w.isalnum()) / m),
        sqrt(1 - len(set(lines)) / max(1, len(lines))),
        sqrt(min(4.0, count(b"!") / m)),
        sqrt(accents / size),
        sqrt(max(tally.values(), default=0) / m),
        sqrt(sum(v for w, v in tally.items() if len(w) < 4) / m),
        log1p(n / max(1, count(b"."))),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every whole text."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "x": [document_statistics(t) for t in pdf.text]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, x array<double>")


def forward(factor, right):
    """z of factor @ z = right for a lower triangular factor, by substitution, all columns at once."""
    import numpy as np

    z = np.empty_like(right)
    for i in range(len(factor)):
        z[i] = (right[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Fitted model; ``scores`` takes an (n, DIM) array."""

    log_prior: float
    means: list
    factors: list
    constant: float | None = None

    def scores(self, x):
        import numpy as np

        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor in zip(self.means, self.factors):
            z = forward(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        margin = np.clip(self.log_prior + density[1] - density[0], -30, 30)
        return 1 / (1 + np.exp(-margin))


def fit(labelled: DataFrame, pooled: float = 0.05, sphere: float = 0.01) -> Discriminant:
    """Fit on (x, y); ``pooled`` and ``sphere`` are the two shrinkages."""
    import numpy as np

    def moments(batches):
        sums = {}
        for pdf in batches:
            for y, group in pdf.groupby("y"):
                x = np.stack(group.x.to_numpy())
                old = sums.get(y, (0, np.zeros(DIM), np.zeros((DIM, DIM))))
                sums[y] = (old[0] + len(x), old[1] + x.sum(0), old[2] + x.T @ x)
        yield pd.DataFrame([(int(y), n, *s, *ss.ravel()) for y, (n, s, ss) in sums.items()], columns=names)

    names = ["y", "n", *(f"s{i}" for i in range(DIM)), *(f"q{i}" for i in range(DIM * DIM))]
    schema = "y int, n long, " + ", ".join(f"{c} double" for c in names[2:])
    rows = {r["y"]: r for r in labelled.where("y in (0, 1)").select("x", F.col("y").cast("int").alias("y")).mapInPandas(moments, schema).groupBy("y").agg(*(F.sum(c).alias(c) for c in names[1:])).collect()}
    if len(rows) < 2 or min(r["n"] for r in rows.values()) < 2:
        total = sum(r["n"] for r in rows.values())
        return Discriminant(0.0, [], [], (rows[1]["n"] / total if 1 in rows else 0.0) if total else 0.5)
    n, means, covs = {}, {}, {}
    for y, r in rows.items():
        n[y] = r["n"]
        means[y] = np.array([r[f"s{i}"] for i in range(DIM)]) / n[y]
        covs[y] = np.array([r[f"q{i}"] for i in range(DIM * DIM)]).reshape(DIM, DIM) / n[y] - np.outer(means[y], means[y])
    common = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    scale = np.diag(np.diag(common)) + 1e-6 * np.eye(DIM)
    factors = [np.linalg.cholesky((1 - sphere) * ((1 - pooled) * covs[y] + pooled * common) + sphere * scale) for y in (0, 1)]
    return Discriminant(float(np.log(n[1] / n[0])), [means[0], means[1]], factors)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for rows of ``statistics``."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            x = np.stack(pdf.x.to_numpy()) if len(pdf) else np.zeros((0, DIM))
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "score": model.scores(x)})

    return stats.mapInPandas(run, "doc_id long, score double")


def text_score(text: Column, model: Discriminant) -> Column:
    """The score of each row's own text; no key is needed."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        import numpy as np

        x = np.array([document_statistics(t) for t in texts]).reshape(-1, DIM)
        return pd.Series(model.scores(x))

    return run(text)


def held_out(doc_id="doc_id"):
    """Whether a document belongs to the held-out fold: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit_on_labels(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled documents outside the held-out fold."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("y"))
    return fit(stats.join(known, "doc_id").select("x", "y"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    from skycat.llm.common import written

    stats = written(statistics(docs), "document-statistics")
    scored = score(stats, fit_on_labels(stats, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
