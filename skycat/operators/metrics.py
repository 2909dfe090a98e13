"""Score analytics: confusion, ranking, calibration, histograms, ensembles."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binary_metrics(df, y="y", p="p", threshold=0.5):
    hit = F.col(p) >= threshold
    n = lambda c: F.sum(c.cast("long"))
    c = df.agg(n(hit & (F.col(y) == 1)).alias("tp"), n(hit & (F.col(y) == 0)).alias("fp"), n(~hit & (F.col(y) == 0)).alias("tn"), n(~hit & (F.col(y) == 1)).alias("fn"))
    d = lambda a, b: F.try_divide(a, b)
    out = c.withColumns({"accuracy": d(F.expr("tp+tn"), F.expr("tp+tn+fp+fn")), "precision": d(F.col("tp"), F.expr("tp+fp")), "recall": d(F.col("tp"), F.expr("tp+fn")), "specificity": d(F.col("tn"), F.expr("tn+fp"))})
    return out.withColumns({"f1": d(F.expr("2*tp"), F.expr("2*tp+fp+fn")), "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2})


def _cumulative(df, y, p):
    """(score, positives, negatives, tp, fp) per distinct score, highest first.

    Scores are cut into 1,000 ranges whose sums are carried over, so that no task sorts
    every distinct score.
    """
    at = df.groupBy(F.col(p).alias("score")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg")).withColumn("cut", F.floor(F.col("score") * 1000))
    cuts = at.groupBy("cut").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    before = Window.orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select("cut", F.coalesce(F.sum("cp").over(before), F.lit(0)).alias("bp"), F.coalesce(F.sum("cn").over(before), F.lit(0)).alias("bn"))
    run = Window.partitionBy("cut").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return at.join(cuts, "cut").select("score", "pos", "neg", (F.col("bp") + F.sum("pos").over(run)).alias("tp"), (F.col("bn") + F.sum("neg").over(run)).alias("fp"))


def roc_auc(df, y="y", p="p"):
    """Exact area with ties counted half."""
    c = _cumulative(df, y, p)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df, y="y", p="p"):
    c = _cumulative(df, y, p)
    return c.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def pr_points(df, y="y", p="p"):
    """(score, precision, recall) at every distinct score as threshold."""
    c = _cumulative(df, y, p)
    total = df.agg(F.sum((F.col(y) == 1).cast("long")).alias("all"))
    # the total is one row
    return c.crossJoin(F.broadcast(total)).select("score", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", "all").alias("recall"))


def calibration(df, y="y", p="p", bins=10):
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def ece(df, y="y", p="p", bins=10):
    c = calibration(df, y, p, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def score_errors(df, y="y", p="p", gamma=2.0):
    e = F.col(p) - F.col(y)
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    focal = -(F.col(y) * F.pow(1 - q, F.lit(float(gamma))) * F.ln(q) + (1 - F.col(y)) * F.pow(q, F.lit(float(gamma))) * F.ln(1 - q))
    return df.agg(F.avg(e * e).alias("brier"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"), F.avg(loss).alias("log_loss"), F.avg(focal).alias("focal_loss"))


def _edge_bin(column, steps):
    """Number of the last edge i/steps that the value reaches; edges are compared, never divided."""
    edges = F.filter(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(i.alias("bin"), (i / steps).alias("lo"))), lambda e: e["lo"] <= F.col(column))
    return F.element_at(edges, -1)["bin"]


def hist2d(df, x, y, steps=25):
    """Counts on a grid of steps x steps over [0, 1] squared; the last bins are closed, values outside drop."""
    inside = df.where(F.col(x).between(0, 1) & F.col(y).between(0, 1))
    return inside.groupBy(_edge_bin(x, steps).alias("x_bin"), _edge_bin(y, steps).alias("y_bin")).agg(F.count("*").alias("n"))


def hist_fixed(df, column, steps=20):
    """Counts on edges i/steps over [0, 1]; the last bin is closed, values outside drop."""
    b = _edge_bin(column, steps)
    return df.where(F.col(column).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def performance_by_label(df, y="y", p="p", least=1, bins=None):
    """Mean and population deviation of the score per label, or per one of ``bins`` label bins over [0, 1]."""
    if bins:
        df = df.where(F.col(y).between(0, 1))
    return df.groupBy((_edge_bin(y, bins) if bins else F.col(y)).alias("label")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.stddev_pop(p).alias("std_p")).where(F.col("n") >= least)


def ensemble(scores, key, value):
    return scores.groupBy(key).agg(F.avg(value).alias("mean_score"), F.stddev_pop(value).alias("std_score"), F.count("*").alias("n_models"))


def separator_metrics(df, separated, y="y"):
    n = lambda c: F.sum(c.cast("long"))
    c = df.agg(n(separated & (F.col(y) == 1)).alias("tp"), n(separated & (F.col(y) == 0)).alias("fp"), n(~separated & (F.col(y) == 0)).alias("tn"), n(~separated & (F.col(y) == 1)).alias("fn"))
    return c.select(F.expr("try_divide(tp, tp+fn)").alias("sensitivity"), F.expr("try_divide(tn, tn+fp)").alias("specificity"), F.expr("try_divide(tp, tp+fp)").alias("ppv"))


def feature_ranges(df, columns):
    wide = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").cast("double").alias("lo"), F.col(f"hi_{c}").cast("double").alias("hi")) for c in columns))).alias("r")).select("r.*")


#: Hashes for balance and folds lie in [0, MODULUS); FACTOR spreads neighbouring keys.
MODULUS, FACTOR = 1000003, 2654435761


def _key_hash(df, key, seed):
    """A hash of the key of any type and size; whole numbers are reduced before they are multiplied, null keys count as zero."""
    kind = dict(df.dtypes)[key]
    whole = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    return F.pmod(F.pmod(F.coalesce(whole, F.lit(0)), F.lit(MODULUS)) * (FACTOR % MODULUS) + seed, F.lit(MODULUS))


def _ranked(df, group, order, parts=64):
    """Adds ``_rank`` (0-based, by ``order`` within ``group``) and ``_size`` of the group.

    ``order[0]`` must be an integer in [0, MODULUS): rows are numbered within ranges of it and
    only the counts per range meet, so that no task numbers a whole group.  Null groups are
    groups like any other.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order[0]) * parts / MODULUS))
    counts = cut.groupBy(*group, "_cut").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate([*group, "_cut"])), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(*group)).alias("_size"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*group, "_cut"])))
    within = F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(*order)) - 1
    ranked = cut.withColumn("_within", within).join(firsts, same).withColumn("_rank", F.col("_first") + F.col("_within"))
    return ranked.drop("_cut", "_first", "_within", *(f"_g{i}" for i in range(len(group) + 1)))


def balance(df, key, y="y", ratio=3, seed=1):
    """All positives and the ratio x positives negatives that come first in hash order; null and text keys take part."""
    want = ratio * (df.agg(F.sum((F.col(y) == 1).cast("long"))).first()[0] or 0)
    negatives = _ranked(df.where(F.col(y) == 0).withColumns({"_h": _key_hash(df, key, seed), "_one": F.lit(1)}), ["_one"], ["_h", key])
    return df.where(F.col(y) == 1).unionByName(negatives.where(F.col("_rank") < want).select(df.columns))


def stratified_folds(df, key, value, k=10, bins=5, seed=1, test=0.0):
    """Fold numbers dealt in hash order within each bin of the value; the first ``test`` share of a bin has fold -1.

    Null values form a bin of their own; null and text keys take part.
    """
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    b = F.when(F.col(value).isNotNull(), b)
    ranked = _ranked(df.withColumns({"bin": b, "h": _key_hash(df, key, seed)}), ["bin"], ["h", key])
    held = F.floor(F.col("_size") * test)
    return ranked.withColumn("fold", F.when(F.col("_rank") < held, -1).otherwise((F.col("_rank") - held) % k).cast("int")).drop("h", "_rank", "_size")


def sample_weights(df, value, bins=10, alpha=0.5, epsilon=1e-6):
    """Weight per bin, 1/(n+epsilon)^alpha over all bins, empty ones included, summing to bins."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i,) for i in range(bins)], "bin int").join(counts, "bin", "left").fillna(0, ["n"])
    raw = every.withColumn("raw", 1 / F.pow(F.col("n") + epsilon, F.lit(alpha)))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("total")))).select("bin", "n", (F.col("raw") / F.col("total") * bins).alias("weight"))  # ten rows by one
