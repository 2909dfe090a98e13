"""Tile bookkeeping: job log, availability, progress, pending work."""

from pyspark.sql import functions as F

DONE = ("completed", "skipped_mostly_zeros")


def upsert_jobs(events, keys=("tile", "band"), order="seq"):
    """The latest event of each key as a whole row."""
    rest = [c for c in events.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(order, *rest), F.col(order))
    return events.groupBy(*keys).agg(last.alias("e")).select(*keys, "e.*")


def availability(rows, bands, tile="tile"):
    """tile x band matrix of 0 and 1."""
    have = [F.max(F.when(F.col("band") == b, 1).otherwise(0)).alias(b) for b in bands]
    return rows.groupBy(tile).agg(*have)


def availability_counts(matrix, bands):
    """(n_bands, exact, at_least): tiles by number of bands."""
    exact = matrix.select(sum((F.col(b) for b in bands), F.lit(0)).alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    wanted = exact.sparkSession.createDataFrame([(i,) for i in range(1, len(bands) + 1)], "n_bands int")
    return wanted.join(exact, F.col("n") >= F.col("n_bands"), "left").groupBy("n_bands").agg(F.coalesce(F.sum(F.when(F.col("n") == F.col("n_bands"), F.col("c"))), F.lit(0)).alias("exact"), F.coalesce(F.sum("c"), F.lit(0)).alias("at_least"))


def availability_combos(matrix, bands):
    """(combo, tiles): tiles that hold every band of each combination."""
    from itertools import combinations

    combos = [c for n in range(1, len(bands) + 1) for c in combinations(bands, n)]
    sums = [F.sum(F.when(sum((F.col(b) for b in c), F.lit(0)) == len(c), 1).otherwise(0)).alias("+".join(c)) for c in combos]
    wide = matrix.agg(*sums)
    return wide.select(F.explode(F.array(*(F.struct(F.lit("+".join(c)).alias("combo"), F.col(f"`{'+'.join(c)}`").alias("tiles")) for c in combos))).alias("r")).select("r.combo", "r.tiles")


def progress_summary(log, available):
    """Status counts per band, and what remains of the available tiles."""
    statuses = ("completed", "failed", "processing", "downloading", "downloaded", "download_failed", "skipped_mostly_zeros")
    counts = log.groupBy("band").agg(*(F.sum((F.col("status") == s).cast("long")).alias(s) for s in statuses))
    total = available.groupBy("band").agg(F.count_distinct("tile").alias("available"))
    done = F.coalesce("completed", F.lit(0)) + F.coalesce("skipped_mostly_zeros", F.lit(0)) + F.coalesce("failed", F.lit(0)) + F.coalesce("download_failed", F.lit(0))
    return total.join(counts, "band", "left").select("band", "available", *(F.coalesce(s, F.lit(0)).alias(s) for s in statuses), F.greatest(F.lit(0), F.col("available") - done).alias("remaining"))


def pending_jobs(available, log, known_tiles=None, groups=None):
    """Available (tile, band) without a finished job, on the tiles of known objects or of a group list if given."""
    from skycat.operators.selection import restrict_tiles

    for tiles in (known_tiles, groups):
        available = available if tiles is None else restrict_tiles(available, tiles)
    return available.select("tile", "band").distinct().join(log.where(F.col("status").isin(*DONE)), ["tile", "band"], "left_anti")


def run_report(log):
    return log.groupBy("band").agg(F.count("*").alias("jobs"), F.avg(F.when(F.col("status") == "completed", F.col("minutes"))).alias("mean_minutes"), F.sum((F.col("status") == "failed").cast("long")).alias("failed"))


def failed_jobs(log, n=None):
    """The failed (tile, band) of the log, the first n in order if given."""
    failed = log.where(F.col("status") == "failed").select("tile", "band")
    return failed if n is None else failed.orderBy("tile", "band").limit(n)


def run_totals(log):
    return log.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.avg(F.when(F.col("status") == "completed", F.col("minutes"))).alias("mean_minutes"))


def band_barrier(rows, bands):
    """Tiles for which all bands have arrived, with the order of the last arrival."""
    first = rows.groupBy("tile", "band").agg(F.min("seq").alias("seq")).where(F.col("band").isin(*bands))
    return first.groupBy("tile").agg(F.count("*").alias("n"), F.max("seq").alias("complete_at")).where(F.col("n") == len(bands)).select("tile", "complete_at")


def resource_windows(samples, every="1 hour", ts="ts", value="value"):
    return samples.groupBy(F.window(ts, every).alias("w")).agg(F.max(value).alias("peak"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "peak", "mean", "std", "n")
