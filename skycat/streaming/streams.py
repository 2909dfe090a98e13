"""Structured Streaming twins of the queue behaviours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.operators.jobs import resource_windows, upsert_jobs


def windowed_resources(samples: DataFrame, late: str = "2 hours", every: str = "1 hour") -> DataFrame:
    """Fixed buckets with a watermark; later samples are dropped."""
    return resource_windows(samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), every)


# --- barrier ---------------------------------------------------------------------------
def complete_tiles(arrivals: DataFrame, bands: tuple[str, ...], limit: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(tile, complete_at): each tile once, as soon as all of its bands have arrived.

    State is one row a tile: the bands seen and the latest of their first times.  It is
    forgotten ``limit`` after the tile's last arrival in event time, complete or not, so a
    tile that never completes costs nothing for ever, and a repeated band neither counts
    twice nor brings the tile out again.  Days and windows play no part.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    millis = int(pd.Timedelta(limit).total_seconds() * 1000)
    wanted = set(bands)

    def settle(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen, latest, last, done = state.get if state.exists else ("", 0, 0, False)
        have = set(seen.split(",")) - {""}
        for pdf in batches:
            for band, at in zip(pdf.band, pdf.micros):
                if band not in have:
                    have.add(band)
                    latest = max(latest, int(at))
                last = max(last, int(at))
        if not done and have >= wanted:
            done = True
            yield pd.DataFrame({"tile": [key[0]], "complete_at": pd.to_datetime([latest], unit="us")})
        state.update((",".join(sorted(have)), latest, last, done))
        state.setTimeoutTimestamp(max(last // 1000 + millis, state.getCurrentWatermarkMs() + 1))

    rows = arrivals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col("band").isin(*bands))
    rows = rows.select("tile", "band", "ts", F.unix_micros("ts").alias("micros"))
    kind = dict(arrivals.dtypes)["tile"]
    return rows.groupBy("tile").applyInPandasWithState(settle, f"tile {kind}, complete_at timestamp", "bands string, latest long, last long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


# --- tables kept by generations ----------------------------------------------------------
def _drop_before(spark: SparkSession, path: str, generation: int) -> None:
    """Delete generations that no repeated batch can ask for any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        if name.startswith("generation=") and int(name.partition("=")[2]) < generation:
            fs.delete(s.getPath(), True)


def job_status_sink(log_path: str):
    """foreachBatch function that keeps the latest event of each (tile, band) at a path.

    Each batch writes a new generation beside the old one; a repeated batch id rewrites its
    own generation only.  The one before stays for that, older ones are deleted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = spark.read.schema(batch.schema).parquet(f"{log_path}/generation={batch_id - 1}").unionByName(batch)
        upsert_jobs(rows).select(batch.columns).write.mode("overwrite").parquet(f"{log_path}/generation={batch_id}")
        _drop_before(spark, log_path, batch_id - 1)

    return run


#: Sums of a bucket, from which its figures follow, and the state of the stream.
_SUMS = "bucket timestamp, n long, total double, squares double, peak double"
_STATE = "newest timestamp, late long, rows long"


def resource_sink(path: str, late: str = "2 hours", every: str = "1 hour"):
    """foreachBatch function for samples (ts, value): figures of fixed buckets, and an exact count of late rows.

    A row is late if its bucket ended before the newest time of earlier batches less
    ``late``.  Late rows change no bucket, but are counted.  Read the figures with
    ``resource_figures`` and ``resource_totals``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/buckets/generation={batch_id - 1}", f"{path}/state/generation={batch_id - 1}"
        sums = spark.read.schema(_SUMS).parquet(before[0]) if batch_id else spark.createDataFrame([], _SUMS)
        state = spark.read.schema(_STATE).parquet(before[1]) if batch_id else spark.createDataFrame([(None, 0, 0)], _STATE)
        rows = batch.select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withColumn("w", F.window("ts", every))
        # the state is one row
        marked = rows.crossJoin(F.broadcast(state.select("newest"))).withColumn("behind", F.coalesce(F.col("w.end") <= F.col("newest") - F.expr(f"interval {late}"), F.lit(False))).persist()
        fresh = marked.where("not behind").groupBy(F.col("w.start").alias("bucket")).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.max("value").alias("peak"))
        merged = sums.unionByName(fresh).groupBy("bucket").agg(*(f(c).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("squares", F.sum), ("peak", F.max))))
        merged.write.mode("overwrite").parquet(f"{path}/buckets/generation={batch_id}")
        seen = marked.agg(F.max("ts").alias("newest"), F.count_if("behind").alias("late"), F.count("*").alias("rows"))
        state.unionByName(seen).agg(F.max("newest").alias("newest"), F.sum("late").alias("late"), F.sum("rows").alias("rows")).write.mode("overwrite").parquet(f"{path}/state/generation={batch_id}")
        marked.unpersist()
        for part in ("buckets", "state"):
            _drop_before(spark, f"{path}/{part}", batch_id - 1)

    return run


def _newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    every = spark.read.schema(f"{schema}, generation long").parquet(path)
    return every.where(F.col("generation") == (every.agg(F.max("generation")).first()[0] or 0)).drop("generation")


def resource_figures(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, peak, mean, std, n) of a resource sink."""
    s = _newest(spark, f"{path}/buckets", _SUMS)
    mean = F.try_divide("total", "n")
    return s.select("bucket", "peak", mean.alias("mean"), F.sqrt(F.greatest(F.try_divide("squares", "n") - mean * mean, F.lit(0.0))).alias("std"), "n")


def resource_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: overall peak, mean of the buckets' means, root of the mean of their variances, rows and late rows."""
    f = resource_figures(spark, path).agg(F.max("peak").alias("peak"), F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"))
    return f.crossJoin(_newest(spark, f"{path}/state", _STATE).select("rows", "late"))  # one row by one


def new_positive_stream(rows: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


# --- scores ------------------------------------------------------------------------------
def score_sink(path: str, make_models, key: str = "object_id", column: str = "values", batch: int = 128):
    """foreachBatch function that scores arriving arrays; rows that a model fails on are kept for a retry.

    A batch writes its scores below ``scored`` and its failures, with the message, below
    ``failed``; a repeated batch id rewrites its own files only.  ``scores`` reads the
    results, ``retry_failed`` takes up what failed.
    """
    from skycat.operators.scoring import score_or_error

    def run(rows: DataFrame, batch_id: int) -> None:
        _store(score_or_error(rows, make_models, column, batch), path, batch_id)

    return run


def _store(out: DataFrame, path: str, batch_id: int) -> None:
    out = out.persist()
    out.where("error is null").drop("error").write.mode("overwrite").parquet(f"{path}/scored/batch={batch_id}")
    out.where("error is not null").drop("score").write.mode("overwrite").parquet(f"{path}/failed/batch={batch_id}")
    out.unpersist()


def scores(spark: SparkSession, path: str, key: str = "object_id") -> DataFrame:
    """The scored rows, one for each key: of repeated ones the latest batch, and a retry before all."""
    from pyspark.sql.window import Window

    rows = spark.read.parquet(f"{path}/scored")
    latest = Window.partitionBy(key).orderBy((F.col("batch") < 0).desc(), F.abs("batch").desc())
    return rows.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "batch")


def failures(spark: SparkSession, path: str, key: str = "object_id") -> DataFrame:
    """Rows that failed and have no score since, with the last message."""
    rows = spark.read.parquet(f"{path}/failed")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), F.struct((F.col("batch") < 0).alias("again"), F.abs("batch").alias("batch"))).alias("r")).select(key, "r.*")
    return last.join(spark.read.parquet(f"{path}/scored").select(key).distinct(), key, "left_anti")


def retry_failed(spark: SparkSession, path: str, make_models, key: str = "object_id", column: str = "values", batch: int = 128) -> int:
    """Score again what failed; returns how many rows are still without a score.  Retries count down from batch -1."""
    from skycat.operators.scoring import score_or_error

    lowest = min(spark.read.parquet(f"{path}/{p}").agg(F.min("batch")).first()[0] or 0 for p in ("scored", "failed"))
    _store(score_or_error(failures(spark, path, key).drop("error"), make_models, column, batch), path, min(lowest, 0) - 1)
    return failures(spark, path, key).count()
