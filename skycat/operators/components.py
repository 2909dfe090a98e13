"""Connected components over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _cut(df: DataFrame) -> DataFrame:
    """The edges written and read again."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "components")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    """Count and hash sum of written edges: an aggregate over the files, for a listener of the write would stay in the session."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest reachable node; isolated nodes keep their own id.

    ``edges`` has columns u and v.  Alternating large-star and small-star rounds (Kiveris et
    al. 2014); both halves of a round are written to the shared folder, so that a lost
    executor costs half a round.  Rounds grow with the logarithm of the longest chain.
    Without ``nodes`` only nodes with an edge to a smaller one are returned.
    """
    now = _cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, state = None, _state(now)
    while state[0] and state != before:
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = _cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = _state(now)
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    if nodes is None:
        return found
    ids = nodes.toDF("node").distinct()
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
