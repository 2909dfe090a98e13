"""Readers, writers and table updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.functions.nulls import nan_to_null
from skycat.functions.tiles import parse_tile_name


def scan_detections(spark, path, bands=None, tiles=None):
    """Per-tile Parquet below a root; tile and band come from the partition folders, or from folders ``xxx_yyy/band``.

    ``tiles`` are keys (x, y); both filters prune folders where the table is partitioned.
    """
    df = nan_to_null(spark.read.option("ignoreMissingFiles", "true").option("recursiveFileLookup", "false").parquet(path))
    if "tile_x" not in df.columns:
        where = F.col("_metadata.file_path")
        key = F.regexp_extract(where, r"/(\d+_\d+)/", 1)
        df = df.select("*", F.split(key, "_")[0].cast("int").alias("tile_x"), F.split(key, "_")[1].cast("int").alias("tile_y"), *([] if "band" in df.columns else [F.regexp_extract(where, r"/\d+_\d+/([^/]+)/", 1).alias("band")]))
    df = df.where(F.col("band").isin(*bands)) if bands else df
    return df.where(F.struct("tile_x", "tile_y").isin(*(F.struct(F.lit(x).cast("int").alias("tile_x"), F.lit(y).cast("int").alias("tile_y")) for x, y in tiles))) if tiles else df


def scan_catalog(spark, path, ra, dec, id_col, schema):
    """CSV with its column names mapped to ra, dec and id; a missing key is an error."""
    df = spark.read.csv(path, header=True, schema=schema)
    missing = {ra, dec, id_col} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are not in {path}")
    return nan_to_null(df.withColumnsRenamed({ra: "ra", dec: "dec", id_col: "id"}))


def scan_tile_list(spark, path):
    """One tile name per line; blank lines are dropped."""
    named = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    return named.withColumn("t", parse_tile_name(F.col("name"))).select("name", "t.x", "t.y")


def write_by_tile(df: DataFrame, path: str, keys=("tile_x", "tile_y")):
    """Replace only the tiles that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def exact_chunks(df: DataFrame, key: str, size: int, buckets: int | None = None) -> DataFrame:
    """Adds ``chunk``: consecutive runs of exactly ``size`` rows in key order, NULL first.

    Rows are dealt to ranges of the key (of any type) by a sample and written; they are
    numbered within their range, and only the counts per range meet.
    """
    from skycat.operators.components import shared_folder

    spark = df.sparkSession
    order = F.col(key).asc_nulls_first()
    # maps have no order and no hash; rows that differ in nothing else may stand in any order
    plain = [c for c, kind in df.dtypes if "map<" not in kind and c != key]
    ranged = df.repartitionByRange(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), order, F.xxhash64(key, *plain)).withColumn("_range", F.spark_partition_id())
    path = shared_folder(spark, "chunk-ranges")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("_range")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order, *plain)) - 1
    return ranged.withColumn("_within", within).join(F.broadcast(counts), "_range").withColumn("chunk", F.floor((F.col("first") + F.col("_within")) / size)).drop("_range", "_within", "first")


def write_chunks(df: DataFrame, key: str, size: int, path: str, labels=None) -> None:
    """One folder for each chunk of exactly ``size`` rows, of rows with these labels if given."""
    from skycat.operators.selection import label_filter

    exact_chunks(label_filter(df, labels), key, size).write.mode("overwrite").partitionBy("chunk").parquet(path)


def write_cutouts(cutouts: DataFrame, path: str) -> None:
    cutouts.write.mode("overwrite").parquet(path)


def read_cutouts(spark, path: str, columns=None, arrays=("values",)) -> DataFrame:
    """Cutouts with only the columns asked for; NaN pixels count as zero."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.withColumns({c: F.transform(c, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(None)), F.lit(0.0))) for c in arrays if c in df.columns})


def update_scores(table: DataFrame, scores: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The table with ``column`` replaced by the new scores; rows without one get NULL."""
    return table.drop(column).join(scores.select(*keys, column), keys, "left")


def new_positives(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")
