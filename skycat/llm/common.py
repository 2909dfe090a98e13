"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.operators.components import shared_folder

#: Words of the quality contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, purpose: str, shuffle: bool = True) -> DataFrame:
    """As ``written``, in buckets of the key: joins on it then move the other side only.

    Without ``shuffle`` the rows of a task must belong to one bucket already.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, purpose)
    name = path.rpartition("/")[2].replace("-", "_")
    dealt = df.repartition(buckets, key) if shuffle else df
    dealt.write.option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, and the plan knows them and their buckets
    return back


def quoted(name: str) -> str:
    """A column name as Spark reads it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that the table does not have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
