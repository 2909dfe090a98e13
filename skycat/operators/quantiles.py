"""Exact quantiles without holding a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.operators.components import shared_folder

#: Parts into which a range of values is cut in each round.
PARTS = 1024
#: Values that one task sorts at most: groups and ranges of so many are not cut any further.
SORTED = 1 << 18


def _written(df):
    path = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, keys, value: str, quantiles: dict[str, float], parts: int = PARTS, sorted_at_once: int = SORTED) -> DataFrame:
    """(keys, one column for each named quantile), linear between neighbouring values; groups without values are absent.

    Groups of up to ``sorted_at_once`` values are one aggregation.  Larger ones are selected by
    counting: each wanted place in the order has a range of values that holds it.  In a round
    the range is cut into ``parts``, the rows of each part are counted with their least and
    greatest value, and the range becomes that of the part where the place lies, until its two
    ends agree or it holds few enough values to sort them.  Only counts meet; a round is one scan.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = _written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0"))
    large = ends.where(F.col("_n") > sorted_at_once)
    if large.isEmpty():
        return _sorted_quantiles(rows, keys, quantiles)
    counted = _counted_quantiles(rows, large, keys, quantiles, parts, sorted_at_once)
    if not keys:
        return counted
    return counted.unionByName(_sorted_quantiles(rows.join(large.select(*keys), keys, "left_anti"), keys, quantiles))


def _sorted_quantiles(rows, keys, quantiles):
    found = rows.groupBy(*keys).agg(F.percentile("_v", F.array(*(F.lit(float(q)) for q in quantiles.values()))).alias("_q")).where("_q is not null")
    return found.select(*keys, *(F.col("_q")[i].alias(name) for i, name in enumerate(quantiles)))


def _counted_quantiles(rows, ends, keys, quantiles, parts, sorted_at_once):
    # without keys the places are a handful of rows
    meet = lambda facts: rows.join(facts, keys) if keys else rows.crossJoin(F.broadcast(facts))
    spot = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    wanted = F.explode(F.array(*(F.struct(F.lit(i * 2 + up).alias("_at"), (F.floor(spot(q)) if not up else F.ceil(spot(q))).cast("long").alias("_rank")) for i, q in enumerate(quantiles.values()) for up in (0, 1))))
    places = _written(ends.select(*keys, "_n", "_lo", "_hi", F.col("_n").alias("_c"), wanted.alias("p")).select(*keys, "_n", "_lo", "_hi", "_c", "p.*"))
    one = [*keys, "_at"]
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_c") > sorted_at_once)
    found, rest = places.where(~wide), places.where(wide)
    while not rest.isEmpty():
        held = meet(rest.drop("_c")).where("_v between _lo and _hi")
        part = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1))
        counted = held.groupBy(*one, "_n", "_rank", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*one).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counted.withColumn("_before", before).where("_before <= _rank and _rank < _before + _c")
        places = _written(chosen.select(*keys, "_n", "_lo", "_hi", "_c", "_at", (F.col("_rank") - F.col("_before")).alias("_rank")))
        found, rest = found.unionByName(places.where(~wide)), places.where(wide)
    few = meet(found.where("_lo < _hi").drop("_c")).where("_v between _lo and _hi").groupBy(*one, "_n", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    few = few.select(*one, "_n", F.expr("_all[int(_rank)]").alias("_lo"))
    found = found.where("_lo = _hi").select(*one, "_n", "_lo").unionByName(few)
    at = lambda i: F.max(F.when(F.col("_at") == i, F.col("_lo")))
    share = lambda q: spot(q) - F.floor(spot(q))
    sides = found.groupBy(*keys, "_n").agg(*(at(2 * i + up).alias(f"_{i}_{up}") for i in range(len(quantiles)) for up in (0, 1)))
    return sides.select(*keys, *((F.col(f"_{i}_0") + share(q) * (F.col(f"_{i}_1") - F.col(f"_{i}_0"))).alias(name) for i, (name, q) in enumerate(quantiles.items())))
