"""Object catalogs: cross-band grouping, deduplication, conflict resolution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skycat.functions.sphere import ang_sep_arcsec
from skycat.operators.components import connected_components
from skycat.operators.match import radius_join, radius_pairs
from skycat.operators.training import written


def band_groups(det, id_col="det_id", max_sep=10.0, keys=("tile_x", "tile_y")):
    """Adds ``component``: connected rows of different bands within max_sep in one tile."""
    pairs = radius_pairs(det, max_sep, id_col, "band", keys)
    parts = connected_components(pairs.select("u", "v"), det.select(id_col))
    return det.join(parts.withColumnRenamed("node", id_col), id_col)


def cross_band_catalog(det, max_sep=10.0, priority=("r", "g", "i")):
    """One wide row per object; see the survey for the selection rules.

    The grouped rows are written once and dealt by component once: the facts of a group, its
    median position, the choice in each band and the wide row all follow from that.
    """
    tile, columns = ["tile_x", "tile_y"], ["det_id", "band", "ra", "dec", "tile_x", "tile_y", "lsb", "id_known", "mag", "mu", "re_arcsec"]
    grouped = written(band_groups(det.select(columns), "det_id", max_sep, tuple(tile)), "band-groups")
    group = Window.partitionBy("component")
    known = F.max(F.when((F.col("lsb") == 1) | F.col("id_known").isNotNull(), 1).otherwise(0)).over(group)
    kept = grouped.withColumns({"n_bands": F.size(F.collect_set("band").over(group)), "known": known}).where("n_bands > 1 or known = 1")
    far = F.max("ra").over(group) - F.min("ra").over(group) > 180
    middle = lambda c: F.percentile(c, F.lit(0.5)).over(group)
    around = F.pmod(middle(F.when(F.col("ra") < 180, F.col("ra") + 360).otherwise(F.col("ra"))), F.lit(360.0))
    centred = kept.withColumns({"mra": F.when(far, around).otherwise(middle("ra")), "mdec": middle("dec")})
    sep = F.round(ang_sep_arcsec(F.col("ra"), F.col("dec"), F.col("mra"), F.col("mdec")), 6)
    near = F.row_number().over(Window.partitionBy("component", "band").orderBy("msep", "det_id"))
    rank = F.coalesce(*(F.when(F.col("band") == b, i) for i, b in enumerate(priority)))
    one = centred.withColumn("msep", sep).withColumn("rn", near).where("rn = 1").withColumn("rank", rank)
    by_rank = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rank", F.col(c).alias("v"))))["v"]
    wide = [F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}") for b in priority for c in ("det_id", "mag", "mu", "re_arcsec")]
    objects = one.groupBy("component").agg(by_rank("ra").alias("ra"), by_rank("dec").alias("dec"), *(by_rank(c).alias(c) for c in tile), by_rank("lsb").alias("lsb"), by_rank("id_known").alias("id_known"), *wide)
    return sequential_id(resolve_known_conflicts(objects, [f"mu_{b}" for b in priority]), tile)


def resolve_known_conflicts(objects, mu_columns, id_col="component"):
    """Of several objects with one known id, the one whose least mu is largest stays."""
    best = Window.partitionBy("id_known").orderBy(F.col("_mu").desc_nulls_last(), id_col)
    marked = objects.withColumn("_mu", F.least(*mu_columns)).withColumn("_rn", F.when(F.col("id_known").isNotNull(), F.row_number().over(best)).otherwise(1))
    return marked.where("_rn = 1").drop("_mu", "_rn")


def sequential_id(objects, tile=("tile_x", "tile_y"), order="component"):
    return objects.withColumn("unique_id", F.row_number().over(Window.partitionBy(*tile).orderBy(order)) - 1)


def _friends(df, max_sep, id_col, keys=()):
    """(id, component) of groups of rows within max_sep, borders included, that agree in the keys."""
    pairs = radius_pairs(df, max_sep, id_col, keys=tuple(keys), inclusive=True)
    return connected_components(pairs.select("u", "v"), df.select(id_col)).withColumnRenamed("node", id_col)


def fof_dedup(df, max_sep, id_col, priority, keys=()):
    """The row of highest priority of each friends-of-friends group of rows with the same keys; NULL priorities go first."""
    rated = df.where(F.col(priority).isNotNull())
    best = Window.partitionBy("component").orderBy(F.col(priority).desc(), id_col)
    return rated.join(_friends(rated, max_sep, id_col, keys), id_col).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def radius_dedup(df, id_col, priority, size="re_arcsec", factor=1.5, least=1.0, keys=()):
    """As fof_dedup with a threshold of factor x the larger size of the pair, ``least`` at least.

    Rows are dealt to size classes (powers of two); the rows of a class look for partners of
    their own and smaller classes on a grid of that class, so one large size does not widen
    the grid of all others.
    """
    reach = F.greatest(F.lit(float(least)), F.coalesce(factor * F.when(F.col(size) < float("inf"), F.col(size)), F.lit(0.0)))
    sized = df.select(id_col, *keys, "ra", "dec", reach.alias("_reach")).withColumn("_class", F.ceil(F.log2(F.col("_reach") / least)).cast("int"))
    pairs = None
    for c in sorted(r[0] for r in sized.select("_class").distinct().collect()):  # a handful of powers of two
        near = radius_join(sized.where(F.col("_class") == c), sized.where(F.col("_class") <= c), least * 2.0**c, keys=tuple(keys))
        near = near.where((F.col(f"l.{id_col}") != F.col(f"r.{id_col}")) & (F.col("sep") <= F.greatest("l._reach", "r._reach"))).select(F.col(f"l.{id_col}").alias("u"), F.col(f"r.{id_col}").alias("v"))
        pairs = near if pairs is None else pairs.union(near)
    pairs = df.select(F.col(id_col).alias("u"), F.col(id_col).alias("v")).limit(0) if pairs is None else pairs
    parts = connected_components(pairs, df.select(id_col))
    best = Window.partitionBy("component").orderBy(F.col(priority).desc_nulls_last(), id_col)
    return df.join(parts.withColumnRenamed("node", id_col), id_col).withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def duplicate_report(df, id_col, priority, max_sep, keys=()):
    """Members of groups of two or more: the best member's id (highest priority, then least id, of whatever type) and whether the row is it."""
    joined = df.join(_friends(df, max_sep, id_col, keys), id_col)
    first = F.min(F.struct(F.col(priority).isNull().alias("none"), (-F.col(priority)).alias("p"), F.col(id_col).alias("best_id")))
    best = joined.groupBy("component").agg(F.count("*").alias("members"), first.alias("b")).where("members > 1")
    return joined.join(best, "component").select(id_col, "component", "members", "b.best_id", (F.col(id_col) == F.col("b.best_id")).alias("is_best"))


def duplicate_details(df, id_col, priority, max_sep, keys=()):
    """duplicate_report with the separation from the best member, whether both lie on one tile, and the threshold."""
    report = duplicate_report(df, id_col, priority, max_sep, keys)
    place = lambda p: df.select(F.col(id_col).alias(f"{p}_id"), F.col("ra").alias(f"{p}_ra"), F.col("dec").alias(f"{p}_dec"), F.struct("tile_x", "tile_y").alias(f"{p}_tile"))
    both = report.join(place("own"), F.col(id_col) == F.col("own_id")).join(place("top"), F.col("best_id") == F.col("top_id"))
    sep = ang_sep_arcsec(F.col("own_ra"), F.col("own_dec"), F.col("top_ra"), F.col("top_dec"))
    return both.select(*report.columns, sep.alias("sep_to_best"), (F.col("own_tile") == F.col("top_tile")).alias("same_tile"), F.lit(float(max_sep)).alias("threshold"))


def fill_missing_ids(target, cat, id_col, known="id_known", max_sep=10.0):
    """NULL ids take the id of the nearest catalog row within max_sep, borders included."""
    from skycat.operators.match import nearest_match

    found = nearest_match(target.where(F.col(known).isNull()), cat, max_sep, id_col, "id", inclusive=True).select(F.col("left_id").alias(id_col), "right_id")
    return target.join(found, id_col, "left").withColumn(known, F.coalesce(known, "right_id")).drop("right_id")


def reference_join(det, max_sep=15.0, reference="r", others=("g", "i"), id_col="det_id"):
    """Reference-band rows with their nearest row in every other band."""
    from skycat.operators.match import nearest_match

    base = det.where(F.col("band") == reference)
    out = base.select(F.col(id_col).alias(f"{reference}_id"))
    for b in others:
        near = nearest_match(base, det.where(F.col("band") == b), max_sep, id_col, id_col).select(F.col("left_id").alias(f"{reference}_id"), F.col("right_id").alias(f"{b}_id"))
        out = out.join(near, f"{reference}_id")
    return out


def reference_catalog(det, max_sep=15.0, reference="r", others=("g", "i"), id_col="det_id", known="id_known", tile=("tile_x", "tile_y")):
    """(known id, one id a band, tile): known objects joined by their id in all bands, the rest by place as reference_join does.

    A known object needs a row in every band; of several rows of one band the one with the
    least id counts.  Rows with a known id take no part in the join by place.  The tile is
    that of the reference row.
    """
    bands = [reference, *others]
    named = det.where(F.col(known).isNotNull() & F.col("band").isin(bands)).groupBy(known).agg(*(F.min(F.when(F.col("band") == b, F.col(id_col))).alias(f"{b}_id") for b in bands))
    for b in bands:
        named = named.where(F.col(f"{b}_id").isNotNull())
    free = reference_join(det.where(F.col(known).isNull()), max_sep, reference, others, id_col)
    both = named.unionByName(free, allowMissingColumns=True)
    return both.join(det.select(F.col(id_col).alias(f"{reference}_id"), *tile), f"{reference}_id").select(known, *(f"{b}_id" for b in bands), *tile)
