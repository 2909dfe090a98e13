"""Known objects on detections: labels, match statistics, training flags, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.operators.footprint import tiles_containing
from skycat.operators.match import attach_redshift, nearest_match, radius_join, scored_match


def label_known(det: DataFrame, known: DataFrame, zcat: DataFrame | None = None, det_id: str = "det_id", known_id: str = "id", keys=(), by=()) -> DataFrame:
    """Detections with ``lsb`` 1 and ``id_known`` where a known object chose them, and the redshift of ``zcat``.

    Of several objects that chose one detection the best-scored gives the id, then the least
    id.  With ``keys`` (a tile) objects choose among the detections of their tile only, and
    with ``by`` (a band) in each band by itself.
    """
    plain = det.drop("lsb", "id_known", *(["zspec"] if zcat is not None else []))
    chosen = scored_match(known, plain, known_id, det_id, keys=keys, by=by)
    best = chosen.groupBy(det_id).agg(F.min(F.struct((-F.col("score")).alias("s"), "known_id"))["known_id"].alias("id_known"))
    out = plain.join(best, det_id, "left").withColumn("lsb", F.when(F.col("id_known").isNotNull(), 1.0))
    return out if zcat is None else attach_redshift(out, zcat, det_id, "id", by=by)


def placed_known(known: DataFrame, det: DataFrame, known_id: str = "id") -> DataFrame:
    """The known objects once for every tile of the detections whose footprint holds them, neighbours' objects included."""
    tiles = det.select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).distinct()
    held = tiles_containing(known, tiles, known_id).select(F.col(known_id), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"))
    return known.drop("tile_x", "tile_y").join(held, known_id)


#: Columns of a tile, and of a tile in one band.
TILE, IMAGE = ("tile_x", "tile_y"), ("tile_x", "tile_y", "band")


def label_images(det: DataFrame, known: DataFrame, zcat: DataFrame | None = None, det_id: str = "det_id", known_id: str = "id") -> DataFrame:
    """label_known by tile and band, with the known objects of each tile's whole footprint."""
    return label_known(det, placed_known(known, det, known_id), zcat, det_id, known_id, keys=TILE, by=("band",))


def known_status(det: DataFrame, det_full: DataFrame, known: DataFrame, corrupted: DataFrame | None = None, det_id: str = "det_id", known_id: str = "id", images: bool = False) -> DataFrame:
    """(id, matched, corrupted, recovered) per known object, or per object, tile and band.

    ``recovered``: not matched, but found among the unfiltered detections.  ``corrupted`` (id,
    corrupted) says which unmatched objects lie on bad image regions; by image it has the
    tile and band too.  By image, an object counts on every tile whose footprint holds it, in
    all bands that the unfiltered detections have there.
    """
    one, keys, by = ["known_id", *(IMAGE if images else ())], TILE if images else (), ("band",) if images else ()
    rows = placed_known(known, det_full, known_id) if images else known
    ids = rows.select(F.col(known_id).alias("known_id"), *keys).distinct()
    if images:
        ids = ids.join(det_full.select(*IMAGE).distinct(), list(TILE))
    hit = lambda df, name: scored_match(rows, df, known_id, det_id, keys=keys, by=by).select(*one, F.lit(True).alias(name))
    out = ids.join(hit(det, "matched"), one, "left").join(hit(det_full, "found"), one, "left")
    bad = None if corrupted is None else corrupted.withColumnRenamed(known_id, "known_id").withColumnRenamed("corrupted", "bad").select(*one, "bad")
    out = out.withColumn("bad", F.lit(False)) if bad is None else out.join(bad, one, "left")
    no = F.lit(False)
    free = F.col("matched").isNull()
    return out.select(*one, F.coalesce("matched", no).alias("matched"), (F.coalesce("bad", no) & free).alias("corrupted"), (F.coalesce("found", no) & free).alias("recovered"))


def match_stats(status: DataFrame, by=()) -> DataFrame:
    """Known, matched, corrupted, recovered and unmatched objects, in all or by tile and band; unmatched counts those found nowhere and the corrupted ones."""
    n = lambda c: F.count_if(c)
    m, bad, again = F.col("matched"), F.col("corrupted"), F.col("recovered")
    c = status.groupBy(*by).agg(F.count("*").alias("known"), n(m).alias("matched"), n(bad).alias("corrupted"), n(again).alias("recovered"), n(~m & ~again).alias("lost"), n(~m & ~bad).alias("clean"))
    return c.select(*by, "known", "matched", "corrupted", "recovered", F.when(F.col("clean") > 0, F.col("lost") + F.col("corrupted")).otherwise(F.col("corrupted")).alias("unmatched"))


def match_rate(matched: DataFrame, tile=("tile_x", "tile_y")) -> DataFrame:
    """Mean number of matched rows over all tiles; ``matched`` holds every detection with its ``lsb``."""
    per = matched.groupBy(*tile).agg(F.count_if(F.col("lsb") == 1).alias("n"))
    return per.agg(F.avg("n").alias("match_rate"), F.count("*").alias("tiles"))


def flag_training(det: DataFrame, train: DataFrame, max_sep: float = 5.0, id_col: str = "det_id", keys=("tile_x", "tile_y")) -> DataFrame:
    """Adds in_training_data (a training row of the same tile within max_sep, borders included), id_in_training, train_id and visual_class."""
    near = nearest_match(det, train, max_sep, id_col, "known_id", inclusive=True, keys=tuple(keys)).select(F.col("left_id").alias(id_col), F.col("right_id").alias("train_id"))
    ids = train.select(*keys, F.col("known_id").alias("id_known")).distinct().withColumn("_id", F.lit(1))
    out = det.join(near, id_col, "left").join(ids, [*keys, "id_known"], "left")
    kind = F.when(F.col("train_id").startswith("non_dwarf"), 0).when(F.col("train_id").isNotNull(), 1)
    return out.withColumns({"in_training_data": F.col("train_id").isNotNull().cast("int"), "id_in_training": F.coalesce("_id", F.lit(0)), "visual_class": kind}).drop("_id")


def training_mismatches(flagged: DataFrame, train: DataFrame, keys=("tile_x", "tile_y")) -> DataFrame:
    """Tiles whose matches by place or by id are not as many as their training rows."""
    counts = flagged.groupBy(*keys).agg(F.sum("in_training_data").alias("by_place"), F.sum("id_in_training").alias("by_id"), F.count_distinct("train_id").alias("distinct_rows"), F.sum(F.col("in_training_data") * F.col("id_in_training")).alias("by_both"))
    total = train.groupBy(*keys).agg(F.count("*").alias("training"))
    return total.join(counts, list(keys)).where("by_place <> training or by_id <> training")


def training_totals(flagged: DataFrame, train: DataFrame) -> DataFrame:
    """Training rows found and missing, dwarfs and others among them."""
    found = flagged.where("train_id is not null").select(F.col("train_id").alias("known_id")).distinct().withColumn("_hit", F.lit(True))
    t = train.select("known_id").join(found, "known_id", "left")
    hit, other = F.col("_hit").isNotNull(), F.col("known_id").startswith("non_dwarf")
    return t.agg(F.count_if(hit).alias("found"), F.count_if(~hit).alias("missing"), F.count_if(~other).alias("dwarf"), F.count_if(other).alias("non_dwarf"))


def best_score_lookup(points: DataFrame, objects: DataFrame, available: DataFrame, point_id: str, object_id: str, score: str = "score", max_sep: float = 5.0) -> DataFrame:
    """(point id, object id, score): over all tiles that hold a point, the best-scored object within max_sep; NULL where there is none."""
    held = tiles_containing(points, available, point_id).select(F.col(point_id), F.col("x").alias("tile_x"), F.col("y").alias("tile_y"))
    placed = points.select(point_id, "ra", "dec").join(held, point_id)
    near = radius_join(placed, objects.select(object_id, "ra", "dec", "tile_x", "tile_y", score), max_sep, keys=("tile_x", "tile_y"))
    best = near.groupBy(F.col(f"l.{point_id}").alias(point_id)).agg(F.min(F.struct((-F.col(f"r.{score}")).alias("s"), F.col(f"r.{object_id}").alias("o"))).alias("b"))
    return points.select(point_id).join(best.select(point_id, F.col("b.o").alias(object_id), (-F.col("b.s")).alias(score)), point_id, "left")


def pick_cutouts(cat: DataFrame, cutouts: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(cutouts of the catalog rows with the rows' other columns, one row with the numbers found and not found)."""
    keys = list(keys)
    found = cat.join(cutouts, keys)
    held = cat.join(cutouts.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return found, held.agg(F.count_if(F.col("_hit").isNotNull()).alias("found"), F.count_if(F.col("_hit").isNull()).alias("not_found"))


def coords_input(spark, points) -> DataFrame:
    """(id, ra, dec) of literal points, ids from 1."""
    return spark.createDataFrame([(i, float(ra), float(dec)) for i, (ra, dec) in enumerate(points, 1)], "id long, ra double, dec double")
