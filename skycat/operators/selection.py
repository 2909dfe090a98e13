"""Row selection: catalogs by band, unknown objects, labels, tiles, boxes, stars, bad image regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.functions.tiles import bands_contain

#: Points that go to the pixels as a broadcast; more of them meet the pixels by a shuffle.
FEW_POINTS = 100_000


def box_scan(df: DataFrame, ra_range, dec_range, columns=None) -> DataFrame:
    """Rows in a closed box; on Parquet both ranges and the columns reach the scan."""
    inside = df.where(F.col("ra").between(*ra_range) & F.col("dec").between(*dec_range))
    return inside.select(*columns) if columns else inside


def catalog_for_bands(cat: DataFrame, wanted, tile: str = "tile", bands: str = "bands") -> DataFrame:
    """Catalog rows on a tile whose bands hold all wanted ones."""
    return cat.where(F.col(tile).isNotNull() & bands_contain(F.col(bands), wanted))


def known_tiles(cat: DataFrame, tile: str = "tile") -> DataFrame:
    return cat.select(tile).where(F.col(tile).isNotNull()).distinct()


def unknown_objects(df: DataFrame, score: str | None = None, above: float = 0.0) -> DataFrame:
    """Rows outside the training data without known class or redshift, above a score if one is given."""
    free = df.where((F.coalesce("in_training_data", F.lit(0)) == 0) & F.col("lsb").isNull() & F.col("class_label").isNull() & F.col("zspec").isNull())
    return free.where(F.col(score) > above) if score else free


def label_filter(df: DataFrame, labels=None, column: str = "label") -> DataFrame:
    """Rows whose label is one of these; 'nan' stands for no label, None for all rows."""
    if labels is None:
        return df
    values = [v for v in labels if v != "nan"]
    tests = ([F.col(column).isin(values)] if values else []) + ([F.col(column).isNull()] if "nan" in labels else [])
    return df.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def tiles_with_bands(matrix: DataFrame, bands) -> DataFrame:
    """Tiles of an availability matrix that hold all of these bands."""
    return matrix.where(reduce(lambda a, b: a & b, [F.col(b) == 1 for b in bands], F.lit(True))).select("tile")


def tiles_min_bands(matrix: DataFrame, every, n: int) -> DataFrame:
    """Tiles with at least n of the bands."""
    return matrix.where(sum((F.col(b) for b in every), F.lit(0)) >= n).select("tile")


def restrict_tiles(available: DataFrame, tiles: DataFrame, key: str = "tile") -> DataFrame:
    return available.join(tiles.select(key).distinct(), key, "left_semi")


def clean_stars(stars: DataFrame, limit: float = 20.6, frame: tuple[int, int] | None = None) -> DataFrame:
    """Stars without missing values that are no galaxy candidates, bright enough and strictly inside the frame."""
    kept = stars.dropna().where(~F.col("in_galaxy_candidates") & (F.col("gmag") < limit))
    return kept.where((F.col("x") > 0) & (F.col("x") < frame[0]) & (F.col("y") > 0) & (F.col("y") < frame[1])) if frame else kept


def split_stars(stars: DataFrame, magnitude: float) -> tuple[DataFrame, DataFrame]:
    """(bright, faint) at a magnitude."""
    return stars.where(F.col("gmag") <= magnitude), stars.where(F.col("gmag") > magnitude)


def near_pixels(points: DataFrame, px: DataFrame, radius: int, keys=()) -> DataFrame:
    """Each point (x, y and its other columns, prefixed p_) with the pixels of the square of this radius around it.

    Points meet pixels with the same ``keys`` only.  Squares are cut by cells of their own
    width, so a point meets four cells at most.
    """
    side, keys = 2 * radius + 1, list(keys)
    cell = lambda c, d: F.floor((F.col(c) + d) / side).cast("long")
    both = lambda c: F.explode(F.array_distinct(F.array(cell(c, -radius), cell(c, radius))))
    around = points.select(*keys, *(F.col(c).alias(f"p_{c}") for c in points.columns if c not in keys), "x", "y").withColumn("_cx", both("x")).withColumn("_cy", both("y")).drop("x", "y")
    cells = px.withColumns({"_cx": cell("x", 0), "_cy": cell("y", 0)})
    joined = around.join(cells, [*keys, "_cx", "_cy"]).drop("_cx", "_cy")
    return joined.where((F.abs(F.col("x") - F.col("p_x")) <= radius) & (F.abs(F.col("y") - F.col("p_y")) <= radius))


def corrupted_at(points: DataFrame, px: DataFrame, id_col: str, radius: int, share: float = 0.6) -> DataFrame:
    """(image, id, zero_share, corrupted): zero pixels in the square around each point, as far as its image goes.

    Points with a tile are looked up on every band of their tile.  Up to ``FEW_POINTS`` points
    are broadcast.
    """
    from skycat.operators.pixels import image_keys
    from skycat.operators.training import written

    keys, shared = image_keys(px), image_keys(px, points)
    zero = F.avg(F.when(F.col("value") == 0, 1.0).otherwise(0.0))
    whole = points.select(*shared, id_col, F.rint("x").cast("long").alias("x"), F.rint("y").cast("long").alias("y"))
    # few points go to the pixels, so that these need not move
    whole = written(whole, "points")
    if whole.count() <= FEW_POINTS:
        whole = F.broadcast(whole)
    near = near_pixels(whole, px.select(*keys, "x", "y", "value"), radius, shared)
    return near.groupBy(*keys, F.col(f"p_{id_col}").alias(id_col)).agg(zero.alias("zero_share")).withColumn("corrupted", F.col("zero_share") > share)


def star_halo_flag(stars: DataFrame, px: DataFrame, radius: int, limit: float = 14.0) -> DataFrame:
    """(image, segment_id, source_id, gmag) of segments with a pixel on a bright star's disc, with the bright star closest to their peak.

    The closest star is looked for among all bright stars of the tile within the reach of a
    segment: a star whose disc touches it lies nearer to its peak than ``radius`` plus the
    segment's size.
    """
    from skycat.operators.pixels import image_keys

    keys, shared = image_keys(px), image_keys(px, stars)
    own = [*keys, "segment_id"]
    bright = stars.where(F.col("gmag") < limit).select(*shared, "source_id", "gmag", F.rint("x").cast("long").alias("x"), F.rint("y").cast("long").alias("y"))
    segments = px.where("segment_id is not null").select(*own, "x", "y", "value")
    inside = near_pixels(bright, segments, radius, shared).where(F.pow(F.col("x") - F.col("p_x"), F.lit(2)) + F.pow(F.col("y") - F.col("p_y"), F.lit(2)) <= radius * radius)
    flagged = inside.select(*own).distinct()
    peak = segments.join(flagged, own, "left_semi").groupBy(*own).agg(F.max(F.struct("value", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("p"), F.max("x").alias("x1"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.min("y").alias("y0"))
    peak = peak.select(*own, (-F.col("p.x")).alias("x"), (-F.col("p.y")).alias("y"), F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("size"))
    reach = int(radius + (peak.agg(F.max("size")).first()[0] or 0) + 1)
    gap = F.pow(F.col("x") - F.col("p_x"), F.lit(2)) + F.pow(F.col("y") - F.col("p_y"), F.lit(2))
    best = F.min(F.struct(gap.alias("gap"), "source_id", "gmag")).alias("b")
    # the peaks are the points here, so the columns of the other image key stay theirs
    others = [k for k in keys if k not in shared]
    near = near_pixels(peak, bright, reach, shared)
    return near.groupBy(*shared, *(F.col(f"p_{k}").alias(k) for k in others), F.col("p_segment_id").alias("segment_id")).agg(best).select(*own, "b.source_id", "b.gmag")


def count_duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def common_ids(tables, key: str) -> DataFrame:
    """Keys that all tables hold."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key) for t in tables])


def missing_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less those of b, each as often as it is left."""
    return a.exceptAll(b)


def top_stars(stars: DataFrame, n: int) -> DataFrame:
    """The n faintest stars, faint to bright."""
    return stars.select("source_id", "gmag").orderBy(F.col("gmag").desc(), "source_id").limit(n)


def bands_per_object(det: DataFrame, key: str) -> DataFrame:
    return det.groupBy(key).agg(F.count("id_known").alias("with_id"), F.count_distinct("band").alias("n_bands"))


def id_tally(df: DataFrame, known: DataFrame, id_col: str, by: str) -> DataFrame:
    """Per group: rows whose id is in a set, rows without id, rows with another id."""
    marked = df.join(known.select(F.col(id_col)).distinct().withColumn("_in", F.lit(True)), id_col, "left")
    return marked.groupBy(by).agg(F.count_if(F.col("_in").isNotNull()).alias("matched"), F.count_if(F.col(id_col).isNull()).alias("no_id"), F.count_if(F.col(id_col).isNotNull() & F.col("_in").isNull()).alias("other"))


def union_bands(tables) -> DataFrame:
    """All tables in one, with NULL for the columns that one lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_tiles(tiles: DataFrame, n: int, key: str = "tile") -> DataFrame:
    return tiles.select(key).distinct().orderBy(key).limit(n)
