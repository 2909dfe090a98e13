"""Which tiles hold which points."""

from pyspark.sql import functions as F

from skycat.functions import sphere, tiles
from skycat.functions.sphere import ang_sep_arcsec


def tiles_containing(points, available, id_col):
    """(id, x, y, px, py, sep) for every available tile whose footprint holds the point.

    Candidates are the tiles of the three rows around the point, three columns each; the
    available tiles are joined by equality.
    """
    around = lambda c: F.explode(F.sequence(c.cast("int") - 1, c.cast("int") + 1))
    near = points.select(id_col, "ra", "dec").withColumn("y", around(F.rint((F.col("dec") + 90) * 2)))
    near = near.withColumn("x", around(F.rint(F.col("ra") * 2 * F.cos(F.radians(F.col("y") / 2 - 90)))))
    found = near.join(available.select("x", "y").distinct(), ["x", "y"])
    dec0 = F.col("y") / 2 - 90
    ra0 = F.col("x") / 2 / F.cos(F.radians(dec0))
    px, py = sphere.tan_project(F.col("ra"), F.col("dec"), ra0, dec0)
    placed = found.withColumns({"px": px, "py": py, "sep": ang_sep_arcsec(F.col("ra"), F.col("dec"), ra0, dec0)})
    return placed.where(sphere.in_footprint(F.col("px"), F.col("py"))).select(id_col, "x", "y", "px", "py", "sep")


def assign_tile(points, available, id_col):
    """The nearest such tile of each point, with the point's pixel there (1-based) and, if available tiles name bands, their bands and number.

    Points in none keep NULL.  ``available`` has x and y, and one row for each band or none.
    """
    best = tiles_containing(points, available, id_col).groupBy(id_col).agg(F.min(F.struct(F.round("sep", 6).alias("sep"), "x", "y", "px", "py")).alias("b"))
    out = points.join(best, id_col, "left").select(*points.columns, "b.x", "b.y", "b.px", "b.py")
    if "band" not in available.columns:
        return out
    bands = available.groupBy("x", "y").agg(F.sort_array(F.collect_set("band")).alias("bands")).withColumn("n_bands", F.size("bands"))
    return out.join(bands, ["x", "y"], "left")


def known_in_footprint(known, available, id_col):
    """Known objects on each tile's footprint, neighbours' objects included."""
    return tiles_containing(known, available, id_col).select(id_col, tiles.tile_key(F.col("x"), F.col("y")).alias("tile"))
