"""Tile names, keys and the half-degree tile grid."""

from pyspark.sql import functions as F


def parse_tile_name(name):
    """struct<x, y> from a file name; see the survey's unit cases."""
    dashed = F.regexp_extract_all(name, F.lit(r"(?<=[_-])(\d+)(?=[_.])"), F.lit(1))
    dotted = F.regexp_extract_all(name, F.lit(r"(?<=\.)(\d+)(?=\.)"), F.lit(1))
    parts = F.when(name.startswith("calexp"), dashed).otherwise(dotted)
    return F.struct(F.get(parts, F.lit(0)).cast("int").alias("x"), F.get(parts, F.lit(1)).cast("int").alias("y"))


def tile_key(x, y):
    return F.format_string("%03d_%03d", x, y)


def parse_tile_key(text):
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    return F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")


def _padded(n, width):
    return F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string"))


def tile_file_name(x, y, prefix, delimiter, suffix, width=3):
    return F.concat(F.lit(prefix), F.lit(delimiter), _padded(x, width), F.lit(delimiter), _padded(y, width), F.lit(suffix))


def tile_to_radec(x, y):
    dec = y / 2 - 90
    return F.bround(x / 2 / F.cos(F.radians(dec)), 12), F.bround(dec, 12)


def tile_centre(x, y):
    """Right ascension and declination of a tile's centre to six places."""
    ra, dec = tile_to_radec(x, y)
    return F.bround(ra, 6), F.bround(dec, 6)


def radec_to_tile(ra, dec):
    return (ra * 2 * F.cos(F.radians(dec))).cast("int"), ((dec + 90) * 2).cast("int")


def tile_neighbours(df, x="x", y="y"):
    """One row per existing neighbour (nx, ny) of each tile."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    around = F.explode(F.array(*(F.struct((F.col(x) + i).alias("nx"), (F.col(y) + j).alias("ny")) for i, j in steps)))
    return df.withColumn("_n", around).select(*df.columns, "_n.nx", "_n.ny").where("nx >= 0 and nx < 1000 and ny >= 0 and ny < 1000")


def bands_contain(bands, wanted):
    """A list string holds all wanted names; a plain string holds the text; NULL holds nothing."""
    names = F.regexp_extract_all(bands, F.lit(r"'([^']*)'"), F.lit(1))
    listed = F.size(F.array_except(F.array(*map(F.lit, wanted)), names)) == 0
    return F.coalesce(F.when(bands.startswith("["), listed).otherwise(bands.contains("".join(wanted))), F.lit(False))
