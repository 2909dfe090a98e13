"""Spherical matching as equi-joins on a 3-D grid of unit vectors.

A point lies in one cell of edge ``K`` chords; a probe is copied to the at most eight cells
that its chord ball touches.  The cell join is a hash equi-join; the exact separation filters
afterwards.  There is no pole and no wrap at 0/360 degrees.
"""

from __future__ import annotations

from math import radians, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skycat.functions.sphere import ang_sep_arcsec, unit_vector

#: Cells of this size hold few points beyond the chord, and a probe few cells.
K = 3
#: nearest_match looks within these shares of its separation, one after the other.
SHARES = (1 / 16, 1 / 4, 1)


def _cells(df, chord, probe, ra="ra", dec="dec"):
    edge = K * chord
    axes = unit_vector(F.col(ra), F.col(dec))
    if not probe:
        return df.withColumns({c: F.floor(v / edge).cast("long") for c, v in zip(("cx", "cy", "cz"), axes)})
    for c, v in zip(("cx", "cy", "cz"), axes):
        df = df.withColumn(c, F.explode(F.array_distinct(F.array(F.floor((v - chord) / edge).cast("long"), F.floor((v + chord) / edge).cast("long")))))
    gaps = [F.greatest(F.lit(0.0), F.col(c) * edge - v, v - (F.col(c) + 1) * edge) for c, v in zip(("cx", "cy", "cz"), axes)]
    return df.where(sum(g * g for g in gaps) <= chord * chord * (1 + 1e-6))


def radius_join(left: DataFrame, right: DataFrame, max_sep: float, inclusive: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """All (l, r, sep) with separation below max_sep; columns become structs l and r.

    ``keys`` are columns that must also agree (for example tile).
    """
    chord = 2 * sin(radians(max_sep / 3600) / 2) * (1 + 1e-9) + 1e-15
    a = _cells(left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), *(F.col(k) for k in keys)), chord, True, "l_ra", "l_dec")
    b = _cells(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), *(F.col(k) for k in keys)), chord, False, "r_ra", "r_dec")
    sep = ang_sep_arcsec(F.col("l_ra"), F.col("l_dec"), F.col("r_ra"), F.col("r_dec"))
    joined = a.join(b, ["cx", "cy", "cz", *keys]).withColumn("sep", sep)
    joined = joined.where(F.col("sep") <= max_sep if inclusive else F.col("sep") < max_sep)
    side = lambda p, df: F.struct(*(F.col(f"{p}_{c}").alias(c) for c in df.columns)).alias(p)
    return joined.select(side("l", left), side("r", right), "sep")


def nearest_match(left, right, max_sep, left_id, right_id, inclusive=False, keys=()):
    """(left id, right id, sep): the nearest right row of each left row; ties go to the least id.

    Rows look within a share of ``max_sep`` first and go on to wider circles only while they
    have found nothing, so that dense tables are not joined over the whole of it.
    """
    from skycat.operators.training import written

    rest, found = left, None
    for share in SHARES:
        pairs = radius_join(rest, right, max_sep * share, inclusive or share < 1, keys)
        best = F.min(F.struct("sep", F.col(f"r.{right_id}").alias("rid")))
        near = pairs.groupBy(F.col(f"l.{left_id}").alias("left_id")).agg(best.alias("b")).select("left_id", F.col("b.rid").alias("right_id"), F.col("b.sep").alias("sep"))
        near = written(near, "nearest") if share < 1 else near
        found = near if found is None else found.union(near)
        rest = rest.join(near.select("left_id"), rest[left_id].eqNullSafe(near["left_id"]), "left_anti")
    return found


def match_split(left, right, max_sep, left_id, right_id):
    """(matches, unmatched left rows)."""
    matches = nearest_match(left, right, max_sep, left_id, right_id)
    return matches, left.join(matches, left[left_id] == matches.left_id, "left_anti")


def radius_pairs(df, max_sep, id_col, cross=None, keys=(), inclusive=False):
    """Unordered pairs (u, v, sep) with u < v, of different ``cross`` value if given."""
    pairs = radius_join(df, df, max_sep, inclusive, keys).where(F.col(f"l.{id_col}") < F.col(f"r.{id_col}"))
    if cross:
        pairs = pairs.where(F.col(f"l.{cross}") != F.col(f"r.{cross}"))
    return pairs.select(F.col(f"l.{id_col}").alias("u"), F.col(f"r.{id_col}").alias("v"), "sep")


def scored_match(known, det, known_id, det_id, max_sep=15.0, k=3.0, keys=(), by=()):
    """Best-scoring detection of each known object within max(max_sep, k re); ties go to the least id, of whatever type.

    ``keys`` are columns of both tables that must agree (a tile), ``by`` columns of the
    detections that are matched each by itself (a band): both join the result.  NULL,
    infinite and negative sizes count as none.  Objects are dealt to radius classes (powers
    of two), so that one huge radius does not widen the grid of all others.
    """
    radius = F.greatest(F.lit(float(max_sep)), F.when((F.col("re") > 0) & (F.col("re") < float("inf")), k * F.col("re")))
    sized = known.withColumn("radius", radius).withColumn("size_class", F.greatest(F.lit(0), F.ceil(F.log2(F.col("radius") / max_sep))).cast("int"))
    classes = [r[0] for r in sized.select("size_class").distinct().collect()]  # a handful of powers of two
    pairs = None
    for c in classes or [0]:
        part = radius_join(sized.where(F.col("size_class") == c), det, max_sep * 2**c, keys=tuple(keys)).where(F.col("sep") <= F.col("l.radius"))
        pairs = part if pairs is None else pairs.unionByName(part)
    one = ["known_id", *keys, *by]
    flat = pairs.select(F.col(f"l.{known_id}").alias("known_id"), *(F.col(f"r.{c}").alias(c) for c in (*keys, *by)), F.col("l.radius").alias("radius"), F.col(f"r.{det_id}").alias("det_id"), F.col("r.mu").alias("mu"), F.col("r.n_pix").alias("n_pix"), "sep")
    tops = flat.groupBy(*one).agg(F.max("mu").alias("top_mu"), F.max("n_pix").alias("top_pix"))
    score = 0.2 * F.col("mu") / F.col("top_mu") + 0.4 * F.log1p("n_pix") / F.log1p("top_pix") + 0.4 * (1 - F.col("sep") / F.col("radius"))
    score = F.round(score, 9)
    best = F.min(F.struct(score.isNull().alias("none"), (-score).alias("s"), "det_id", "sep"))
    return flat.join(tops, one).groupBy(*one).agg(best.alias("b")).select(*one, "b.det_id", (-F.col("b.s")).alias("score"), F.col("b.sep").alias("sep"))


def attach_redshift(det, zcat, det_id, z_id, max_sep=5.0, by=()):
    """Detections with the zspec of the nearest catalog row that chose them; a catalog row chooses one detection, or one for each ``by`` (a band)."""
    pairs = radius_join(zcat, det, max_sep, False)
    best = F.min(F.struct("sep", F.col(f"r.{det_id}").alias("d")))
    chosen = pairs.groupBy(F.col(f"l.{z_id}").alias("z"), *(F.col(f"r.{c}").alias(c) for c in by)).agg(best.alias("b"))
    near = chosen.groupBy("b.d").agg(F.min(F.struct("b.sep", "z")).alias("n")).select("d", F.col("n.z").alias("z"))
    values = near.join(zcat.select(F.col(z_id).alias("z"), "zspec"), "z").select("d", "zspec")
    return det.join(values, det[det_id] == F.col("d"), "left").drop("d")


def nearest_negatives(df, id_col, k=5, keys=("tile_x", "tile_y")):
    """Label 1 for lsb rows, 0 for the k nearest other rows of each within its tile, else NULL; only tiles with a positive.

    Each positive starts with a radius that holds some k rows at its tile's mean density and
    doubles it only while it is short of k, so a crowded tile is never joined whole.
    """
    from pyspark.sql.window import Window

    from skycat.operators.training import written

    keys, base, widest = list(keys), 4.0, 10  # arcseconds; 4 x 2^10 is wider than a tile
    size = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    start = F.ceil(F.log2(1800 * F.sqrt(k / (3.141592653589793 * F.col("_n"))) / base))
    positives = df.where("lsb = 1").select(*keys, F.col(id_col).alias("_id"), "ra", "dec").join(size, keys)
    rest = written(positives.select(*keys, "_id", "ra", "dec", F.least(F.lit(k), F.col("_n") - 1).alias("_want"), F.greatest(F.lit(0), F.least(start, F.lit(widest))).cast("int").alias("_class")).where("_want > 0"), "negatives")
    others, chosen = df.select(*keys, F.col(id_col).alias("_id"), "ra", "dec"), None
    for c in range(widest + 1):
        now = rest.where(F.col("_class") <= c)
        near = radius_join(now.select("_id", "ra", "dec", "_want", *keys), others, base * 2**c, keys=tuple(keys)).where(F.col("l._id") != F.col("r._id"))
        rank = Window.partitionBy("pid").orderBy("sep", "oid")
        near = near.select(F.col("l._id").alias("pid"), F.col("r._id").alias("oid"), F.col("l._want").alias("want"), "sep").withColumns({"rn": F.row_number().over(rank), "found": F.count(F.lit(1)).over(Window.partitionBy("pid"))})
        picks = written(near.where(f"rn <= want and (found >= want or {c} = {widest})").select("pid", "oid"), "negatives")
        chosen = picks if chosen is None else chosen.union(picks)
        rest = written(rest.join(picks.select(F.col("pid").alias("_id")).distinct(), "_id", "left_anti"), "negatives")
        if rest.isEmpty():
            break
    hit = chosen.select(F.col("oid").alias(id_col)).distinct().withColumn("hit", F.lit(1))
    tiles = positives.select(*keys).distinct()
    out = df.join(tiles, keys, "left_semi").join(hit, id_col, "left")
    return out.withColumn("label", F.when(F.col("lsb") == 1, 1).when(F.col("hit") == 1, 0)).drop("hit")
