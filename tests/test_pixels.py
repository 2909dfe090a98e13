"""Pixel operators on large cells, missing values and many images."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import rows

from skycat.operators import pixels
from skycat.plans import registry


def test_background_of_large_cells(spark):
    """The time grows with the values of a cell, not with their square."""
    px = spark.range(128 * 128).select((F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).alias("y"), ((F.col("id") * 7919) % 10007 / 100.0 + F.when(F.col("id") % 500 == 0, 5000.0).otherwise(0.0)).alias("value"), F.lit(None).cast("int").alias("segment_id"))
    start = time.monotonic()
    (got,) = pixels.grid_background(px, 128).collect()
    assert time.monotonic() - start < 40
    v = np.array([r.value for r in px.collect()])
    for _ in range(5):
        v = v[abs(v - np.median(v)) <= 3 * v.std()]
    assert (got["mean"], got["median"], got["std"]) == pytest.approx((v.mean(), np.median(v), v.std()))


def test_background_with_nan_and_empty_cells(spark):
    """NaN in a cell stays, and a cell without background takes that of its neighbour."""
    rows = [(x, y, float("nan") if x == y == 0 else 1.0 + x, 1 if x >= 2 and y >= 2 else None) for x in range(4) for y in range(4)]
    got = {(r.cx, r.cy): (r["mean"], r["median"], r["std"]) for r in pixels.grid_background(spark.createDataFrame(rows, "x int, y int, value double, segment_id int"), 2).collect()}
    assert np.isnan(got[0, 0][0]) and np.isnan(got[0, 0][2])
    assert got[0, 1] == got[0, 1] and got[0, 1] == (1.5, 1.5, 0.5)
    assert got[1, 1] == got[1, 0] == (3.5, 3.5, 0.5)


@pytest.mark.parametrize("name", ["light_curve_of_growth", "hot_pixels", "mask_hot_pixels", "cutouts", "fill_channel", "to_rgb"])
def test_tiles_of_four_digits_are_no_others(spark, tmp_path, name):
    """Tiles 100 and 1000 hold different images, and the queries equal their SQL on both."""
    con = duckdb.connect()
    con.execute(f"copy (select 15000 + i + 135000 * j as p_partkey from range(150) a(i), range(2) b(j)) to '{tmp_path}/part.parquet'")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    ours, theirs = registry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert set(ours.tile) == {"100_000", "1000_000"}
    assert rows(ours) == rows(theirs)


def _copies(spark, n, side=12):
    """An image of side x side pixels, n rows to a place, with a segment of three places."""
    places = spark.range(side * side * n).select((F.col("id") % side).cast("int").alias("x"), (F.floor(F.col("id") / side) % side).cast("int").alias("y"), F.floor(F.col("id") / (side * side)).cast("int").alias("copy"))
    return places.select("x", "y", (F.col("x") + 2.0 * F.col("y") + F.col("copy")).alias("value"), F.when((F.col("y") == 3) & F.col("x").between(3, 5), 1).alias("segment_id"))


def test_small_objects_keep_rows_of_shared_places(spark):
    """Several pixels of one place stay as many, and count once for the size of a region."""
    px = _copies(spark, 3)
    objects = px.where("segment_id is not null").groupBy("segment_id").agg(F.count("*").alias("npix")).selectExpr("segment_id", "npix", "1d as re", "0 as star")
    got = pixels.mask_small(px, objects, 6, small=10)
    assert got.count() == px.count()
    assert got.where("segment_id is not null").count() == 0


def test_stars_cover_a_shared_place_once(spark, monkeypatch):
    """What a star covers does not grow with the pixels of a place."""
    stars = spark.createDataFrame([(1, 4, 4, 15.0, 3.0, 2.0, 1.5), (2, 8, 8, 16.0, 3.0, 2.0, 1.5)], "source_id int, x int, y int, gmag double, r_iso double, spike double, thick double")
    counts, real = [], pixels._written

    def counted(*tables):
        out = real(*tables)
        counts.extend(t.count() for t in out)
        return out

    monkeypatch.setattr(pixels, "_written", counted)
    got = {}
    for n in (1, 4):
        counts.clear()
        assert pixels.mask_stars(_copies(spark, n), stars, 12.0, 6).count() == 144 * n
        got[n] = list(counts)
    assert got[1] == got[4]


def test_regions_across_blocks(spark):
    """Regions that cross the blocks of labelling, several rows to a place, against brute force."""
    draw = np.random.default_rng(3)
    lit = {(int(x), int(y)) for x, y in draw.integers(0, 80, (3800, 2))}
    mask = spark.createDataFrame(sorted(lit) * 2, "x int, y int")
    for diagonal in (False, True):
        steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not i or not j)]
        want, left = {}, set(lit)
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                p = todo.pop()
                seen.add(p)
                near = {(p[0] + i, p[1] + j) for i, j in steps} & left
                left -= near
                todo.extend(near)
            least = min(y * (1 << 20) + x for x, y in seen)
            want |= dict.fromkeys(seen, least)
        got = pixels.label_pixels(mask, diagonal).collect()
        assert len(got) == 2 * len(lit)
        assert {(r.x, r.y): r.component for r in got} == want


def test_convolve_of_shared_places(spark):
    """The sum over all pairs of pixels of neighbouring places, as the SQL has it; NULL values add nothing."""
    rows = [(0, 0, 1.0), (0, 0, 2.0), (1, 0, 4.0), (3, 0, float("nan")), (4, 0, 8.0)]
    px = spark.createDataFrame(rows, "x int, y int, value double")
    got = {r.x: r.value for r in pixels.convolve(px, {(1, 0): 0.5, (-1, 0): 0.25}).where("value is not null").collect()}
    assert got[0] == 2 * 4.0 * 0.25 and got[1] == 3.0 * 0.5 and got[3] == 8.0 * 0.25 and np.isnan(got[4])


def test_few_points_go_to_the_pixels(spark, monkeypatch):
    """Pixels do not move for few points; many points give the same by a shuffle."""
    from skycat.operators import selection

    px = _copies(spark, 2).withColumn("value", F.when(F.col("x") < 4, 0.0).otherwise(1.0))
    points = spark.createDataFrame([(1, 3, 3), (2, 8, 8), (3, 0, 0)], "id int, x int, y int")
    got = {}
    for few in (100, 0):
        monkeypatch.setattr(selection, "FEW_POINTS", few)
        out = selection.corrupted_at(points, px, "id", 2)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == bool(few)
        got[few] = sorted(map(tuple, out.collect()))
    assert got[100] == got[0] == [(1, 0.6, False), (2, 0.0, False), (3, 1.0, True)]


def test_quantiles_of_close_values_beside_one_far_away(spark, monkeypatch):
    """A far value leaves all others in one part of the range; they are sorted once they are few enough, in every way the same."""
    from skycat.operators import quantiles

    near = [5.0 + i * 1e-15 for i in range(50)] * 2
    groups = {"a": [*near, 1e6], "b": [3.0], "c": [1.0, 2.0, 4.0], "d": [7.0] * 60}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]] + [("none", None)], "k string, v double")
    writes, write = [], quantiles._written
    monkeypatch.setattr(quantiles, "_written", lambda d: writes.append(1) or write(d))
    wanted = {"low": 0.05, "mid": 0.5, "high": 0.99, "top": 1.0}
    for size in (1000, 20):
        writes.clear()
        bound = {} if size == 1000 else {"sorted_at_once": size}
        got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", wanted, 64, **bound).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            for name, q in wanted.items():
                assert abs(got[k][name] - np.quantile(vs, q)) <= 1e-15 * abs(np.quantile(vs, q))
        # groups of usual size need no round at all
        assert size == 20 or len(writes) == 1
    for rows, bound in ((df, 1000), (df, 20), (df.where("v is null"), 20)):
        every = [v for vs in groups.values() for v in vs] if rows is df else []
        got = quantiles.exact_quantiles(rows, [], "v", wanted, 64, bound).collect()
        assert len(got) == (1 if every else 0)
        assert all(abs(got[0][name] - np.quantile(every, q)) <= 1e-14 * abs(np.quantile(every, q)) for name, q in wanted.items() if every)
