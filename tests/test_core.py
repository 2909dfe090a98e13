"""Unit cases, edge rows and plan properties of the core operators."""

import pytest
from pyspark.sql import functions as F

from skycat.functions import photometry as ph
from skycat.functions import sphere, tiles
from skycat.functions.nulls import finite_rows, is_new_id, nan_to_null
from skycat.operators import components, match, training
from skycat.sources import tables


@pytest.mark.parametrize("points, want", [
    ([(10, 0), (20, 2), (30, 4)], (20, 2)), ([(359, 6), (1, 12), (0.5, 35)], (0.5, 12)), ([(170, -1), (175, 0), (190, 1)], (175, 0)),
    ([(10, -10), (200, 0), (210, 10)], (210, 0)), ([(123.4, -5.6)], (123.4, -5.6)),
])
def test_sky_median(spark, points, want):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in points], "g int, ra double, dec double")
    r = sphere.sky_median(df, ["g"]).first()
    assert (r.ra, r.dec) == pytest.approx(want)


@pytest.mark.parametrize("name, want", [
    ("calexp-CFIS_234_295.fits", (234, 295)), ("CFIS_LSB.234.295.r.fits", (234, 295)), ("PS-DR3.014.001.i.fits", (14, 1)),
    ("WISHES.9.99.z.fits", (9, 99)), ("calexp-CFIS_7_12.fits", (7, 12)), ("PSS.DR4.011.005.i.fits", (11, 5)),
])
def test_tile_names(spark, name, want):
    r = spark.createDataFrame([(name,)], "n string").select(tiles.parse_tile_name(F.col("n")).alias("t")).first().t
    assert (r.x, r.y) == want


def test_missing_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0), (4, None)], "i int, v double")
    assert [r.i for r in finite_rows(nan_to_null(df)).orderBy("i").collect()] == [1, 3, 4]
    ids = spark.createDataFrame([(None,), (" ",), ("None",), ("nan",), ("K1",)], "v string")
    assert [r[0] for r in ids.select(is_new_id(F.col("v"))).collect()] == [True] * 4 + [False]


@pytest.mark.parametrize("a, b", [((359.9999, 0.0), (0.0001, 0.0)), ((10.0, 89.9999), (190.0, 89.9999)), ((5.0, -89.9999), (185.0, -89.9999))])
def test_match_across_wrap_and_pole(spark, a, b):
    left = spark.createDataFrame([(1, *a)], "id int, ra double, dec double")
    right = spark.createDataFrame([(2, *b), (3, 50.0, 50.0)], "id int, ra double, dec double")
    got = match.nearest_match(left, right, 1.0, "id", "id").collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)] and got[0].sep == pytest.approx(0.72, abs=1e-6)


def test_tie_takes_least_id(spark):
    left = spark.createDataFrame([(1, 10.0, 0.0)], "id int, ra double, dec double")
    right = spark.createDataFrame([(9, 10.0, 0.0), (4, 10.0, 0.0)], "id int, ra double, dec double")
    assert match.nearest_match(left, right, 1.0, "id", "id").first().right_id == 4


def test_joins_are_hash_or_merge_joins(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") / 1000).alias("ra"), F.lit(0.0).alias("dec")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = match.radius_pairs(df, 10.0, "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    scan = df.where(F.col("ra").between(0.1, 0.2)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ra,0.1)" in scan


def test_long_chain_and_isolated_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges, spark.createDataFrame([(i,) for i in (0, 60, 99)], "n long")).collect()}
    assert got == {0: 0, 60: 0, 99: 99}
    assert components.connected_components(edges.limit(0), spark.createDataFrame([(5,)], "n long")).collect()[0].component == 5


def test_chunks_are_exact(spark):
    sizes = tables.exact_chunks(spark.range(23), "id", 5).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [5, 5, 5, 5, 3]


def test_round_trip_of_projection(spark):
    x, y = sphere.tan_project(F.lit(151.2), F.lit(31.1), F.lit(151.0), F.lit(31.0))
    ra, dec = sphere.tan_deproject(x, y, F.lit(151.0), F.lit(31.0))
    assert tuple(spark.range(1).select(ra, dec).first()) == pytest.approx((151.2, 31.1))


def test_zero_flux_drops_and_negative_flux_is_null(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, 10.0)], "i int, total_flux double").selectExpr("*", "1d as A", "1d as B", "2d as R_e")
    got = {r.i: r.mag for r in ph.photometry(df, 1.0, 30.0).collect()}
    assert got == {2: None, 3: pytest.approx(27.5)}


def test_exclusive_negatives(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.1, 0.0, 1.0), (3, 0.01, 0.0, None), (4, 0.02, 0.0, None), (5, 0.5, 0.0, None)]
    df = spark.createDataFrame(rows, "det_id long, ra double, dec double, lsb double").selectExpr("*", "1 as tile_x", "1 as tile_y")
    got = {tuple(r) for r in training.exclusive_negatives(df, 2).collect()}
    assert got == {(1, 3), (1, 4)}


def test_write_by_tile_replaces_only_its_tiles(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda *r: spark.createDataFrame([r], "tile_x int, tile_y int, v int")
    tables.write_by_tile(row(1, 1, 1).union(row(2, 2, 2)), path)
    tables.write_by_tile(row(2, 2, 5), path)
    assert {(r.tile_x, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 5)}


def test_exclusive_negatives_in_a_crowded_tile(spark):
    """More positives than negatives, in many batches, against the sequence; positives that find none are no work."""
    import random

    draw = random.Random(5)
    rows = [(i, draw.random() / 100, draw.random() / 100, 0, 0, 1.0 if i % 3 == 0 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "det_id long, ra double, dec double, tile_x int, tile_y int, lsb double")
    got = {tuple(r) for r in training.exclusive_negatives(df, 4).collect()}
    free, want = {r[0]: r for r in rows if r[5] is None}, set()
    for p in (r for r in rows if r[5]):
        picks = sorted(free.values(), key=lambda n: ((n[1] - p[1]) ** 2 + (n[2] - p[2]) ** 2, n[0]))[:4]
        free = {i: n for i, n in free.items() if n not in picks}
        want |= {(p[0], n[0]) for n in picks if len(picks) == 4}
    assert got == want


def test_nearest_match_in_steps(spark, monkeypatch):
    """Rows with a near partner are not joined over the whole separation; ties, borders and null ids stay as they were."""
    from skycat.operators import match

    left = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.0), (3, 30.0, 0.0), (None, 40.0, 0.0)], "a long, ra double, dec double")
    right = spark.createDataFrame([(9, 10.0, 1 / 3600), (8, 10.0, -1 / 3600), (7, 10.0, 30 / 3600), (6, 20.0, 39 / 3600), (4, 40.0, 2 / 3600)], "b long, ra double, dec double")
    sizes, real = [], match.radius_join

    def counted(*args, **kw):
        out = real(*args, **kw)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(match, "radius_join", counted)
    got = {r.left_id: (r.right_id, round(r.sep, 6)) for r in match.nearest_match(left, right, 40.0, "a", "b").collect()}
    assert got == {1: (8, 1.0), 2: (6, 39.0), None: (4, 2.0)}
    assert sizes == [3, 0, 1]  # the partner of 1 that lies 30 arcseconds away is never met


def _sequence(rows, k):
    """Rows (id, ra, dec, tile x, tile y, lsb) in id order, one positive after the other."""
    free, out = [r for r in rows if r[5] is None], set()
    for p in sorted(r for r in rows if r[5]):
        mine = [n for n in free if n[3:5] == p[3:5]]
        picks = sorted(mine, key=lambda n: ((n[1] - p[1]) * (n[1] - p[1]) + (n[2] - p[2]) * (n[2] - p[2]), n[0]))[:k]
        free = [n for n in free if n not in picks]
        out |= {(p[0], n[0]) for n in picks if len(picks) == k}
    return out


def test_exclusive_negatives_in_few_steps(spark, monkeypatch):
    """A tile that fits a block is one step, however long its chains of refusals; it was some rounds of every batch."""
    import random

    draw, steps, real = random.Random(7), [], training.written
    rows = [(i, draw.random() / 100, draw.random() / 100, i % 2, 0, 1.0 if i % 3 == 0 else None) for i in range(300)]
    monkeypatch.setattr(training, "written", lambda df, purpose: steps.append(purpose) or real(df, purpose))
    df = spark.createDataFrame(rows, "det_id long, ra double, dec double, tile_x int, tile_y int, lsb double")
    assert {tuple(r) for r in training.exclusive_negatives(df, 4).collect()} == _sequence(rows, 4)
    assert len(steps) <= 6


def test_exclusive_negatives_across_blocks(spark, monkeypatch):
    """Batches, borders of blocks, shared places, a line of points, and rows without a place or tile, against the sequence."""
    import random

    monkeypatch.setattr(training, "BLOCK", 20)
    draw = random.Random(11)
    places = [lambda: (draw.random() / 100, draw.random() / 100), lambda: (draw.randrange(9) / 9, draw.randrange(5) / 5), lambda: (1.0, draw.random()), lambda: (2.0, 3.0), lambda: (draw.random() ** 6, draw.random() ** 6)]
    rows = [(i, *places[i % 5](), i % 5, 0, 1.0 if draw.random() < 0.3 else None) for i in range(600)]
    odd = [(5001, None, 0.0, 0, 0, 1.0), (5002, 0.0, float("nan"), 0, 0, None), (5003, 0.0, 0.0, None, 0, None), (5004, 0.0, 0.0, None, 0, 1.0)]
    df = spark.createDataFrame(rows + odd, "det_id long, ra double, dec double, tile_x int, tile_y int, lsb double")
    got = [tuple(r) for r in training.exclusive_negatives(df, 3).collect()]
    assert set(got) == _sequence(rows, 3) and len(got) == len(set(got))
