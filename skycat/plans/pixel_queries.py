"""Queries over the pixel fixture, image by image, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycat.functions import photometry as ph
from skycat.operators import labels, pixels, quantiles, selection, training
from skycat.plans.fixtures import fixture
from skycat.plans.registry import query, r6

#: The image of a row, in SQL; the cell of the background queries.
IM, CELL = "tile, band", 20


def _x(spark, d):
    return fixture(spark, d, "X")


def _wide(spark, d):
    """X with one name for each tile, however many there are."""
    return fixture(spark, d, "WIDE")


@query("select tile, band, x, y, round(case when v>=65536 or v < -5 then 0e0 else v end,6) as value from (select tile, band, x, y, value*200e0-1010e0 as v from X)", ["X"])
def clean_pixels(spark, d):
    v = F.col("value") * 200.0 - 1010.0
    return _x(spark, d).select("tile", "band", "x", "y", r6(ph.clean_pixels(v)).alias("value"))


# --- segments --------------------------------------------------------------------------
_LIT = f", l0 as (select X.*, value - greatest(min(value) over (partition by {IM}, segment_id),0e0) as v from X where segment_id is not null), l as (select *, case when sum(v) over w = 0 then 1e0 else v end as w, row_number() over o - 1 as rk, sum(v) over o as cum, sum(v) over w as tot, max(v) over w as top from l0 window w as (partition by {IM}, segment_id), o as (partition by {IM}, segment_id order by v desc, y, x rows unbounded preceding))"
_RADII = ", ".join(f"round(sqrt(min(rk) filter (cum >= {q}e0*tot - 1e-9)/3.141592653589793e0),6) as {n}" for n, q in (("r_10", 0.1), ("r_25", 0.25), ("r_e", 0.5), ("r_75", 0.75), ("r_90", 0.9), ("r_100", 1.0)))


@query(
    _LIT + f", s as (select {IM}, segment_id, sum(v) as flux, count(*) as n_pix, max(v) as mu_max, avg(v) as mu_mean, median(v) as mu_median, sum(w*x)/sum(w) as cx, sum(w*y)/sum(w) as cy, sum(w*x*x)/sum(w) as xx, sum(w*y*y)/sum(w) as yy, sum(w*x*y)/sum(w) as xy, round(sqrt(count(*) filter (v >= top/2)/3.141592653589793e0),6) as r_fwhm, {_RADII} from l group by {IM}, segment_id), m as (select *, xx-cx*cx as c2, yy-cy*cy as d2, xy-cx*cy as e2 from s), t as (select *, case when c2=d2 then sign(e2)*pi()/2 else atan(2*e2/(c2-d2)) end as turn from m)"
    f" select {IM}, segment_id, round(flux,4) as flux, n_pix, round(mu_max,6) as mu_max, round(mu_mean,6) as mu_mean, round(mu_median,6) as mu_median, round(cx,6) as x, round(cy,6) as y, round(sqrt(greatest((c2+d2)/2+sqrt(power((c2-d2)/2,2)+e2*e2),0e0)),6) as a, round(sqrt(greatest((c2+d2)/2-sqrt(power((c2-d2)/2,2)+e2*e2),0e0)),6) as b, round(case when abs(e2) < 1e-7 then 0e0 when e2<0 and turn>0 then (turn-pi())/2 when turn<0 and e2>0 then (turn+pi())/2 else turn/2 end,4)+0e0 as theta, r_fwhm, r_10, r_25, r_e, r_75, r_90, r_100 from t",
    ["X"],
)
def segment_photometry(spark, d):
    out = pixels.segment_photometry(_x(spark, d))
    # the angle of a segment that is symmetric up to rounding says nothing
    even = F.abs((F.col("a") * F.col("a") - F.col("b") * F.col("b")) * F.sin(2 * F.col("theta"))) / 2 < 1e-7
    rounded = [r6(c).alias(c) for c in ("mu_max", "mu_mean", "mu_median", "x", "y", "a", "b", "r_fwhm", "r_10", "r_25", "r_e", "r_75", "r_90", "r_100")]
    return out.select("tile", "band", "segment_id", F.round("flux", 4).alias("flux"), "n_pix", (F.round(F.when(even, 0.0).otherwise(F.col("theta")), 4) + 0.0).alias("theta"), *rounded)


@query(f"select {IM}, segment_id, x, y, row_number() over w - 1 as rank, round(sum(value) over w,4) as cum from X where segment_id is not null window w as (partition by {IM}, segment_id order by value desc, y, x)", ["WIDE"])
def light_curve_of_growth(spark, d):
    return pixels.light_curve_of_growth(_wide(spark, d).where("segment_id is not null"), value="value").select("tile", "band", "segment_id", "x", "y", F.col("rank").cast("long").alias("rank"), F.round("cum", 4).alias("cum"))


@query(f"select {IM}, x, y, segment_id, cast(case when segment_id is not null then dense_rank() over (partition by {IM} order by segment_id) end as int) as new_id from X", ["X"])
def relabel_segments(spark, d):
    return pixels.relabel_segments(_x(spark, d)).select("tile", "band", "x", "y", "segment_id", "new_id")


@query(f"select {IM}, x, y, segment_id, round(case when segment_id is not null then min(value) over (partition by {IM}, segment_id) end,6) as level from X", ["X"])
def segment_level(spark, d):
    return pixels.segment_level(_x(spark, d)).withColumn("level", r6("level"))


@query(f"select {IM}, cast(floor(x/4) as int) as bx, cast(floor(y/4) as int) as by, round(avg(value),6) as value from X group by {IM},3,4 having count(*)=16", ["X"])
def rebin(spark, d):
    return pixels.rebin(_x(spark, d)).withColumn("value", r6("value"))


@query(f"select {IM}, round(avg(case when value=0 or y<30 then 1e0 else 0e0 end),6) as zero_share, avg(case when value=0 or y<30 then 1e0 else 0e0 end) > 0.75e0 as skip from X group by {IM}", ["X"])
def mostly_zero_tiles(spark, d):
    dark = _x(spark, d).withColumn("value", F.when(F.col("y") < 30, 0.0).otherwise(F.col("value")))
    return pixels.mostly_zero(dark, 0.75).withColumn("zero_share", r6("zero_share"))


@query(f"select {IM}, cast(floor(x/8) as int) as cx, cast(floor(y/8) as int) as cy, round(avg(case when value=0 then 1e0 else 0e0 end),6) as zero_share, avg(case when value=0 then 1e0 else 0e0 end) > 0.95e0 as skip from X group by {IM},3,4", ["X"])
def mostly_zero_cells(spark, d):
    return pixels.mostly_zero(_x(spark, d), cell=8).withColumn("zero_share", r6("zero_share"))


@query(f", b as (select {IM}, segment_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, count(*) as n from X where segment_id is not null group by {IM}, segment_id), p as (select {IM}, segment_id, x, y from (select *, row_number() over (partition by {IM}, segment_id order by value desc, y, x) as rn from X where segment_id is not null) where rn=1) select {IM}, segment_id, round(sqrt(power(x-round_even((x0+x1)/2e0,0),2)+power(y-round_even((y0+y1)/2e0,0),2)),6) as peak_offset, round(sqrt(power(x-round_even((x0+x1)/2e0,0),2)+power(y-round_even((y0+y1)/2e0,0),2))/n,9) as share from b join p using ({IM}, segment_id)", ["X"])
def peak_offset(spark, d):
    top = F.max(F.struct("value", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("p")
    s = _x(spark, d).where("segment_id is not null").groupBy("tile", "band", "segment_id").agg(top, F.count("*").alias("n"), *(f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in ((0, F.min), (1, F.max))))
    gap = ph.peak_offset(-F.col("p.x"), -F.col("p.y"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))
    return s.select("tile", "band", "segment_id", r6(gap).alias("peak_offset"), F.round(gap / F.col("n"), 9).alias("share"))


@query(f", s as (select {IM}, segment_id, var_samp(x*value) as a, var_samp(y) as b, covar_samp(x*value,y) as c from X where segment_id is not null group by {IM}, segment_id), e as (select {IM}, segment_id, (a+b)/2 as h, sqrt(power((a-b)/2,2)+c*c) as r from s) select {IM}, segment_id, round(sqrt(greatest(h-r,0e0)/(h+r)),6) as axis_ratio, round(sqrt(greatest(h-r,0e0)),6) as minor from e", ["X"])
def axis_ratio_pca(spark, d):
    px = _x(spark, d).where("segment_id is not null").withColumn("x", F.col("x") * F.col("value"))
    return training.axis_ratio_pca(px, ["tile", "band", "segment_id"]).select("tile", "band", "segment_id", r6("axis_ratio").alias("axis_ratio"), r6("minor").alias("minor"))


@query(f"select {IM}, round(quantile_cont(value, 0.05e0),6) as low, round(median(value),6) as mid, round(quantile_cont(value, 0.99e0),6) as high from X group by {IM}", ["X"])
def image_quantiles(spark, d):
    out = quantiles.exact_quantiles(_x(spark, d), ["tile", "band"], "value", {"low": 0.05, "mid": 0.5, "high": 0.99}, parts=64)
    return out.select("tile", "band", *(r6(c).alias(c) for c in ("low", "mid", "high")))


# --- masks and regions -----------------------------------------------------------------
_HAAR = f", q as (select {IM}, x//2 as bx, y//2 as \"by\", max(value) filter (x%2=0 and y%2=0) as a, max(value) filter (x%2=1 and y%2=0) as b, max(value) filter (x%2=0 and y%2=1) as c, max(value) filter (x%2=1 and y%2=1) as e from X group by {IM},3,4)"


@query(_HAAR + f" select {IM}, bx, \"by\", round((a-b+c-e)/2,6)+0e0 as h, round((a+b-c-e)/2,6)+0e0 as v, round((a-b-c+e)/2,6)+0e0 as dd from q", ["X"])
def haar_details(spark, d):
    return pixels.haar_details(_x(spark, d)).select("tile", "band", "bx", "by", r6("h").alias("h"), r6("v").alias("v"), r6("dd").alias("dd"))


@query(f"select distinct {IM}, x+i as x, y+j as y from X, (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) v(i,j) where segment_id is not null", ["X"])
def dilate(spark, d):
    return pixels.dilate(_x(spark, d).where("segment_id is not null").select("tile", "band", "x", "y"))


@query(f", m as (select {IM}, x, y from X where value > 60e0) select distinct {IM}, x+i as x, y+j as y from m, range(-9,10) a(i), range(-9,10) b(j) where abs(i)+abs(j) <= 9", ["X"])
def dilate_far(spark, d):
    return pixels.dilate(_x(spark, d).where("value > 60").select("tile", "band", "x", "y"), 9)


@query(f", m as (select {IM}, x, y from X where value > 60e0) select distinct {IM}, x+i as x, y+j as y from m, range(-5,6) a(i), range(-5,6) b(j)", ["X"])
def dilate_square(spark, d):
    return pixels.dilate(_x(spark, d).where("value > 60").select("tile", "band", "x", "y"), 5, square=True)


@query("select a.tile, a.band, a.x, a.y, round(sum(b.value*case when abs(a.x-b.x)+abs(a.y-b.y)=0 then 0.5e0 else 0.125e0 end),6) as value from X a, (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(i,j), X b where b.x=a.x+o.i and b.y=a.y+o.j and a.tile=b.tile and a.band=b.band group by 1,2,3,4", ["X"])
def convolve(spark, d):
    return pixels.convolve(_x(spark, d), {(0, 0): 0.5, (1, 0): 0.125, (-1, 0): 0.125, (0, 1): 0.125, (0, -1): 0.125}).withColumn("value", r6("value"))


def _regions(cells, keys, steps="(1,0),(-1,0),(0,1),(0,-1)"):
    """Connected regions of the CTE ``cells`` (x, y and key columns) as (keys, x, y, c)."""
    same = " and ".join(f"b.{k}=a.{k}" for k in keys.split(", "))
    back = " and ".join(f"r.{k}=e.{k}" for k in keys.split(", "))
    ekeys = ", ".join(f"e.{k}" for k in keys.split(", "))
    return f", t as (with recursive e as materialized (select a.x, a.y, {', '.join('a.' + k for k in keys.split(', '))}, b.x as x2, b.y as y2 from {cells} a, (values {steps}) o(i,j), {cells} b where b.x=a.x+o.i and b.y=a.y+o.j and {same}), r(x, y, {keys}, c) as (select x, y, {keys}, y*1048576+x from {cells} union select e.x2, e.y2, {ekeys}, r.c from r join e on r.x=e.x and r.y=e.y and {back}) select x, y, {keys}, min(c) as c from r group by all)"


_EIGHT = "(1,0),(-1,0),(0,1),(0,-1),(1,1),(-1,-1),(1,-1),(-1,1)"


@query(f", b as (select {IM}, x, y, value from X where value>20e0)" + _regions("b", IM, _EIGHT) + f" select {IM}, cast(c as bigint) as component, count(*) as npix, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax, round(max(value),6) as peak from t join b using ({IM}, x, y) group by {IM}, c having count(*)>=4", ["X"])
def threshold_segments(spark, d):
    return pixels.threshold_segments(_x(spark, d), 20.0).withColumn("peak", r6("peak"))


_FLAT = _HAAR + f", f as (select {IM}, bx as x, \"by\" as y, 'h' as p from q where abs(a-b+c-e)/2<=0.005e0 union all select {IM}, bx, \"by\", 'v' from q where abs(a+b-c-e)/2<=0.005e0 union all select {IM}, bx, \"by\", 'd' from q where abs(a-b-c+e)/2<=0.005e0)" + _regions("f", f"{IM}, p") + f", g as (select distinct {IM}, x, y from (select *, count(*) over (partition by {IM}, p, c) as n from t) where n>=10), fa as (select distinct {IM}, X.x, X.y from (select {IM}, 2*x+i+di as x, 2*y+j+dj as y from g, (values (0),(1)) a(i), (values (0),(1)) b(j), (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(di,dj)) s join X using ({IM}, x, y))"


@query(_FLAT + f" select {IM}, x, y from fa", ["X"])
def flat_anomalies(spark, d):
    return pixels.flat_anomalies(_x(spark, d), least=10)


@query(_FLAT + f" select {IM}, X.x, X.y, round(case when fa.x is null then value else 0e0 end,6) as value from X left join fa using ({IM}, x, y)", ["X"])
def mask_anomalies(spark, d):
    return pixels.mask_anomalies(_x(spark, d), least=10).select("tile", "band", "x", "y", r6("value").alias("value"))


def _hot(level, quiet):
    return f", f as (select {IM}, x, y from X where value>{level})" + _regions("f", IM) + f", s as (select {IM}, x, y, c from (select *, count(*) over (partition by {IM}, c) as n from t) where n<=3), o as (select distinct {IM}, c, x+i as x, y+j as y from s, (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j)), qu as ({quiet}), u as (select {IM}, o.c, X.value, q from o join X using ({IM}, x, y) join qu using ({IM}) where (o.tile, o.band, o.x, o.y) not in (select {IM}, x, y from s)), k as (select {IM}, c from u group by {IM}, c having avg(case when value<=q then 1e0 else 0e0 end)>=0.2e0), hp as (select s.* from s join k using ({IM}, c))"


@query(_hot("70e0", f"select distinct {IM}, 20e0 as q from X") + f" select {IM}, x, y from hp", ["WIDE"])
def hot_pixels(spark, d):
    return pixels.hot_pixels(_wide(spark, d), 70.0, 20.0).select("tile", "band", "x", "y")


@query(_hot("70e0", f"select {IM}, median(value)+3*stddev_pop(value) as q from X group by {IM}") + f", md as (select {IM}, median(value) as m from X group by {IM}) select {IM}, X.x, X.y, round(case when hp.x is null then value else m end,6) as value from X join md using ({IM}) left join hp using ({IM}, x, y)", ["WIDE"])
def mask_hot_pixels(spark, d):
    return pixels.mask_hot_pixels(_wide(spark, d), 70.0).select("tile", "band", "x", "y", r6("value").alias("value"))


# --- background and fills --------------------------------------------------------------
def _grid(table="X", rounds=5):
    """CTEs that clip a cell's values at three deviations from its median, and look for the nearest valid cell of the image."""
    cells = f"cast(floor(x/{CELL}e0) as int) as cx, cast(floor(y/{CELL}e0) as int) as cy"
    out = f", k0 as (select {IM}, {cells}, value from {table} where segment_id is null)"
    for i in range(rounds):
        out += f", s{i} as (select {IM}, cx, cy, median(value) as m, stddev_pop(value) as s from k{i} group by all), k{i + 1} as (select k{i}.* from k{i} join s{i} using ({IM}, cx, cy) where abs(value-m)<=3*s)"
    return out + (
        f", ce as (select {IM}, {cells}, count(*) as n, count(*) filter (segment_id is null) as dark from {table} group by all), fr as (select {IM}, floor((max(x)+1)/{CELL}e0) as nx, floor((max(y)+1)/{CELL}e0) as ny from {table} group by all), st as (select {IM}, cx, cy, avg(value) as mean, median(value) as median, stddev_pop(value) as std from k{rounds} group by all), al as (select {IM}, cx, cy, coalesce(dark>=0.5e0*n and mean is not null, false) as ok, mean, median, std from ce join fr using ({IM}) left join st using ({IM}, cx, cy) where cx<nx and cy<ny)"
        f", gb as (select a.tile, a.band, a.cx, a.cy, b.mean, b.median, b.std from al a left join al b on b.ok and a.tile=b.tile and a.band=b.band qualify row_number() over (partition by a.tile, a.band, a.cx, a.cy order by power(a.cx-b.cx,2)+power(a.cy-b.cy,2), b.cy, b.cx)=1), fl as (select {IM}, max(cx) as mx, max(cy) as my from gb group by all)"
    )


#: Joins the background of a pixel's cell to X.
_AT = f"join fl using ({IM}) join gb on gb.tile=X.tile and gb.band=X.band and gb.cx=least(cast(floor(X.x/{CELL}e0) as int),mx) and gb.cy=least(cast(floor(X.y/{CELL}e0) as int),my)"


def _noise_sql(seed):
    """The deviate of functions/noise.py for X.x and X.y."""

    def mixed(s):
        h = f"cast({s} as bigint)"
        for c in ("X.x", "X.y", "0", "0"):
            h = f"list_transform([({h}*1103515245 + {c}*12345 + 12345) % 2147483648], lambda h: xor(h, h >> 15))[1]"
        return f"({h} + 0.5e0)/2147483648e0"

    return f"sqrt(-2*ln({mixed(2 * seed)}))*cos(2*3.141592653589793e0*{mixed(2 * seed + 1)})"


@query(_grid() + f" select {IM}, cx, cy, round(mean,6) as mean, round(median,6) as median, round(std,6) as std from gb", ["X"])
def grid_background(spark, d):
    return pixels.grid_background(_x(spark, d), CELL).select("tile", "band", "cx", "cy", *(r6(c).alias(c) for c in ("mean", "median", "std")))


def _ring(least, grow):
    return f", f as (select {IM}, x, y from X where segment_id is not null)" + _regions("f", IM) + f", lg as (select * from (select {IM}, c, count(*) as n, var_samp(x) as a, var_samp(y) as b, covar_samp(x,y) as v from t group by all) where n>={least}), sq as (select {IM}, c, (a+b)/2 as h, sqrt(power((a-b)/2,2)+v*v) as r from lg), sk as (select {IM}, c from sq where sqrt(greatest(h-r,0e0)/(h+r))>=0.2e0), sm as (select t.* from t join sk using ({IM}, c)), dy as (select X.tile, X.band, X.x, X.y, min(abs(X.y-sm.y)) as g from X join sm on X.tile=sm.tile and X.band=sm.band and X.x=sm.x where abs(X.y-sm.y)<={grow} group by all), gr as (select distinct X.tile, X.band, X.x, X.y from X join dy on X.tile=dy.tile and X.band=dy.band and X.y=dy.y where abs(X.x-dy.x)+g<={grow}), rg as (select {IM}, x, y from gr join X using ({IM}, x, y) where segment_id is null)"


@query(_ring(100, 3) + f" select {IM}, x, y from rg", ["X"])
def ring_mask(spark, d):
    return pixels.ring_mask(_x(spark, d), 100, 0.2, 3)


_MARKED = f", mk as (select X.* replace (case when rg.x is not null then -1 else segment_id end as segment_id) from X left join rg using ({IM}, x, y))"


@query(_ring(190, 65) + _MARKED + _grid("mk") + f" select X.tile, X.band, X.x, X.y, round(case when rg.x is not null then coalesce(gb.median, X.value) else X.value end,6) as value from X {_AT} left join rg on rg.tile=X.tile and rg.band=X.band and rg.x=X.x and rg.y=X.y", ["X"])
def ring_correction(spark, d):
    return pixels.ring_correction(_x(spark, d), CELL, 190, 0.2, 65).select("tile", "band", "x", "y", r6("value").alias("value"))


@query(_ring(100, 3) + _MARKED + _grid("mk") + f" select X.tile, X.band, X.x, X.y, round(case when rg.x is not null then coalesce(gb.median + gb.std*{_noise_sql(5)}, X.value) else X.value end,6) as value from X {_AT} left join rg on rg.tile=X.tile and rg.band=X.band and rg.x=X.x and rg.y=X.y", ["X"])
def ring_correction_noise(spark, d):
    return pixels.ring_correction(_x(spark, d), CELL, 100, 0.2, 3, seed=5).select("tile", "band", "x", "y", r6("value").alias("value"))


_GONE = f", o as (select {IM}, segment_id, count(*) as npix from X where segment_id is not null group by all), m as (select {IM}, segment_id from o where segment_id % 5 <> 0 and npix >= 39 and npix < 150 and segment_id % 3 = 0), tn as (select {IM}, x, y, segment_id from X join o using ({IM}, segment_id) where segment_id % 5 <> 0 and npix < 39)" + _regions("tn", IM) + f", fw as (select {IM}, x, y from (select *, count(*) over (partition by {IM}, c) as n from t) where n < 39), px as (select {IM}, x, y from fw union select {IM}, x, y from X join m using ({IM}, segment_id)), go as (select {IM}, segment_id from fw join X using ({IM}, x, y) union select {IM}, segment_id from m)"


def _small(value):
    return _grid() + _GONE + f" select X.tile, X.band, X.x, X.y, round(case when px.x is not null then coalesce({value}, X.value) else X.value end,6) as value, case when go.segment_id is null then X.segment_id end as segment_id from X {_AT} left join px on px.tile=X.tile and px.band=X.band and px.x=X.x and px.y=X.y left join go on go.tile=X.tile and go.band=X.band and go.segment_id=X.segment_id"


def _mask_small(spark, d, **options):
    px = _x(spark, d)
    objects = px.where("segment_id is not null").groupBy("tile", "band", "segment_id").agg(F.count("*").alias("npix")).selectExpr("tile", "band", "segment_id", "npix", "case when segment_id % 3 = 0 then 1d else 2d end as re", "case when segment_id % 5 = 0 then 1 else 0 end as star")
    return pixels.mask_small(px, objects, CELL, medium=150, **options).select("tile", "band", "x", "y", r6("value").alias("value"), "segment_id")


@query(_small("gb.median"), ["X"])
def mask_small(spark, d):
    return _mask_small(spark, d)


@query(_small(f"gb.median + least(gb.std, 3e0)*{_noise_sql(3)}"), ["X"])
def mask_small_noise(spark, d):
    return _mask_small(spark, d, seed=3)


_SHAPE = f", sp as (select source_id, tile, x, y, gmag, gmag/5e0 as r_iso, gmag/3e0 as spike, 1.5e0 as thick from S), cov as (select p.tile, p.band, p.x, p.y, s.source_id, s.gmag>12 as faint from X p join sp s on p.tile=s.tile where p.x between s.x-8 and s.x+8 and p.y between s.y-8 and s.y+8 and (power(p.x-s.x,2)+power(p.y-s.y,2)<=power(greatest(round_even(0.9e0*r_iso,0),1),2) or (s.gmag>12 and ((abs(p.x-s.x)<=spike and abs(p.y-s.y)<=thick/2) or (abs(p.y-s.y)<=spike and abs(p.x-s.x)<=thick/2))))), sh as (select distinct {IM}, x, y from cov where not faint), op as (select {IM}, source_id from (select c.tile, c.band, c.source_id, sh.x is not null as hid from cov c left join sh using ({IM}, x, y) where c.faint) group by all having avg(case when hid then 1e0 else 0e0 end)<0.99e0), fi as (select distinct {IM}, x, y from cov join op using ({IM}, source_id) where faint and (cov.tile, cov.band, x, y) not in (select {IM}, x, y from sh))"


def _stars_sql(value):
    return _grid() + _SHAPE + f" select X.tile, X.band, X.x, X.y, round(case when fi.x is not null then {value} else X.value end,6) as value from X {_AT} left join fi on fi.tile=X.tile and fi.band=X.band and fi.x=X.x and fi.y=X.y"


def _mask_stars(spark, d, **options):
    stars = fixture(spark, d, "S").selectExpr("source_id", "tile", "x", "y", "gmag", "gmag/5d as r_iso", "gmag/3d as spike", "1.5d as thick")
    return pixels.mask_stars(_x(spark, d), stars, 12.0, CELL, **options).select("tile", "band", "x", "y", r6("value").alias("value"))


@query(_stars_sql("gb.median"), ["X", "S"])
def mask_stars(spark, d):
    return _mask_stars(spark, d)


@query(_stars_sql(f"gb.median + gb.std*{_noise_sql(7)}"), ["X", "S"])
def mask_stars_noise(spark, d):
    return _mask_stars(spark, d, seed=7)


# --- stars and points on images --------------------------------------------------------
@query(f"select tile, band, x, y, round(avg(case when v=0 then 1e0 else 0e0 end),6) as zero_share, avg(case when v=0 then 1e0 else 0e0 end) > 0.6e0 as corrupted from (select b.tile, b.band, p.x, p.y, b.value as v from (select distinct tile, x, y from X where x%40=5 and y%40=5) p join X b on p.tile=b.tile where b.x between p.x-3 and p.x+3 and b.y between p.y-3 and p.y+3) group by {IM}, x, y", ["X"])
def corrupted_at(spark, d):
    px = _x(spark, d)
    points = px.where("x % 40 = 5 and y % 40 = 5").select("tile", F.struct("x", "y").alias("at"), "x", "y").distinct()
    return selection.corrupted_at(points, px, "at", 3).select("tile", "band", "at.x", "at.y", r6("zero_share").alias("zero_share"), "corrupted")


@query(f", b as (select * from S where gmag<14), h as (select distinct X.tile, X.band, segment_id from X join b on X.tile=b.tile where segment_id is not null and X.x between b.x-6 and b.x+6 and X.y between b.y-6 and b.y+6 and power(X.x-b.x,2)+power(X.y-b.y,2)<=36), p as (select {IM}, segment_id, x, y from (select X.*, row_number() over (partition by {IM}, segment_id order by value desc, y, x) as rn from X join h using ({IM}, segment_id)) where rn=1) select tile, band, segment_id, source_id, gmag from (select p.tile, p.band, p.segment_id, b.source_id, b.gmag, row_number() over (partition by p.tile, p.band, p.segment_id order by power(p.x-b.x,2)+power(p.y-b.y,2), b.source_id) as rn from p join b on p.tile=b.tile) where rn=1", ["X", "S"])
def star_halo_flag(spark, d):
    return selection.star_halo_flag(fixture(spark, d, "S"), _x(spark, d), 6)


def _case_sql(bright):
    return (
        f", g as (select {IM}, x, y, case when segment_id is not null then segment_id*2+(case when x%40>=20 then 1 else 0 end) end as seg, value from X), a2 as (select g.tile, g.band, s.source_id, s.gmag, s.x, s.y, 3e0+s.source_id%7 as r, g.seg from S s join g on g.tile=s.tile and g.x=s.x and g.y=s.y), sh as (select {IM}, seg, sqrt(count(*)/3.141592653589793e0) as rs from g where seg is not null group by all)"
        ", bo as (select tile, band, own as seg, max(case when other is null then 1 else 0 end) as op, max(case when other is not null then 1 else 0 end) as touched from (select distinct s.tile, s.band, s.seg as own, t.x, t.y, t.seg as other from g s, (values (-1),(0),(1)) p(i), (values (-1),(0),(1)) q(j), g t where s.seg is not null and t.tile=s.tile and t.band=s.band and t.x=s.x+p.i and t.y=s.y+q.j) where other is null or other<>own group by all)"
        f", br as ({bright}), nr as (select distinct a2.tile, a2.band, a2.source_id from a2 join g using ({IM}) join br on br.tile=a2.tile and br.band=a2.band and br.seg=g.seg where a2.seg is not null and g.seg<>a2.seg and g.x between a2.x-12 and a2.x+12 and g.y between a2.y-12 and a2.y+12 and sqrt(power(g.x-a2.x,2)+power(g.y-a2.y,2))>a2.r and sqrt(power(g.x-a2.x,2)+power(g.y-a2.y,2))<=a2.r+1.5e0)"
        f" select a2.tile, a2.band, a2.source_id, case when a2.seg is null then 'undetected' when coalesce(touched,0)=0 then 'isolated' when rs>r and nr.source_id is null then 'not_deblended' when rs>r then 'adjacent' when op=1 then 'adjacent' else 'embedded' end as \"case\" from a2 left join sh using ({IM}, seg) left join bo using ({IM}, seg) left join nr using ({IM}, source_id)"
    )


def _halves(spark, d):
    """Every disc cut into two touching segments, and stars with a radius."""
    px = _x(spark, d).withColumn("segment_id", F.col("segment_id") * 2 + F.when(F.col("x") % 40 >= 20, 1).otherwise(0))
    return fixture(spark, d, "S").withColumn("r", 3.0 + F.col("source_id") % 7), px


@query(_case_sql(f"select distinct {IM}, seg from a2 where gmag<13.5e0 and seg is not null"), ["X", "S"])
def star_case(spark, d):
    return pixels.star_case(*_halves(spark, d))


@query(_case_sql(f"select {IM}, seg from a2 where gmag<13.5e0 and seg is not null union select {IM}, seg from g where seg % 3 = 0 and 9e0+seg < 13.5e0"), ["X", "S"])
def star_case_candidates(spark, d):
    stars, px = _halves(spark, d)
    objects = px.where("segment_id is not null").select("tile", "band", "segment_id").distinct().selectExpr("*", "case when segment_id % 3 = 0 then 1 else 0 end as star_cand", "9d + segment_id as gmag_closest")
    return pixels.star_case(stars, px, objects)


# --- cutouts ---------------------------------------------------------------------------
_OBJ = f", ob as (select {IM}, segment_id as object_id, cast(floor(avg(x)+0.5e0) as int) as cx, cast(floor(avg(y)+0.5e0) as int) as cy from X where segment_id is not null group by {IM}, segment_id), cu as (select ob.tile, ob.band, object_id, p.pos, X.value, X.segment_id from ob, range(64) p(pos) left join X on X.tile=ob.tile and X.band=ob.band and X.x=cx-4+p.pos%8 and X.y=cy-4+p.pos//8)"


def _objects(px):
    return px.where("segment_id is not null").groupBy("tile", "band", F.col("segment_id").alias("object_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(_OBJ + " select tile, band, object_id, pos, round(coalesce(value,0e0),6) as value, case when segment_id=object_id then 1 else 0 end as own, round(case when segment_id=object_id then value else 0e0 end,6) as alone from cu", ["WIDE"])
def cutouts(spark, d):
    px = _wide(spark, d)
    both = pixels.cutouts(_objects(px), px, mode="concatenate").join(pixels.cutouts(_objects(px), px, mode="multiply").withColumnRenamed("values", "alone"), ["tile", "band", "object_id"])
    rows = both.select("tile", "band", "object_id", F.posexplode(F.arrays_zip("values", "mask", "alone")))
    return rows.select("tile", "band", "object_id", F.col("pos").cast("long").alias("pos"), r6("col.values").alias("value"), F.col("col.mask").alias("own"), r6("col.alone").alias("alone"))


@query(", o2 as (select tile, segment_id as object_id, cast(floor(avg(x)+0.5e0) as int) as cx, cast(floor(avg(y)+0.5e0) as int) as cy from X where segment_id is not null and band='r' group by tile, segment_id), c2 as (select o2.tile, object_id, b.band, X.value from o2, (values ('r'),('g'),('i')) b(band), range(64) p(pos) left join X on X.tile=o2.tile and X.band=b.band and X.x=cx-4+p.pos%8 and X.y=cy-4+p.pos//8) select tile, object_id, band, count(*) as n, round(sum(coalesce(value,0e0)),4) as total from c2 group by 1,2,3", ["X"])
def cutout_roundtrip(spark, d):
    from skycat.operators.components import shared_folder
    from skycat.sources.tables import read_cutouts, write_cutouts

    px = _x(spark, d)
    path = shared_folder(spark, "cutouts")
    wanted = _objects(px.where("band = 'r'")).drop("band")
    # NaN pixels come back as zero
    write_cutouts(pixels.cutouts(wanted, px, bands=["r", "g", "i"]).withColumn("values", F.transform("values", lambda v: F.when(v == 0, float("nan")).otherwise(v))).withColumn("note", F.lit("x")), path)
    back = read_cutouts(spark, path, ["tile", "object_id", "band", "values"])
    return back.select("tile", "object_id", "band", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


def _channels(spark, d):
    cut = pixels.cutouts(_objects(_wide(spark, d)), _wide(spark, d))
    times = lambda n, lost: F.transform("values", lambda v: F.when(F.col("object_id") % 4 == lost, 0.0).otherwise(v * n))
    return cut.select("tile", "band", "object_id", times(1.0, 0).alias("r"), times(0.8, 1).alias("g"), times(0.5, 2).alias("b"))


_CH = _OBJ + ", ch as (select tile, band, object_id, pos, case when object_id%4=0 then 0e0 else v end as r, case when object_id%4=1 then 0e0 else v*0.8e0 end as g, case when object_id%4=2 then 0e0 else v*0.5e0 end as b from (select tile, band, object_id, pos, coalesce(value,0e0) as v from cu)), fc as (select tile, band, object_id, pos, case when object_id%4=0 then g else r end as r, case when object_id%4=0 then (g+b)/2 when object_id%4=1 then (r+b)/2 when object_id%4=2 then (r+g)/2 else g end as g, case when object_id%4=2 then g else b end as b from ch)"


@query(_CH + " select tile, band, object_id, pos, round(r,6) as r, round(g,6) as g, round(b,6) as b from fc", ["WIDE"])
def fill_channel(spark, d):
    r, g, b = pixels.fill_channel(F.col("r"), F.col("g"), F.col("b"))
    rows = _channels(spark, d).select("tile", "band", "object_id", r.alias("r"), g.alias("g"), b.alias("b")).select("tile", "band", "object_id", F.posexplode(F.arrays_zip("r", "g", "b")))
    return rows.select("tile", "band", "object_id", F.col("pos").cast("long").alias("pos"), *(r6(f"col.{c}").alias(c) for c in "rgb"))


@query(_CH + ", m as (select *, (r+g+b)/(case when object_id%4<3 then 2 else 3 end) as m from ch) select tile, band, object_id, pos, " + ", ".join(f"round(case when {c}=0 or m=0 then 0e0 else power(least(greatest({c}*0.1e0*asinh(7e0*m/125e0)/(asinh(0.7e0)*m),0e0),1e0),0.25e0) end,6) as {c}" for c in "rgb") + " from m", ["WIDE"])
def to_rgb(spark, d):
    out = pixels.to_rgb(F.col("r"), F.col("g"), F.col("b"))
    rows = _channels(spark, d).select("tile", "band", "object_id", *(c.alias(n) for n, c in zip("rgb", out))).select("tile", "band", "object_id", F.posexplode(F.arrays_zip("r", "g", "b")))
    return rows.select("tile", "band", "object_id", F.col("pos").cast("long").alias("pos"), *(r6(f"col.{c}").alias(c) for c in "rgb"))


@query("select tile, det_id, peak_x, npix from (select tile, (y % 40)*1000+segment_id as det_id, min(x) as peak_x, count(*) as npix from X where segment_id is not null group by 1,2) where det_id % 3 <> 0", ["X"])
def pick_cutouts(spark, d):
    rows = _x(spark, d).where("segment_id is not null").groupBy("tile", ((F.col("y") % 40) * 1000 + F.col("segment_id")).alias("det_id")).agg(F.min("x").alias("peak_x"), F.count("*").alias("npix"))
    return labels.pick_cutouts(rows.where("det_id % 3 <> 0").select("tile", "det_id", "peak_x"), rows.select("tile", "det_id", "npix"), ["tile", "det_id"])[0]
