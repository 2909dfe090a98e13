"""All queries of the library with their DuckDB oracles.

Computed doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skycat.functions import photometry as ph
from skycat.functions import sphere, tiles
from skycat.functions.nulls import finite_rows, is_new_id
from skycat.operators import catalog, components, jobs, match, metrics, rules, selection
from skycat.plans.fixtures import SEP, fixture, with_fixtures

QUERIES, ORACLES = {}, {}
BANDS = ("r", "g", "i")


def query(sql=None, uses=()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_fixtures(*uses, body=sql) if uses else sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def r6(c):
    """Rounded to six places; negative zero becomes zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- functions -------------------------------------------------------------------------
@query("select det_id, round(cos(radians(dec))*cos(radians(ra)),6)+0e0 as ux, round(cos(radians(dec))*sin(radians(ra)),6)+0e0 as uy, round(sin(radians(dec)),6)+0e0 as uz from D", ["D"])
def unit_vector(spark, d):
    x, y, z = sphere.unit_vector(F.col("ra"), F.col("dec"))
    return fixture(spark, d, "D").select("det_id", r6(x).alias("ux"), r6(y).alias("uy"), r6(z).alias("uz"))


@query("select a.det_id, round(" + SEP.format(a="a", b="b") + ",6) as sep from D a join D b on a.k=b.k and a.dup=b.dup and a.band='r' and b.band='g'", ["D"])
def ang_sep(spark, d):
    det = fixture(spark, d, "D")
    a, b = det.where("band='r'").alias("a"), det.where("band='g'").alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.dup") == F.col("b.dup"))).select("a.det_id", r6(sphere.ang_sep_arcsec(F.col("a.ra"), F.col("a.dec"), F.col("b.ra"), F.col("b.dec"))).alias("sep"))


@query("select det_id, cast(trunc(ra*2e0*cos(radians(dec))) as int) as tx, cast(trunc((dec+90e0)*2e0) as int) as ty from D", ["D"])
def radec_to_tile(spark, d):
    x, y = tiles.radec_to_tile(F.col("ra"), F.col("dec"))
    return fixture(spark, d, "D").select("det_id", x.alias("tx"), y.alias("ty"))


@query("select distinct tile_x, tile_y, tile_x+i as nx, tile_y+j as ny from D, (values (-1),(0),(1)) a(i), (values (-1),(0),(1)) b(j) where not (i=0 and j=0) and tile_x+i between 0 and 999 and tile_y+j between 0 and 999", ["D"])
def tile_neighbours(spark, d):
    return tiles.tile_neighbours(fixture(spark, d, "D").select("tile_x", "tile_y").distinct(), "tile_x", "tile_y")


@query("select distinct lpad(cast(tile_x as varchar),3,'0')||'_'||lpad(cast(tile_y as varchar),3,'0') as tile, tile_x as x, tile_y as y from D", ["D"])
def tile_key(spark, d):
    keyed = fixture(spark, d, "D").select(tiles.tile_key(F.col("tile_x"), F.col("tile_y")).alias("tile")).distinct()
    x, y = tiles.parse_tile_key(F.col("tile"))
    return keyed.select("tile", x.alias("x"), y.alias("y"))


@query("select distinct 'CFIS.'||lpad(cast(tile_x as varchar),3,'0')||'.'||lpad(cast(tile_y as varchar),3,'0')||'.r.fits' as name, tile_x as x, tile_y as y from D", ["D"])
def parse_tile_name(spark, d):
    named = fixture(spark, d, "D").select(tiles.tile_file_name(F.col("tile_x"), F.col("tile_y"), "CFIS", ".", ".r.fits").alias("name")).distinct()
    return named.withColumn("t", tiles.parse_tile_name(F.col("name"))).select("name", "t.x", "t.y")


@query("select id, case when bands like '[%' then bands like '%''r''%' and bands like '%''g''%' else contains(bands,'rg') end as has_rg from R", ["R"])
def bands_contain(spark, d):
    return fixture(spark, d, "R").select("id", tiles.bands_contain(F.col("bands"), ["r", "g"]).alias("has_rg"))


_C0 = "radians(ra-151e0) as da, radians(dec) as dr, radians(31e0) as d0"
_CC = "(sin(d0)*sin(dr)+cos(d0)*cos(dr)*cos(da))"


@query(f"select det_id, round(5000e0-degrees(cos(dr)*sin(da)/{_CC})/5.160234650248e-05,4)+0e0 as px, round(5000e0+degrees((cos(d0)*sin(dr)-sin(d0)*cos(dr)*cos(da))/{_CC})/5.160234650248e-05,4)+0e0 as py from (select det_id, {_C0} from D)", ["D"])
def tan_project(spark, d):
    x, y = sphere.tan_project(F.col("ra"), F.col("dec"), F.lit(151.0), F.lit(31.0))
    return fixture(spark, d, "D").select("det_id", (F.round(x, 4) + 0.0).alias("px"), (F.round(y, 4) + 0.0).alias("py"))


@query("select det_id, round(total_flux*power(10e0,-1.2e0),6) as flux from D", ["D"])
def rescale_flux(spark, d):
    return fixture(spark, d, "D").select("det_id", r6(ph.rescale_flux(F.col("total_flux"), 30, 27)).alias("flux"))


@query("select source_id, round(sqrt(greatest(0e0,(case when gmag<9.49e0 then 7.21366775e5 else 8.26137977e5 end)*exp(-0.613780414e0*(gmag-6.1368e0))+126.614049e0)/3.141592653589793e0),6) as r_iso, round(greatest(0e0,(case when gmag<15.29e0 then 1363.06644e0 else 1090.29943e0 end)*exp(-0.345428885e0*(gmag-6.1368e0))+3.30158864e0),6) as spike, round(greatest(0e0,case when gmag<=15.6e0 then 1.5e0-0.5e0*(gmag-15.6e0) else 1.5e0-0.05e0*(gmag-15.6e0) end),6) as thick from S", ["S"])
def star_model(spark, d):
    a, b, c = ph.star_model(F.col("gmag"))
    return fixture(spark, d, "S").select("source_id", r6(a).alias("r_iso"), r6(b).alias("spike"), r6(c).alias("thick"))


@query("select det_id, round(ln(r_90/r_75),6)+0e0 as ln_ratio, round(mu/r_75,6) as ratio from D", ["D"])
def ratio_features(spark, d):
    return fixture(spark, d, "D").select("det_id", r6(ph.ratio_feature(F.col("r_90"), F.col("r_75"), True)).alias("ln_ratio"), r6(ph.ratio_feature(F.col("mu"), F.col("r_75"))).alias("ratio"))


@query("select det_id, round(greatest(0.6155e0*mag-11e0,0e0),6) as lin, round(0.1e0*mag*mag-2e0*mag+3e0,6)+0e0 as quad, round(0.01e0*mag*mag*mag+0.1e0*mag*mag-2e0*mag+3e0,6)+0e0 as cub, round(2e0*exp(-0.1e0*mag)+1e0,6) as ex from D", ["D"])
def separator_eval(spark, d):
    m = F.col("mag")
    s = ph.separator_value
    return fixture(spark, d, "D").select("det_id", r6(s("linear", m, (0.6155, -11.0))).alias("lin"), r6(s("quadratic", m, (0.1, -2.0, 3.0))).alias("quad"), r6(s("cubic", m, (0.01, 0.1, -2.0, 3.0))).alias("cub"), r6(s("exponential", m, (2.0, -0.1, 1.0))).alias("ex"))


@query("select det_id, coalesce(lower(trim(id_known)),'') in ('','none','nan') as is_new from D", ["D"])
def is_new_id_flag(spark, d):
    return fixture(spark, d, "D").select("det_id", is_new_id(F.col("id_known")).alias("is_new"))


@query("select det_id, round(-2.5e0*log10(total_flux)+30e0,6) as mag, round(-2.5e0*log10(total_flux)+30e0+0.752e0+2.5e0*log10(3.141592653589793e0*re_arcsec*re_arcsec*axis_ratio),6) as mu, round(axis_ratio,6) as axis_ratio from D", ["D"])
def photometry(spark, d):
    raw = fixture(spark, d, "D").select("det_id", "total_flux", F.col("re_arcsec").alias("R_e"), F.lit(1.0).alias("A"), F.col("axis_ratio").alias("B"))
    return finite_rows(ph.photometry(raw, 1.0, 30.0)).select("det_id", r6("mag").alias("mag"), r6("mu").alias("mu"), r6("axis_ratio").alias("axis_ratio"))


@query("select tile_x, tile_y, round(median(ra),6) as ra, round(median(dec),6) as dec from D group by tile_x, tile_y", ["D"])
def sky_median_per_tile(spark, d):
    return sphere.sky_median(fixture(spark, d, "D"), ["tile_x", "tile_y"]).select("tile_x", "tile_y", r6("ra").alias("ra"), r6("dec").alias("dec"))


# --- filters ---------------------------------------------------------------------------
_FIRST_PASS = "mu>22e0 and re_arcsec>1.6e0 and re_arcsec < (case when band='i' then 46e0 else 55e0 end) and (axis_ratio>=0.17e0 or n_pix<=1000)"


@query(f"select det_id from D where {_FIRST_PASS}", ["D"])
def first_pass_cuts(spark, d):
    return rules.first_pass_cuts(fixture(spark, d, "D")).select("det_id")


#: The extended relations written out by hand.
_EXTENDED = """(
 (band='r' and mu > 0.606e0*mag+11.6293e0 and mu_max < 1.2e10*exp(0.84e0*mag) and r_90 < 12*r_10+20 and r_90 < 3*re_arcsec+9 and mu_median < 4*re_arcsec+4 and mu_median < 4*r_10+12 and mu_median < 0.3e0*r_90+15 and mu_max < 120*r_90+650)
 or (band='g' and mu > 0.6981e0*mag+8.7072e0 and mu_max < 500-20*mag and r_90 > 4.3025e0*r_10-1.5e0 and r_90 < 1.9e0*re_arcsec+3.5e0 and mu_median < 0.15e0*re_arcsec+3.3e0 and mu_median < 3*r_10+1 and mu_median < 0.08e0*r_90+3.5e0 and mu_max < 14*r_90+20)
 or (band='i' and mu > 0.5864e0*mag+11.9705e0 and mu_max < 5593.3712e0/(1+exp(0.9174e0*(mag-16.193e0)))+200 and r_90 < 12*r_10+3 and r_90 < 3*re_arcsec+3.8e0 and mu_median < 2*re_arcsec+8 and mu_median < 4*r_10+12 and mu_median < 4*r_90+9.5e0 and mu_max < 35*r_90+100 and r_25 < 2.5e0*r_10+1))"""


@query(f"select det_id, band from D where {_FIRST_PASS} and {_EXTENDED}", ["D"])
def first_pass_extended(spark, d):
    return rules.first_pass_extended(fixture(spark, d, "D")).select("det_id", "band")


#: The rule sets written out by hand, so that a slip in operators/rules.py shows.
_ALL_RULES = """(
 (band='r' and mu>22 and re_arcsec>1.6 and re_arcsec<55 and axis_ratio>0.17 and r_10>0.353 and r_10<18.2 and r_25>0.4 and r_25<32.1 and r_75>2.16 and r_75<102.1 and r_90>2.5 and r_90<145.1
  and r_100>2.8 and r_100<254.1 and r_fwhm>0.4 and r_fwhm<13.8 and mu_median>0.34 and mu_median<28.7 and mu_mean>0.4 and mu_mean<65.1 and mu_max>2 and mu_max<6255 and total_flux>55 and mag>12.17 and mag<25.7
  and mu>0.6155e0*mag+11.3832e0 and mu>1.35e0*mag-6.4e0 and mu/r_75<greatest(1.51e0*mag-24.6e0,3e0) and ln(r_90/r_75)<0.295e0*ln(r_100)-0.13e0)
 or (band='g' and mu>22.51 and re_arcsec>1.6 and axis_ratio>0.17 and r_10>0.4 and r_10<8.1 and r_25>0.72 and r_25<15 and r_75>2.17 and r_75<42 and r_90>2.47 and r_90<54 and r_100>2.8 and r_100<79
  and r_fwhm>0.417 and r_fwhm<13.5 and mu_median>0.0072 and mu_median<0.8 and mu_mean>0.017 and mu_mean<2.01 and mu_max>0.066 and mu_max<226 and total_flux>1.77 and mag>16 and mag<26.5
  and mu>0.7063e0*mag+9.442e0 and mu>4.1e0*mag-78e0 and ln(r_100/r_90)<-1.2615e0*ln(mag)+4.3e0 and ln(mag/r_75)<greatest(6.45e0*ln(mag)-17.9e0,0.75e0))
 or (band='i' and mu>22 and mu<29.5 and re_arcsec>1.6 and re_arcsec<40 and axis_ratio>0.17 and r_10>0.4 and r_10<14.95 and r_25>0.58 and r_25<25.5 and r_75>2.1 and r_75<58 and r_90>2.5 and r_90<77
  and r_100>2.7 and r_100<117 and r_fwhm>0.4 and r_fwhm<20.8 and mu_median>0.445 and mu_median<40.7 and mu_mean>0.565 and mu_mean<100.8 and mu_max>2.47 and mu_max<4465 and total_flux>66 and mag>13.1 and mag<26
  and r_90/r_75<0.01e0*r_100+1.4e0 and r_100/r_90<-0.085e0*mag+3.3e0 and mag/r_75<greatest(1.4e0*mag-23e0,2.5e0) and r_90/r_75<-0.07e0*mag+2.97e0 and r_75/r_25<0.2e0*mag+1e0 and r_75/r_25<-1.1e0*mag+30.5e0
  and ln(r_100/r_75)<-2.7e0*ln(mag)+9.05e0 and ln(r_75/r_25)<0.8e0*ln(mag)-0.81e0))"""


@query(f"select det_id, band from D where {_ALL_RULES}", ["D"])
def band_rules(spark, d):
    return rules.band_rules(fixture(spark, d, "D")).select("det_id", "band")


@query(f"select det_id, band from D where ({_ALL_RULES}) or coalesce(lsb,0)=1", ["D"])
def filter_keep_known(spark, d):
    return rules.filter_keep_known(fixture(spark, d, "D")).select("det_id", "band")


@query(f"select band, cast(count(*) filter (not ({_ALL_RULES}) and coalesce(lsb,0)=1) as bigint) as removed_known, cast(count(*) filter (not ({_ALL_RULES}) and coalesce(lsb,0)<>1) as bigint) as removed_other from D group by band", ["D"])
def filter_audit(spark, d):
    return rules.filter_audit(fixture(spark, d, "D"))


@query("select source_id, gmag from S where not in_galaxy_candidates and gmag < 20.6e0 and x>0 and x<120 and y>0", ["S"])
def clean_stars(spark, d):
    return selection.clean_stars(fixture(spark, d, "S"), frame=(120, 1 << 30)).select("source_id", "gmag")


@query("select det_id, ra, dec from D where ra between 150.5e0 and 151e0 and dec between 30.5e0 and 31e0", ["D"])
def box_scan(spark, d):
    return selection.box_scan(fixture(spark, d, "D"), (150.5, 151.0), (30.5, 31.0), ["det_id", "ra", "dec"])


# --- joins -----------------------------------------------------------------------------
@query(", pairs as (select a.det_id as left_id, b.det_id as rid, " + SEP.format(a="a", b="b") + " as sep from D a, D b where a.band='r' and b.band='g' and abs(a.dec-b.dec)<0.003e0) select left_id, rid as right_id, round(sep,6) as sep from (select *, row_number() over (partition by left_id order by sep, rid) as rn from pairs where sep<10e0) where rn=1", ["D"])
def nearest_match(spark, d):
    det = fixture(spark, d, "D").select("det_id", "band", "ra", "dec")
    return match.nearest_match(det.where("band='r'"), det.where("band='g'"), 10.0, "det_id", "det_id").select("left_id", "right_id", r6("sep").alias("sep"))


@query(", m as (select distinct a.det_id from D a, D b where a.band='r' and b.band='g' and abs(a.dec-b.dec)<0.003e0 and " + SEP.format(a="a", b="b") + "<10e0) select det_id from D where band='r' and det_id not in (select det_id from m)", ["D"])
def match_split(spark, d):
    det = fixture(spark, d, "D").select("det_id", "band", "ra", "dec")
    return match.match_split(det.where("band='r'"), det.where("band='g'"), 10.0, "det_id", "det_id")[1].select("det_id")


_PAIRS = "select a.det_id as u, b.det_id as v, " + SEP.format(a="a", b="b") + " as sep from D a, D b where a.det_id<b.det_id and a.band<>b.band and abs(a.dec-b.dec)<0.003e0 and " + SEP.format(a="a", b="b") + "<10e0"


@query(f"select u, v, round(sep,6) as sep from ({_PAIRS})", ["D"])
def radius_pairs(spark, d):
    return match.radius_pairs(fixture(spark, d, "D").select("det_id", "band", "ra", "dec"), 10.0, "det_id", "band").select("u", "v", r6("sep").alias("sep"))


_COMP = f", e as (select u, v from ({_PAIRS})), b as (select u, v from e union select v, u from e), t as (with recursive r(node, c) as (select det_id, det_id from D union select b.v, r.c from r join b on r.node=b.u) select node, min(c) as component from r group by node)"


@query(_COMP + " select node, component from t", ["D"])
def connected_components(spark, d):
    det = fixture(spark, d, "D").select("det_id", "band", "ra", "dec")
    return components.connected_components(match.radius_pairs(det, 10.0, "det_id", "band").select("u", "v"), det.select("det_id"))


@query(", pairs as (select k.id as known_id, d.band, greatest(15e0, coalesce(3e0*k.re,0e0)) as radius, d.det_id, d.mu, d.n_pix, " + SEP.format(a="k", b="d") + " as sep from R k, D d where abs(k.dec-d.dec)<0.02e0), c as (select *, max(mu) over (partition by known_id, band) as tm, max(n_pix) over (partition by known_id, band) as tp from pairs where sep<=radius), s as (select known_id, band, det_id, sep, round(0.2e0*mu/tm+0.4e0*ln(1e0+n_pix)/ln(1e0+tp)+0.4e0*(1e0-sep/radius),9) as score from c) select known_id, band, det_id, round(score,6) as score, round(sep,6) as sep from (select *, row_number() over (partition by known_id, band order by score desc, det_id) as rn from s) where rn=1", ["R", "D"])
def scored_match(spark, d):
    out = match.scored_match(fixture(spark, d, "R"), fixture(spark, d, "D"), "id", "det_id", by=("band",))
    return out.select("known_id", "band", "det_id", r6("score").alias("score"), r6("sep").alias("sep"))


@query(", pairs as (select a.det_id as pid, b.det_id, row_number() over (partition by a.det_id order by " + SEP.format(a="a", b="b") + ", b.det_id) as rn from D a join D b on a.tile_x=b.tile_x and a.tile_y=b.tile_y and a.det_id<>b.det_id where a.lsb=1), h as (select distinct det_id from pairs where rn<=5), t as (select distinct tile_x, tile_y from D where lsb=1) select D.det_id, case when lsb=1 then 1 when h.det_id is not null then 0 end as label from D join t using (tile_x, tile_y) left join h on D.det_id=h.det_id", ["D"])
def nearest_negatives(spark, d):
    return match.nearest_negatives(fixture(spark, d, "D"), "det_id").select("det_id", "label")


@query("select det_id, zspec from (select d.det_id, z.zspec, row_number() over (partition by d.det_id order by z.sep) as rn from D d left join (select rid, zspec, sep from (select r.id, d2.det_id as rid, r.ra/1000e0 as zspec, " + SEP.format(a="r", b="d2") + " as sep, row_number() over (partition by r.id order by " + SEP.format(a="r", b="d2") + ", d2.det_id) as k from R r, D d2 where abs(r.dec-d2.dec)<0.003e0 and " + SEP.format(a="r", b="d2") + "<5e0) where k=1) z on z.rid=d.det_id) where rn=1", ["R", "D"])
def attach_redshift(spark, d):
    z = fixture(spark, d, "R").select("id", "ra", "dec", (F.col("ra") / 1000.0).alias("zspec"))
    return match.attach_redshift(fixture(spark, d, "D"), z, "det_id", "id").select("det_id", "zspec")


_FOF = ", q as (select det_id, band, ra, dec, mag, re_arcsec, tile_x, tile_y from D), e as (select a.det_id as u, b.det_id as v from q a, q b where a.det_id<>b.det_id and a.band=b.band and abs(a.dec-b.dec)<0.003e0 and " + SEP.format(a="a", b="b") + "<={lim}), t as (with recursive r(node, c) as (select det_id, det_id from q union select e.v, r.c from r join e on r.node=e.u) select node, min(c) as component from r group by node)"
_BEST = " select det_id, component from (select q.det_id, component, row_number() over (partition by component order by mag desc, q.det_id) as rn from q join t on q.det_id=t.node) where rn=1"


@query(_FOF.format(lim="10e0") + _BEST, ["D"])
def fof_dedup(spark, d):
    return catalog.fof_dedup(fixture(spark, d, "D").select("det_id", "band", "ra", "dec", "mag"), 10.0, "det_id", "mag", keys=("band",)).select("det_id", "component")


@query(_FOF.format(lim="greatest(1e0,1.5e0*greatest(a.re_arcsec,b.re_arcsec))") + _BEST, ["D"])
def radius_dedup(spark, d):
    return catalog.radius_dedup(fixture(spark, d, "D").select("det_id", "band", "ra", "dec", "mag", "re_arcsec"), "det_id", "mag", keys=("band",)).select("det_id", "component")


# --- jobs ------------------------------------------------------------------------------
_LOG = ", log as (select tile, band, seq, status, minutes, ts from (select *, row_number() over (partition by tile, band order by seq desc) as rn from J) where rn=1)"
_AV = ", av as (select distinct tile, band from J where seq % 5 <> 0)"


@query(_LOG + " select tile, band, seq, status, minutes, ts from log", ["J"])
def upsert_jobs(spark, d):
    return jobs.upsert_jobs(fixture(spark, d, "J"))


@query("select tile, max(case when band='r' then 1 else 0 end) as r, max(case when band='g' then 1 else 0 end) as g, max(case when band='i' then 1 else 0 end) as i from J where seq % 7 <> 0 group by tile", ["J"])
def availability(spark, d):
    return jobs.availability(fixture(spark, d, "J").where("seq % 7 <> 0"), BANDS)


_MX = ", mx as (select tile_x*1000+tile_y as tile, max(case when band='r' then 1 else 0 end) as r, max(case when band='g' then 1 else 0 end) as g, max(case when band='i' then 1 else 0 end) as i from D group by 1)"


def _matrix(spark, d):
    return jobs.availability(fixture(spark, d, "D").withColumn("tile", F.col("tile_x") * 1000 + F.col("tile_y")), BANDS)


@query(_MX + " select n_bands, cast(coalesce(sum(case when r+g+i=n_bands then 1 end),0) as bigint) as exact, cast(coalesce(sum(case when r+g+i>=n_bands then 1 end),0) as bigint) as at_least from (values (1),(2),(3)) v(n_bands), mx group by n_bands", ["D"])
def availability_counts(spark, d):
    return jobs.availability_counts(_matrix(spark, d), BANDS)


@query(_MX + " select 'r' as combo, cast(sum(r) as bigint) as tiles from mx union all select 'g', cast(sum(g) as bigint) from mx union all select 'i', cast(sum(i) as bigint) from mx union all select 'r+g', cast(sum(r*g) as bigint) from mx union all select 'r+i', cast(sum(r*i) as bigint) from mx union all select 'g+i', cast(sum(g*i) as bigint) from mx union all select 'r+g+i', cast(sum(r*g*i) as bigint) from mx", ["D"])
def availability_combos(spark, d):
    return jobs.availability_combos(_matrix(spark, d), BANDS)


@query(_LOG + _AV + " select band, available, completed, failed, processing, downloaded, skipped_mostly_zeros, cast(0 as bigint) as downloading, cast(0 as bigint) as download_failed, greatest(0, available-completed-skipped_mostly_zeros-failed) as remaining from (select band, count(distinct tile) as available from av group by band) join (select band, count(*) filter (status='completed') as completed, count(*) filter (status='failed') as failed, count(*) filter (status='processing') as processing, count(*) filter (status='downloaded') as downloaded, count(*) filter (status='skipped_mostly_zeros') as skipped_mostly_zeros from log group by band) using (band)", ["J"])
def progress_summary(spark, d):
    j = fixture(spark, d, "J")
    return jobs.progress_summary(jobs.upsert_jobs(j), j.where("seq % 5 <> 0"))


@query(_LOG + _AV + " select tile, band from av where (tile, band) not in (select tile, band from log where status in ('completed','skipped_mostly_zeros'))", ["J"])
def pending_jobs(spark, d):
    j = fixture(spark, d, "J")
    return jobs.pending_jobs(j.where("seq % 5 <> 0"), jobs.upsert_jobs(j))


@query("select band, count(*) as jobs, round(avg(case when status='completed' then minutes end),6) as mean_minutes, count(*) filter (status='failed') as failed from J group by band", ["J"])
def run_report(spark, d):
    return jobs.run_report(fixture(spark, d, "J")).withColumn("mean_minutes", r6("mean_minutes"))


@query("select tile, max(s) as complete_at from (select tile, band, min(seq) as s from J group by tile, band) group by tile having count(*)=3", ["J"])
def band_barrier(spark, d):
    return jobs.band_barrier(fixture(spark, d, "J"), BANDS)


@query("select time_bucket(interval '1 hour', ts) as bucket, max(value) as peak, round(avg(value),6) as mean, round(stddev_pop(value),6) as std, count(*) as n from events group by 1")
def resource_windows(spark, d):
    return jobs.resource_windows(_t(spark, d, "events")).select("bucket", "peak", r6("mean").alias("mean"), r6("std").alias("std"), "n")


# --- metrics ---------------------------------------------------------------------------
@query(", c as (select count(*) filter (p>=0.5e0 and y=1) as tp, count(*) filter (p>=0.5e0 and y=0) as fp, count(*) filter (p<0.5e0 and y=0) as tn, count(*) filter (p<0.5e0 and y=1) as fn from P) select tp, fp, tn, fn, round((tp+tn)/(tp+tn+fp+fn),6) as accuracy, round(tp/(tp+fp),6) as \"precision\", round(tp/(tp+fn),6) as recall, round(tn/(tn+fp),6) as specificity, round(2*tp/(2*tp+fp+fn),6) as f1, round((tp/(tp+fn)+tn/(tn+fp))/2,6) as balanced_accuracy from c", ["P"])
def binary_metrics(spark, d):
    out = metrics.binary_metrics(fixture(spark, d, "P"))
    return out.select(*out.columns[:4], *(r6(c).alias(c) for c in out.columns[4:]))


@query(", s as (select p, count(*) filter (y=1) as pos, count(*) filter (y=0) as neg from P group by p), c as (select *, sum(pos) over (order by p desc) as tp from s) select round(sum(neg*(tp-pos/2))/(sum(pos)*sum(neg)),6) as roc_auc from c", ["P"])
def roc_auc(spark, d):
    return metrics.roc_auc(fixture(spark, d, "P")).select(r6("roc_auc").alias("roc_auc"))


@query(", s as (select p, count(*) filter (y=1) as pos, count(*) as n from P group by p), c as (select *, sum(pos) over (order by p desc) as tp, sum(n) over (order by p desc) as a from s) select round(sum(pos*tp/a)/sum(pos),6) as average_precision from c", ["P"])
def average_precision(spark, d):
    return metrics.average_precision(fixture(spark, d, "P")).select(r6("average_precision").alias("average_precision"))


_CAL = "select cast(least(floor(p*10),9) as int) as bin, count(*) as n, avg(p) as mean_p, avg(y) as mean_y from P group by 1"


@query(f"select bin, n, round(mean_p,6) as mean_p, round(mean_y,6) as mean_y from ({_CAL})", ["P"])
def calibration(spark, d):
    return metrics.calibration(fixture(spark, d, "P")).select("bin", "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query(f"select round(sum(n*abs(mean_p-mean_y))/sum(n),6) as ece from ({_CAL})", ["P"])
def ece(spark, d):
    return metrics.ece(fixture(spark, d, "P")).select(r6("ece").alias("ece"))


@query("select round(avg((p-y)*(p-y)),6) as brier, round(avg(abs(p-y)),6) as mae, round(avg(p-y),6)+0e0 as mean_error, round(avg(-(y*ln(q)+(1-y)*ln(1e0-q))),6) as log_loss, round(avg(-(y*power(1e0-q,2)*ln(q)+(1-y)*power(q,2)*ln(1e0-q))),6) as focal_loss from (select *, least(greatest(p,1e-7),1e0-1e-7) as q from P)", ["P"])
def score_errors(spark, d):
    out = metrics.score_errors(fixture(spark, d, "P"))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("select bin, count(*) as n from (select p, max(b) as bin from P, range(20) t(b) where p between 0 and 1 and b/20e0 <= p group by k, p) group by bin", ["P"])
def hist_fixed(spark, d):
    return metrics.hist_fixed(fixture(spark, d, "P"), "p").select(F.col("bin").cast("long").alias("bin"), "n")


@query("select y as label, count(*) as n, round(avg(p),6) as mean_p, round(stddev_pop(p),6) as std_p from P group by y", ["P"])
def performance_by_label(spark, d):
    return metrics.performance_by_label(fixture(spark, d, "P")).select("label", "n", r6("mean_p").alias("mean_p"), r6("std_p").alias("std_p"))


@query("select l_partkey as object_id, round(avg(l_discount),6) as mean_score, round(stddev_pop(l_discount),6) as std_score, count(*) as n_models from lineitem group by l_partkey")
def ensemble(spark, d):
    return metrics.ensemble(_t(spark, d, "lineitem"), "l_partkey", "l_discount").select(F.col("l_partkey").alias("object_id"), r6("mean_score").alias("mean_score"), r6("std_score").alias("std_score"), "n_models")


@query("select feature, lo, hi from (select 'mag' as feature, min(mag) as lo, max(mag) as hi from D union all select 're_arcsec', min(re_arcsec), max(re_arcsec) from D union all select 'n_pix', min(n_pix), max(n_pix) from D)", ["D"])
def feature_ranges(spark, d):
    return metrics.feature_ranges(fixture(spark, d, "D"), ["mag", "re_arcsec", "n_pix"])


@query("select k, y from P where y=1 union all select k, y from (select *, row_number() over (order by (k*2654435761+1) % 1000003, k) as rn from P where y=0) where rn <= 3*(select count(*) from P where y=1)", ["P"])
def balance(spark, d):
    return metrics.balance(fixture(spark, d, "P"), "k").select("k", "y")


@query("select k, bin, cast((row_number() over (partition by bin order by (k*2654435761+1) % 1000003, k)-1) % 10 as int) as fold from (select k, cast(least(floor(p*5),4) as int) as bin from P)", ["P"])
def stratified_folds(spark, d):
    return metrics.stratified_folds(fixture(spark, d, "P"), "k", "p").select("k", "bin", "fold")


@query(", c as (select cast(b as int) as bin, count(k) as n from range(10) t(b) left join P on least(floor(p*10),9)=b group by b), w as (select *, 1e0/power(n+1e-6,0.5e0) as raw from c) select bin, n, round(raw/(select sum(raw) from w)*10,6) as weight from w", ["P"])
def sample_weights(spark, d):
    return metrics.sample_weights(fixture(spark, d, "P"), "p").select("bin", "n", r6("weight").alias("weight"))


@query("select round(count(*) filter (s and y=1)/count(*) filter (y=1),6) as sensitivity, round(count(*) filter (not s and y=0)/count(*) filter (y=0),6) as specificity, round(count(*) filter (s and y=1)/count(*) filter (s),6) as ppv from (select y, 0.8e0*p+0.1e0 > 0.5e0 as s from P)", ["P"])
def separator_metrics(spark, d):
    out = metrics.separator_metrics(fixture(spark, d, "P"), ph.separator_value("linear", F.col("p"), (0.8, 0.1)) > 0.5)
    return out.select(*(r6(c).alias(c) for c in out.columns))


# --- sets, sorts, sinks ----------------------------------------------------------------
@query("select id_known, count(*) as n from D where id_known is not null group by id_known having count(*)>1", ["D"])
def count_duplicates(spark, d):
    return selection.count_duplicates(fixture(spark, d, "D"), "id_known")


@query("select k from D where band='r' intersect select k from D where band='g' intersect select k from D where band='i'", ["D"])
def common_ids(spark, d):
    return selection.common_ids([fixture(spark, d, "D").where(F.col("band") == b) for b in BANDS], "k")


@query("select k from D where band='r' except select k from D where band='g'", ["D"])
def missing_ids(spark, d):
    det = fixture(spark, d, "D")
    return selection.missing_ids(det.where("band='r'"), det.where("band='g'"), "k")


@query("select source_id, gmag from S order by gmag desc, source_id limit 20", ["S"])
def top_stars(spark, d):
    return selection.top_stars(fixture(spark, d, "S"), 20)


@query("select k, count(*) filter (id_known is not null) as with_id, count(distinct band) as n_bands from D group by k", ["D"])
def bands_per_object(spark, d):
    return selection.bands_per_object(fixture(spark, d, "D"), "k")


@query("select k, (lag(p) over w + p)/2 as midpoint from P window w as (order by p, k) qualify y <> lag(y) over w", ["P"])
def class_flips(spark, d):
    from skycat.operators.training import class_flips as flips

    return flips(fixture(spark, d, "P"), "p", "y", "k").select("k", "midpoint")


@query("select det_id, cast((row_number() over (order by det_id)-1)//500 as bigint) as chunk from D", ["D"])
def export_chunks(spark, d):
    from skycat.sources.tables import exact_chunks

    return exact_chunks(fixture(spark, d, "D"), "det_id", 500).select("det_id", "chunk")


@query("select d.det_id, d.tile_x, d.tile_y, s.score from D d left join (select det_id, mag/30e0 as score from D where det_id % 3 = 0) s using (det_id)", ["D"])
def update_scores(spark, d):
    from skycat.sources.tables import update_scores as update

    det = fixture(spark, d, "D").select("det_id", "tile_x", "tile_y", "mag")
    return update(det.drop("mag"), det.where("det_id % 3 = 0").select("det_id", (F.col("mag") / 30.0).alias("score")), ["det_id"], "score")


@query("select id from R where id not in (select id_known from D where id_known is not null and k % 3 = 0)", ["R", "D"])
def accumulate_positives(spark, d):
    from skycat.sources.tables import new_positives

    stored = fixture(spark, d, "D").where("id_known is not null and k % 3 = 0").select(F.col("id_known").alias("id"))
    return new_positives(fixture(spark, d, "R").select("id"), stored, "id")


# --- footprints, reports, fits ---------------------------------------------------------
_AVAIL = ", av as (select distinct cast(floor(ra*2e0*cos(radians(dec))) as int) as x, cast(floor((dec+90e0)*2e0) as int) as y from D), ac as (select x, y, y/2e0-90e0 as dec, x/2e0/cos(radians(y/2e0-90e0)) as ra from av), pr as (select r.id, a.x, a.y, " + SEP.format(a="r", b="a") + " as sep, radians(r.ra-a.ra) as da, radians(r.dec) as dr, radians(a.dec) as d0 from R r, ac a where abs(r.dec-a.dec)<0.6e0), tc as (select id, x, y, sep, px, py from (select *, 5000e0-degrees(cos(dr)*sin(da)/" + _CC + ")/5.160234650248e-05 as px, 5000e0+degrees((cos(d0)*sin(dr)-sin(d0)*cos(dr)*cos(da))/" + _CC + ")/5.160234650248e-05 as py from pr where " + _CC + ">0) where px between 0.5e0 and 10000.5e0 and py between 0.5e0 and 10000.5e0)"


def _available(spark, d):
    return fixture(spark, d, "D").select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y")).distinct()


@query(_AVAIL + " select id, x, y, round(sep,4) as sep from tc", ["R", "D"])
def tiles_containing(spark, d):
    from skycat.operators.footprint import tiles_containing as containing

    return containing(fixture(spark, d, "R"), _available(spark, d), "id").select("id", "x", "y", F.round("sep", 4).alias("sep"))


@query(_AVAIL + ", bn as (select tile_x as x, tile_y as y, string_agg(distinct band, ',' order by band) as bands, count(distinct band) as n_bands from D group by 1,2) select R.id, t.x, t.y, round(t.px,3)+0e0 as px, round(t.py,3)+0e0 as py, bn.bands, bn.n_bands from R left join (select *, row_number() over (partition by id order by round(sep,6), x, y) as rn from tc) t on R.id=t.id and t.rn=1 left join bn on bn.x=t.x and bn.y=t.y", ["R", "D"])
def assign_tile(spark, d):
    from skycat.operators.footprint import assign_tile as assign

    available = fixture(spark, d, "D").select(F.col("tile_x").alias("x"), F.col("tile_y").alias("y"), "band").distinct()
    out = assign(fixture(spark, d, "R").select("id", "ra", "dec"), available, "id")
    return out.select("id", "x", "y", (F.round("px", 3) + 0.0).alias("px"), (F.round("py", 3) + 0.0).alias("py"), F.array_join("bands", ",").alias("bands"), F.col("n_bands").cast("long").alias("n_bands"))


@query(_AVAIL + " select id, lpad(cast(x as varchar),3,'0')||'_'||lpad(cast(y as varchar),3,'0') as tile from tc", ["R", "D"])
def known_in_footprint(spark, d):
    from skycat.operators.footprint import known_in_footprint as inside

    return inside(fixture(spark, d, "R"), _available(spark, d), "id")


_GROUPS = _FOF.format(lim="10e0") + ", g as (select q.*, component, count(*) over (partition by component) as members, first_value(q.det_id) over (partition by component order by mag desc, q.det_id) as best_id from q join t on q.det_id=t.node)"


@query(_GROUPS + " select det_id, component, members, best_id, det_id=best_id as is_best from g where members>1", ["D"])
def duplicate_report(spark, d):
    return catalog.duplicate_report(fixture(spark, d, "D").select("det_id", "band", "ra", "dec", "mag"), "det_id", "mag", 10.0, keys=("band",))


@query(_GROUPS + " select g.det_id, g.component, g.members, g.best_id, g.det_id=g.best_id as is_best, round(" + SEP.format(a="g", b="b") + ",5) as sep_to_best, g.tile_x=b.tile_x and g.tile_y=b.tile_y as same_tile, 10e0 as threshold from g join q b on b.det_id=g.best_id where g.members>1", ["D"])
def duplicate_details(spark, d):
    return catalog.duplicate_details(fixture(spark, d, "D"), "det_id", "mag", 10.0, keys=("band",)).withColumn("sep_to_best", F.round("sep_to_best", 5))


@query(", c as (select a.det_id, r.id, row_number() over (partition by a.det_id order by " + SEP.format(a="a", b="r") + ", r.id) as rn from D a, R r where a.id_known is null and abs(a.dec-r.dec)<0.02e0 and " + SEP.format(a="a", b="r") + "<=40e0) select D.det_id, coalesce(D.id_known, c.id) as id_known from D left join c on D.det_id=c.det_id and c.rn=1", ["D", "R"])
def fill_missing_ids(spark, d):
    return catalog.fill_missing_ids(fixture(spark, d, "D"), fixture(spark, d, "R"), "det_id", max_sep=40.0).select("det_id", "id_known")


def _near_band(b):
    return "(select l, v as " + b + "_id from (select a.det_id as l, c.det_id as v, row_number() over (partition by a.det_id order by " + SEP.format(a="a", b="c") + ", c.det_id) as rn from D a, D c where a.band='r' and c.band='" + b + "' and abs(a.dec-c.dec)<0.005e0 and " + SEP.format(a="a", b="c") + "<15e0) where rn=1)"


_REFERENCE = "select g.l as r_id, g_id, i_id from " + _near_band("g") + " g join " + _near_band("i") + " i on g.l=i.l"


@query(_REFERENCE, ["D"])
def reference_join(spark, d):
    return catalog.reference_join(fixture(spark, d, "D").select("det_id", "band", "ra", "dec"))


@query(", W as (select * replace (case when k % 8 in (1,3) then concat('K', cast(k as varchar)) end as id_known) from D), E as (select * from W where id_known is null), kn as (select id_known, min(det_id) filter (band='r') as r_id, min(det_id) filter (band='g') as g_id, min(det_id) filter (band='i') as i_id from W where id_known is not null group by 1), al as (select * from kn where r_id is not null and g_id is not null and i_id is not null union all select null, r_id, g_id, i_id from (" + _REFERENCE.replace("from D a, D c where", "from E a, E c where") + ")) select al.*, D.tile_x, D.tile_y from al join D on D.det_id=al.r_id", ["D"])
def reference_catalog(spark, d):
    named = F.when((F.col("k") % 8).isin(1, 3), F.concat(F.lit("K"), F.col("k").cast("string")))
    return catalog.reference_catalog(fixture(spark, d, "D").withColumn("id_known", named))


@query(", s as (select k, p, y, 0.5e0*p+(k % 7)/10e0 as v, case when y=1 then 100e0 else 1e0 end as w from P), l as (select (sum(w)*sum(w*p*v)-sum(w*p)*sum(w*v))/(sum(w)*sum(w*p*p)-sum(w*p)*sum(w*p)) as m, sum(w) as w, sum(w*p) as sx, sum(w*v) as sv from s), o as (select m, (sv-m*sx)/w as b from l), q as (select quantile_cont(v-m*p-b, 0.05e0) as sh from s, o where y=1 and v-m*p-b<0) select round(m,6)+0e0 as slope, round(b+coalesce(sh,0),6)+0e0 as \"offset\" from o, q", ["P"])
def fit_linear_separator(spark, d):
    from skycat.operators.training import fit_linear_separator as fit

    out = fit(fixture(spark, d, "P").withColumn("v", 0.5 * F.col("p") + (F.col("k") % 7) / 10), "p", "y")
    return out.select(r6("slope").alias("slope"), r6("offset").alias("offset"))


@query("select det_id, m < 9 as bright, case when m < 7 then 30 when m < 9 then 10 else 5 end as factor, case when m <= 8 then 50 else 100 end as box from (select source_id as det_id, gmag as m from S)", ["S"])
def field_background_scale(spark, d):
    bright, factor, box = ph.field_background_scale(F.col("gmag"))
    return fixture(spark, d, "S").select(F.col("source_id").alias("det_id"), bright.alias("bright"), factor.alias("factor"), box.alias("box"))


@query("select det_id, mag, cast(null as double) as zspec, band from D where band='r' union all select det_id, null, mag/10e0, band from D where band='g'", ["D"])
def union_bands(spark, d):
    det = fixture(spark, d, "D")
    r, g = det.where("band='r'").select("det_id", "mag", "band"), det.where("band='g'").select("det_id", (F.col("mag") / 10.0).alias("zspec"), "band")
    return selection.union_bands([r, g])


@query(", s as (select id from R where bands <> 'rg') select band, count(*) filter (id_known in (select id from s)) as matched, count(*) filter (id_known is null) as no_id, count(*) filter (id_known is not null and id_known not in (select id from s)) as other from D group by band", ["D", "R"])
def id_tally(spark, d):
    known = fixture(spark, d, "R").where("bands <> 'rg'").select(F.col("id").alias("id_known"))
    return selection.id_tally(fixture(spark, d, "D"), known, "id_known", "band")


@query("select distinct lpad(cast(tile_x as varchar),3,'0')||'_'||lpad(cast(tile_y as varchar),3,'0') as tile from D order by 1 limit 3", ["D"])
def first_tiles(spark, d):
    return selection.first_tiles(fixture(spark, d, "D").select(tiles.tile_key(F.col("tile_x"), F.col("tile_y")).alias("tile")), 3)


from skycat.plans import more, pixel_queries  # noqa: E402, F401
