"""Further queries with their DuckDB oracles: labels, flags, selections, catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skycat.functions import photometry as ph
from skycat.functions import tiles
from skycat.operators import catalog, jobs, labels, metrics, selection, training
from skycat.plans.fixtures import SEP, fixture
from skycat.plans.registry import _AVAIL, _MX, BANDS, _available, _matrix, _t, query, r6

# --- selection -------------------------------------------------------------------------
_RT = ", rt as (select *, cast(floor(ra*2e0*cos(radians(dec))) as int) as tile_x, cast(floor((dec+90e0)*2e0) as int) as tile_y from R)"


def _known(spark, d):
    x, y = F.floor(F.col("ra") * 2 * F.cos(F.radians("dec"))).cast("int"), F.floor((F.col("dec") + 90) * 2).cast("int")
    return fixture(spark, d, "R").withColumns({"tile_x": x, "tile_y": y})


@query(_RT + " select id, lpad(cast(tile_x as varchar),3,'0')||'_'||lpad(cast(tile_y as varchar),3,'0') as tile from rt where tile_y % 5 <> 0 and (case when bands like '[%' then bands like '%''r''%' and bands like '%''g''%' else contains(bands,'rg') end)", ["R"])
def catalog_for_bands(spark, d):
    cat = _known(spark, d).withColumn("tile", F.when(F.col("tile_y") % 5 != 0, tiles.tile_key(F.col("tile_x"), F.col("tile_y"))))
    return selection.catalog_for_bands(cat, ["r", "g"]).select("id", "tile")


@query("select det_id from D where lsb is null and k % 5 <> 0 and k % 7 <> 0 and k % 11 <> 0 and mag/30e0 > 0.7e0", ["D"])
def unknown_objects(spark, d):
    det = fixture(spark, d, "D").withColumns({"in_training_data": F.when(F.col("k") % 5 == 0, 1).when(F.col("k") % 2 == 0, 0), "class_label": F.when(F.col("k") % 7 == 0, 1), "zspec": F.when(F.col("k") % 11 == 0, 0.1), "score": F.col("mag") / 30.0})
    return selection.unknown_objects(det, "score", 0.7).select("det_id")


@query("select k from P where y = 1 or k % 3 = 0", ["P"])
def label_filter(spark, d):
    return selection.label_filter(fixture(spark, d, "P").withColumn("label", F.when(F.col("k") % 3 != 0, F.col("y"))), [1, "nan"]).select("k")


@query(_MX + " select tile from mx where r=1 and i=1", ["D"])
def tiles_with_bands(spark, d):
    return selection.tiles_with_bands(_matrix(spark, d), ("r", "i"))


@query(_MX + " select tile from mx where r+g+i>=2", ["D"])
def tiles_min_bands(spark, d):
    return selection.tiles_min_bands(_matrix(spark, d), BANDS, 2)


@query("select det_id, band from D where k % 3 <> 0 except all select det_id, band from D where k % 2 = 0", ["D"])
def except_ids(spark, d):
    det = fixture(spark, d, "D").select("det_id", "band", "k")
    return selection.except_rows(det.where("k % 3 <> 0").drop("k"), det.where("k % 2 = 0").drop("k"))


@query("select tile, band from (select distinct tile, band from J where seq % 5 <> 0) where tile % 3 = 1", ["J"])
def restrict_tiles(spark, d):
    j = fixture(spark, d, "J")
    return selection.restrict_tiles(j.where("seq % 5 <> 0").select("tile", "band").distinct(), j.where("tile % 3 = 1"))


# --- labels ----------------------------------------------------------------------------
def _scored(name, known, det):
    one = "known_id, tile_x, tile_y, band"
    return f"{name} as (select {one}, det_id, score from (select *, row_number() over (partition by {one} order by score desc, det_id) as rn from (select {one}, det_id, round(0.2e0*mu/tm+0.4e0*ln(1e0+n_pix)/ln(1e0+tp)+0.4e0*(1e0-sep/radius),9) as score from (select *, max(mu) over (partition by {one}) as tm, max(n_pix) over (partition by {one}) as tp from (select k.id as known_id, d.tile_x, d.tile_y, d.band, greatest(15e0, coalesce(3e0*k.re,0e0)) as radius, d.det_id, d.mu, d.n_pix, {SEP.format(a='k', b='d')} as sep from {known} k join {det} d on d.tile_x=k.tile_x and d.tile_y=k.tile_y where abs(k.dec-d.dec)<0.02e0) where sep<=radius))) where rn=1)"


#: Known objects on every tile whose footprint holds them, and the detections that pass a cut.
_CUT = _AVAIL + ", pk as (select R.*, tc.x as tile_x, tc.y as tile_y from tc join R using (id)), dc as (select * from D where mu>24e0 and re_arcsec>2e0)"
_Z = ", zc as (select rid, id, zspec, sep from (select r.id, d2.det_id as rid, r.ra/1000e0 as zspec, " + SEP.format(a="r", b="d2") + " as sep, row_number() over (partition by r.id, d2.band order by " + SEP.format(a="r", b="d2") + ", d2.det_id) as k from R r, dc d2 where abs(r.dec-d2.dec)<0.003e0 and " + SEP.format(a="r", b="d2") + "<5e0) where k=1)"


def _cut(spark, d):
    full = fixture(spark, d, "D")
    return full.where("mu > 24 and re_arcsec > 2"), full


@query(_CUT + ", " + _scored("sc", "pk", "dc") + _Z + ", l as (select det_id, known_id from (select *, row_number() over (partition by det_id order by score desc, known_id) as rn from sc) where rn=1), z as (select rid, zspec from (select *, row_number() over (partition by rid order by sep, id) as rn from zc) where rn=1) select dc.det_id, l.known_id as id_known, case when l.known_id is not null then 1e0 end as lsb, z.zspec from dc left join l on dc.det_id=l.det_id left join z on z.rid=dc.det_id", ["R", "D"])
def label_known(spark, d):
    zcat = fixture(spark, d, "R").select("id", "ra", "dec", (F.col("ra") / 1000.0).alias("zspec"))
    return labels.label_images(_cut(spark, d)[0], fixture(spark, d, "R"), zcat).select("det_id", "id_known", "lsb", "zspec")


_STATUS = _CUT + ", " + _scored("sc", "pk", "dc") + ", " + _scored("sf", "pk", "D") + ", st as (select b.*, sc.det_id is not null as matched, sc.det_id is null and cast(substr(b.known_id,2) as int) % 5 = 0 as corrupted, sc.det_id is null and sf.det_id is not null as recovered from (select pk.id as known_id, tile_x, tile_y, band from pk join (select distinct tile_x, tile_y, band from D) using (tile_x, tile_y)) b left join sc using (known_id, tile_x, tile_y, band) left join sf using (known_id, tile_x, tile_y, band))"
_COUNTED = "count(*) as known, count(*) filter (matched) as matched, count(*) filter (corrupted) as corrupted, count(*) filter (recovered) as recovered, case when count(*) filter (not matched and not corrupted) > 0 then count(*) filter (not matched and not recovered) + count(*) filter (corrupted) else count(*) filter (corrupted) end as unmatched from st"


def _status(spark, d):
    known, (cut, full) = fixture(spark, d, "R"), _cut(spark, d)
    bad = labels.placed_known(known, full).join(full.select("tile_x", "tile_y", "band").distinct(), ["tile_x", "tile_y"]).select("id", "tile_x", "tile_y", "band", (F.substring("id", 2, 20).cast("int") % 5 == 0).alias("corrupted"))
    return labels.known_status(cut, full, known, bad, images=True)


@query(_STATUS + f" select tile_x, tile_y, band, {_COUNTED} group by tile_x, tile_y, band", ["R", "D"])
def match_stats(spark, d):
    return labels.match_stats(_status(spark, d), ("tile_x", "tile_y", "band"))


@query(_STATUS + f" select {_COUNTED}", ["R", "D"])
def match_totals(spark, d):
    return labels.match_stats(_status(spark, d))


@query("select round(avg(n),6) as match_rate, count(*) as tiles from (select tile_x, tile_y, count(*) filter (lsb=1) as n from D group by 1,2)", ["D"])
def match_rate(spark, d):
    return labels.match_rate(fixture(spark, d, "D")).withColumn("match_rate", r6("match_rate"))


_TR = _RT + ", tr as (select case when substr(id,2)::int % 2 = 0 then 'non_dwarf_'||id else id end as known_id, ra, dec, tile_x, tile_y from rt), nm as (select det_id, known_id from (select d.det_id, t.known_id, row_number() over (partition by d.det_id order by " + SEP.format(a="d", b="t") + ", t.known_id) as rn from D d join tr t on d.tile_x=t.tile_x and d.tile_y=t.tile_y where abs(d.dec-t.dec)<0.003e0 and " + SEP.format(a="d", b="t") + "<=5e0) where rn=1), fl as (select D.det_id, D.tile_x, D.tile_y, nm.known_id as train_id, case when nm.known_id is null then 0 else 1 end as in_training_data, case when exists (select 1 from tr where tr.known_id=D.id_known and tr.tile_x=D.tile_x and tr.tile_y=D.tile_y) then 1 else 0 end as id_in_training, case when nm.known_id like 'non_dwarf%' then 0 when nm.known_id is not null then 1 end as visual_class from D left join nm on D.det_id=nm.det_id)"


def _training(spark, d):
    name = F.when(F.substring("id", 2, 20).cast("int") % 2 == 0, F.concat(F.lit("non_dwarf_"), "id")).otherwise(F.col("id"))
    train = _known(spark, d).select(name.alias("known_id"), "ra", "dec", "tile_x", "tile_y")
    return labels.flag_training(fixture(spark, d, "D"), train), train


@query(_TR + " select det_id, train_id, in_training_data, id_in_training, visual_class from fl", ["R", "D"])
def flag_training(spark, d):
    return _training(spark, d)[0].select("det_id", "train_id", "in_training_data", "id_in_training", "visual_class")


@query(_TR + ", c as (select tile_x, tile_y, cast(sum(in_training_data) as bigint) as by_place, cast(sum(id_in_training) as bigint) as by_id, count(distinct train_id) as distinct_rows, cast(sum(in_training_data*id_in_training) as bigint) as by_both from fl group by 1,2), n as (select tile_x, tile_y, count(*) as training from tr group by 1,2) select tile_x, tile_y, training, by_place, by_id, distinct_rows, by_both from n join c using (tile_x, tile_y) where by_place<>training or by_id<>training", ["R", "D"])
def training_mismatches(spark, d):
    return labels.training_mismatches(*_training(spark, d))


@query(_TR + " select count(*) filter (known_id in (select train_id from fl where train_id is not null)) as found, count(*) filter (known_id not in (select train_id from fl where train_id is not null)) as missing, count(*) filter (known_id not like 'non_dwarf%') as dwarf, count(*) filter (known_id like 'non_dwarf%') as non_dwarf from tr", ["R", "D"])
def training_totals(spark, d):
    return labels.training_totals(*_training(spark, d))


@query(_AVAIL + ", h as (select tc.id, d.det_id, d.mag/30e0 as score, row_number() over (partition by tc.id order by d.mag desc, d.det_id) as rn from tc join R on R.id=tc.id join D d on d.tile_x=tc.x and d.tile_y=tc.y and abs(d.dec-R.dec)<0.003e0 and " + SEP.format(a="R", b="d") + "<=5e0) select R.id, h.det_id, round(h.score,6) as score from R left join h on h.id=R.id and h.rn=1", ["R", "D"])
def best_score_lookup(spark, d):
    objects = fixture(spark, d, "D").withColumn("score", F.col("mag") / 30.0)
    return labels.best_score_lookup(fixture(spark, d, "R"), objects, _available(spark, d), "id", "det_id").withColumn("score", r6("score"))


# --- metrics ---------------------------------------------------------------------------
@query("select xb as x_bin, yb as y_bin, count(*) as n from (select k, max(a.b) as xb, max(c.b) as yb from (select k, p, (k*29 % 1000)/1000e0 as q from P) s, range(25) a(b), range(25) c(b) where a.b/25e0 <= p and c.b/25e0 <= q group by k) group by 1,2", ["P"])
def hist2d(spark, d):
    out = metrics.hist2d(fixture(spark, d, "P").withColumn("q", (F.col("k") * 29 % 1000) / 1000.0), "p", "q")
    return out.select(F.col("x_bin").cast("long").alias("x_bin"), F.col("y_bin").cast("long").alias("y_bin"), "n")


@query(", s as (select p, count(*) filter (y=1) as pos, count(*) as n from P group by p) select p as score, round(sum(pos) over w/sum(n) over w,6) as \"precision\", round(sum(pos) over w/(select sum(pos) from s),6) as recall from s window w as (order by p desc)", ["P"])
def pr_points(spark, d):
    return metrics.pr_points(fixture(spark, d, "P")).select("score", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("select b as label, count(*) as n, round(avg(1e0-p),6) as mean_p, round(stddev_pop(1e0-p),6) as std_p from (select k, p, max(b) as b from P, range(5) t(b) where b/5e0<=p group by k, p) group by b", ["P"])
def performance_by_label_bin(spark, d):
    out = metrics.performance_by_label(fixture(spark, d, "P").withColumn("s", 1 - F.col("p")), "p", "s", bins=5)
    return out.select(F.col("label").cast("long").alias("label"), "n", r6("mean_p").alias("mean_p"), r6("std_p").alias("std_p"))


@query("select det_id, round(2e0*exp(-0.1e0*power(mag,1.1e0))+1e0,6) as modified, round(2e0*exp(-0.05e0*mag)/(1e0+exp(-0.7e0*(mag-22e0)))+0.5e0,6) as sigmoid, round(3e0/(1e0+exp(1.2e0*(mag-23e0)))+0.2e0,6) as steep, round(exp(0.001e0*mag*mag-0.1e0*mag+1e0),6) as poly from D", ["D"])
def separator_curves(spark, d):
    m, s = F.col("mag"), ph.separator_value
    return fixture(spark, d, "D").select("det_id", r6(s("modified_exponential", m, (2.0, -0.1, 1.1, 1.0))).alias("modified"), r6(s("sigmoid_exponential", m, (2.0, -0.05, 0.7, 22.0, 0.5))).alias("sigmoid"), r6(s("steep_fall", m, (3.0, 1.2, 23.0, 0.2))).alias("steep"), r6(s("exp_poly", m, (0.001, -0.1, 1.0))).alias("poly"))


@query("select source_id, round(least(greatest(power(0.1e0*gmag,-2e0)+0.05e0,0e0),1.2e0),6) as size from S", ["S"])
def star_model_power(spark, d):
    return fixture(spark, d, "S").select("source_id", r6(ph.star_model_power(F.col("gmag"), 0.1, 2.0, 0.05, 1.2)).alias("size"))


@query("select k, round(y*0.9e0+0.05e0,6) as label from P", ["P"])
def smooth_label(spark, d):
    return fixture(spark, d, "P").select("k", r6(ph.smooth_label(F.col("y"), 0.1)).alias("label"))


@query("select distinct tile_x, tile_y, round(5.16e-05*4*tile_x,9) as cd, round((tile_y-0.5e0)/4+0.5e0,6) as crpix from D", ["D"])
def rebin_header(spark, d):
    cd, crpix = ph.rebin_header(5.16e-05 * F.col("tile_x"), F.col("tile_y"), 4)
    return fixture(spark, d, "D").select("tile_x", "tile_y").distinct().select("tile_x", "tile_y", F.round(cd, 9).alias("cd"), r6(crpix).alias("crpix"))


@query(", c as (select band, count(*) as n from D group by band), o as (select band, mag, row_number() over (partition by band order by mag) - 1 as r from D), g as (select c.band, s, (n-1)*s/10000e0 as spot from c, range(10001) t(s)), v as (select g.band, g.s, a.mag + (spot-floor(spot))*(coalesce(b.mag,a.mag)-a.mag) as v from g join o a on a.band=g.band and a.r=floor(spot) left join o b on b.band=g.band and b.r=floor(spot)+1) select band, coalesce(max(s) filter (v<=24e0), 10000)/100e0 as percentile from v group by band", ["D"])
def percentile_for_target(spark, d):
    return training.percentile_for_target(fixture(spark, d, "D"), ["band"], "mag", 24.0)


@query("select tile, band from (select tile, band, status from (select *, row_number() over (partition by tile, band order by seq desc) as rn from J) where rn=1) where status='failed'", ["J"])
def failed_jobs(spark, d):
    return jobs.failed_jobs(jobs.upsert_jobs(fixture(spark, d, "J")))


@query("select count(*) as jobs, count(*) filter (status='completed') as completed, count(*) filter (status='failed') as failed, round(avg(case when status='completed' then minutes end),6) as mean_minutes from J", ["J"])
def run_totals(spark, d):
    return jobs.run_totals(fixture(spark, d, "J")).withColumn("mean_minutes", r6("mean_minutes"))


@query("select k, bin, cast(case when rn < floor(n*0.1e0) then -1 else (rn-floor(n*0.1e0)) % 10 end as int) as fold from (select k, bin, count(*) over (partition by bin) as n, row_number() over (partition by bin order by (k*2654435761+1) % 1000003, k)-1 as rn from (select k, cast(least(floor(p*5),4) as int) as bin from P))", ["P"])
def folds_with_test_share(spark, d):
    return metrics.stratified_folds(fixture(spark, d, "P"), "k", "p", test=0.1).select("k", "bin", "fold")


# --- catalogs --------------------------------------------------------------------------
_TPAIRS = "select a.det_id as u, b.det_id as v from D a join D b on a.tile_x=b.tile_x and a.tile_y=b.tile_y and a.det_id<>b.det_id and a.band<>b.band and abs(a.dec-b.dec)<0.003e0 and " + SEP.format(a="a", b="b") + "<10e0"
_WIDE = ", ".join(f"max(case when band='{b}' then {c} end) as {c}_{b}" for b in BANDS for c in ("det_id", "mag", "mu", "re_arcsec"))
_FIRST = ", ".join(f"arg_min({c}, rk) filter ({c} is not null) as {c}" for c in ("ra", "dec", "tile_x", "tile_y", "lsb", "id_known"))


@query(f", e as ({_TPAIRS}), t as (with recursive r(node, c) as (select det_id, det_id from D union select e.v, r.c from r join e on r.node=e.u) select node, min(c) as component from r group by node), g as (select D.*, component, count(*) over (partition by component) as members from D join t on D.det_id=t.node), f as (select component, count(distinct band) as nb, max(case when lsb=1 or id_known is not null then 1 else 0 end) as kn, median(ra) as mra, median(dec) as mdec from g group by 1), k as (select g.*, row_number() over (partition by g.component, band order by round(" + SEP.replace("{b}.", "f.m").format(a="g") + ",6), det_id) as rn, case band when 'r' then 0 when 'g' then 1 else 2 end as rk from g join f on g.component=f.component where nb>1 or kn=1), o as (select component, " + _FIRST + ", " + _WIDE + " from k where rn=1 group by component), q as (select *, case when id_known is null then 1 else row_number() over (partition by id_known order by least(mu_r,mu_g,mu_i) desc nulls last, component) end as keep from o) select component, round(ra,6) as ra, round(dec,6) as dec, lsb, id_known, det_id_r, det_id_g, det_id_i, round(mu_r,6) as mu_r, round(mu_g,6) as mu_g, round(mu_i,6) as mu_i, round(re_arcsec_g,6) as re_arcsec_g, round(mag_i,6) as mag_i, tile_x, tile_y, row_number() over (partition by tile_x, tile_y order by component)-1 as unique_id from q where keep=1", ["D"])
def cross_band_catalog(spark, d):
    out = catalog.cross_band_catalog(fixture(spark, d, "D"))
    rounded = [r6(c).alias(c) for c in ("ra", "dec", "mu_r", "mu_g", "mu_i", "re_arcsec_g", "mag_i")]
    return out.select("component", "lsb", "id_known", "det_id_r", "det_id_g", "det_id_i", "tile_x", "tile_y", F.col("unique_id").cast("long").alias("unique_id"), *rounded)


_PREFS = ", ng as (select * from D where coalesce(lsb,0) <> 1), ps as (select det_id, tile_x, tile_y, ra, dec, row_number() over (partition by tile_x, tile_y order by det_id) as step from D where lsb=1), pf as (select p.tile_x, p.tile_y, p.step, p.det_id as pid, list(n.det_id order by (n.ra-p.ra)*(n.ra-p.ra)+(n.dec-p.dec)*(n.dec-p.dec), n.det_id) as prefs from ps p join ng n using (tile_x, tile_y) group by all), pr as (select tile_x, tile_y, pid, prefs, row_number() over (partition by tile_x, tile_y order by step) as step from pf)"
_CHAIN = " select positive_id, negative_id from (with recursive s(tile_x, tile_y, step, pid, picks, used) as (select tile_x, tile_y, step, pid, prefs[1:{k}], prefs[1:{k}] from pr where step=1 union all select pr.tile_x, pr.tile_y, pr.step, pr.pid, list_filter(pr.prefs, lambda x: not list_contains(s.used, x))[1:{k}], s.used || list_filter(pr.prefs, lambda x: not list_contains(s.used, x))[1:{k}] from s join pr on pr.tile_x=s.tile_x and pr.tile_y=s.tile_y and pr.step=s.step+1) select pid as positive_id, unnest(picks) as negative_id from s where len(picks)={k})"


@query(_PREFS + _CHAIN.format(k=2), ["D"])
def exclusive_negatives(spark, d):
    return training.exclusive_negatives(fixture(spark, d, "D"), 2)


#: A crowded rule: positives are every third row, so that most of them compete and many stay short.
_CROWD = _PREFS.replace("from D where coalesce(lsb,0) <> 1", "from D where k % 3 <> 0").replace("from D where lsb=1", "from D where k % 3 = 0")


@query(_CROWD + _CHAIN.format(k=4), ["D"])
def exclusive_negatives_crowded(spark, d):
    crowd = fixture(spark, d, "D").withColumn("lsb", F.when(F.col("k") % 3 == 0, 1.0))
    return training.exclusive_negatives(crowd, 4)


# --- sources and sinks, read back ------------------------------------------------------
def _folder(spark, purpose):
    from skycat.operators.components import shared_folder

    return shared_folder(spark, purpose)


@query("select det_id, band, tile_x, tile_y, round(mag,6) as mag from D where band in ('r','i') and (tile_x, tile_y) in (select tile_x, tile_y from D group by all order by tile_x, tile_y limit 5)", ["D"])
def scan_detections(spark, d):
    from skycat.sources.tables import scan_detections as scan
    from skycat.sources.tables import write_by_tile

    path, det = _folder(spark, "detections"), fixture(spark, d, "D").select("det_id", "band", "tile_x", "tile_y", "mag")
    write_by_tile(det, path, ("tile_x", "tile_y", "band"))
    some = [(r.tile_x, r.tile_y) for r in det.select("tile_x", "tile_y").distinct().orderBy("tile_x", "tile_y").limit(5).collect()]  # five tiles are asked for
    return scan(spark, path, bands=["r", "i"], tiles=some).select("det_id", "band", "tile_x", "tile_y", r6("mag").alias("mag"))


@query("select id, round(ra,6) as ra, round(dec,6) as dec, round(re,6) as re from R", ["R"])
def scan_catalog(spark, d):
    from skycat.sources.tables import scan_catalog as scan

    path = _folder(spark, "catalog")
    known = fixture(spark, d, "R").select(F.col("id").alias("name"), F.col("ra").alias("RAJ2000"), F.col("dec").alias("DEJ2000"), F.coalesce("re", F.lit(float("nan"))).alias("re"))
    known.write.csv(path, header=True)
    out = scan(spark, path, "RAJ2000", "DEJ2000", "name", "name string, RAJ2000 double, DEJ2000 double, re double")
    return out.select("id", *(r6(c).alias(c) for c in ("ra", "dec", "re")))


@query("select distinct 'CFIS.'||lpad(cast(tile_x as varchar),3,'0')||'.'||lpad(cast(tile_y as varchar),3,'0')||'.r.fits' as name, tile_x as x, tile_y as y from D", ["D"])
def scan_tile_list(spark, d):
    from skycat.sources.tables import scan_tile_list as scan

    path = _folder(spark, "tile-list")
    named = fixture(spark, d, "D").select(tiles.tile_file_name(F.col("tile_x"), F.col("tile_y"), "CFIS", ".", ".r.fits").alias("value")).distinct()
    # names with blanks around them, and blank lines between
    named.select(F.explode(F.array(F.concat(F.lit("  "), "value", F.lit(" ")), F.lit("  "))).alias("value")).write.text(path)
    return scan(spark, path)


@query("select det_id, band, cast((row_number() over (order by det_id)-1)//200 as bigint) as chunk from D where lsb=1", ["D"])
def write_chunks(spark, d):
    from skycat.sources.tables import write_chunks as write

    path = _folder(spark, "chunks")
    write(fixture(spark, d, "D").select("det_id", "band", F.col("lsb").alias("label")), "det_id", 200, path, labels=[1])
    return spark.read.parquet(path).select("det_id", "band", F.col("chunk").cast("long").alias("chunk"))


# --- classifiers -----------------------------------------------------------------------
_FEATURES = ["mag", "mu", "re_arcsec", "axis_ratio", "n_pix"]


def _examples(spark, d):
    return fixture(spark, d, "D").withColumn("label", ((F.col("mu") > 25) & (F.col("re_arcsec") > 3)).cast("int"))


@query()
def model_search(spark, d):
    """The tries of a random search with their mean metric, best first (rows only: Spark's trees have no SQL)."""
    from skycat.operators import scoring

    train, _ = scoring.split_by_key(_examples(spark, d), "k")
    _, tries = scoring.search_classifier(train, _FEATURES, "k", tries=3, folds=3, choices={"numTrees": [5, 10], "maxDepth": [3, 5]})
    rows = sorted(((str(sorted(s.items())), m) for s, m in tries), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i, s, round(m, 6)) for i, (s, m) in enumerate(rows, 1)], "place int, setting string, f1 double")


@query()
def feature_importance(spark, d):
    """Features by falling importance in boosted trees (rows only)."""
    from skycat.operators import scoring

    model, _ = scoring.train_classifier(_examples(spark, d), _FEATURES, trees=5, depth=3, kind="boosted")
    rows = scoring.feature_importance(model, _FEATURES)
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(rows, 1)], "place int, feature string, importance double")


@query()
def held_out_scores(spark, d):
    """Predictions for the held-out share of keys by trees fitted on the others (rows only)."""
    from skycat.operators import scoring

    train, test = scoring.split_by_key(_examples(spark, d), "k")
    model, _ = scoring.train_classifier(train, _FEATURES, trees=10)
    return scoring.classify(test, model, None).select("det_id", "label", F.col("prediction").cast("int").alias("predicted"))


@query("select vec_id, round(list_avg(embedding::double[])/2 + list_max(embedding)::double/2,5) as score from embeddings")
def score_embeddings(spark, d):
    """Scores of all vectors by two models, one their mean and one their largest value."""
    from skycat.operators import scoring

    out = scoring.score_arrays(_t(spark, d, "embeddings"), lambda: [lambda x: x.mean(1), lambda x: x.max(1)], "embedding")
    return out.select("vec_id", F.round("score", 5).alias("score"))
