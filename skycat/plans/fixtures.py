"""Synthetic views over the driver's tables, in SQL that runs unchanged in both engines."""

from __future__ import annotations

import re

D = """
with p as (select p_partkey k, 150e0 + ((p_partkey*7919) % 20011)/10005.5e0 as ra0, 30e0 + ((p_partkey*6101) % 20021)/10010.5e0 as dec0 from part),
b as (select * from (values (0,'r'),(1,'g'),(2,'i')) v(bi,band)),
c as (select * from (values (0),(1)) w(dup)),
d as (select (k*3+bi)*2+dup as det_id, band, bi, k, dup,
   ra0 + (((k*(bi+3)) % 9) - 4)*2e0/3600e0 + dup*3.1e0/3600e0 as ra,
   dec0 + (((k*(bi+5)) % 7) - 3)*1.97e0/3600e0 - dup*2.3e0/3600e0 as dec,
   18e0 + ((k*(bi+11)) % 800)/100e0 as mag,
   1e0 + ((k*13 + bi*7) % 60)/10e0 as re_arcsec,
   ((k*17 + bi*5) % 90 + 10)/100e0 as axis_ratio,
   ((k*29) % 1500)+5 as n_pix,
   case when k % 8 = 3 then concat('K', cast(k as string)) end as id_known,
   case when k % 8 = 3 then 1e0 end as lsb
 from p, b, c where (k+bi) % 4 <> 0 and (dup = 0 or k % 10 = bi))
select *, mag + 0.752e0 + 2.5e0*log10(pi()*re_arcsec*re_arcsec*axis_ratio) as mu, power(10e0, 0.4e0*(30e0-mag)) as total_flux,
  0.45e0*re_arcsec as r_10, 0.7e0*re_arcsec as r_25, 1.5e0*re_arcsec as r_75, 1.5e0*(1.1e0+(k%7)/20e0)*re_arcsec as r_90,
  (2.5e0+(k%5)/4e0)*re_arcsec as r_100, 0.8e0*re_arcsec as r_fwhm, power(10e0, 0.4e0*(30e0-mag))/50e0 as mu_max, power(10e0, 0.4e0*(30e0-mag))/n_pix as mu_mean, 0.8e0*power(10e0, 0.4e0*(30e0-mag))/n_pix as mu_median,
  cast(floor(ra*2e0*cos(radians(dec))) as int) as tile_x, cast(floor((dec+90e0)*2e0) as int) as tile_y from d"""
R = """
select concat('K', cast(p_partkey as string)) as id, 150e0 + ((p_partkey*7919) % 20011)/10005.5e0 as ra, 30e0 + ((p_partkey*6101) % 20021)/10010.5e0 as dec,
  case when p_partkey % 16 = 3 then null else 1e0 + (p_partkey % 12) end as re,
  case when p_partkey % 3 = 0 then '[''r'', ''g'', ''i'']' when p_partkey % 3 = 1 then '[''r'']' else 'rg' end as bands
from part where p_partkey % 8 = 3 or p_partkey % 32 = 5"""
#: A patch of 8 x 8 pixels for every part, 15 patches to a row and 5 rows to an image; images are the bands r and g of
#: one tile after the other.  Discs are cut by the borders of images, and segment ids repeat from image to image.
X = """
with a as (select cast(p_partkey % 15 as int) as px, cast(floor(p_partkey/15e0) as int) % 5 as py, cast(floor(p_partkey/75e0) as int) as im from part),
i as (select * from (values (0),(1),(2),(3),(4),(5),(6),(7)) v(i)), j as (select * from (values (0),(1),(2),(3),(4),(5),(6),(7)) w(j)),
c as (select im, px*8+i as x, py*8+j as y from a, i, j),
g as (select im, cast(floor(im/2e0) as int) as t, x, y, x % 40 - 20 as dx, (y + 13*im) % 40 - 20 as dy, cast(floor(x/40e0) as int) as cx, cast(floor((y + 13*im)/40e0) as int) - cast(floor(13*im/40e0) as int) as cy from c)
select concat(lpad(cast(t as string), 3, '0'), '_000') as tile, case when im % 2 = 0 then 'r' else 'g' end as band, x, y, case when x < 8 and y < 8 then 0e0 when x % 40 = 5 and y % 40 = 5 then 500e0
   else 5e0 + ((x*31+y*17+t) % 7)/10e0 + (50e0+10e0*((cx+2*cy+im) % 4))*exp(-(dx*dx+dy*dy)/18e0) end as value,
  case when dx*dx+dy*dy <= 64 then cy*3+cx+1 end as segment_id from g"""
P = """
select p_partkey as k, ((p_partkey*37) % 1000)/1000e0 as p, case when (p_partkey*53) % 100 < ((p_partkey*37) % 1000)/10e0 then 1 else 0 end as y from part"""
J = """
select event_id as seq, cast(user_id % 30 as int) as tile, case event_id % 3 when 0 then 'r' when 1 then 'g' else 'i' end as band,
  case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'view' then 'processing' when 'click' then 'downloaded' else 'skipped_mostly_zeros' end as status,
  case when event_type in ('purchase','error') then value end as minutes, ts from events"""
#: A star list that grows with the tables, about 110 stars to a tile.
S = """
select c_custkey as source_id, 150e0 + ((c_custkey*7919) % 20011)/10005.5e0 as ra, 30e0 + ((c_custkey*6101) % 20021)/10010.5e0 as dec, 8e0 + (c_custkey*37 % 1400)/100e0 as gmag, c_custkey % 11 = 0 as in_galaxy_candidates,
  concat(lpad(cast(cast(floor(c_custkey/110e0) as int) as string), 3, '0'), '_000') as tile, cast((c_custkey*7) % 120 as int) as x, cast((c_custkey*11) % 40 as int) as y from customer"""
#: X with tile names of any length: ``lpad`` cuts those of four digits, and ten tiles get one name beyond 150,000 parts.
#: It goes by the name X in the SQL of the queries that use it.
WIDE = X.replace("lpad(cast(t as string), 3, '0')", "case when t < 1000 then lpad(cast(t as string), 3, '0') else cast(t as string) end")
SOURCE = {"D": ("part", D), "R": ("part", R), "X": ("part", X), "WIDE": ("part", WIDE), "P": ("part", P), "J": ("events", J), "S": ("customer", S)}
#: Fixtures with many rows for each one of their table, and the key that deals it.
DEALT = {"D": "p_partkey", "X": "p_partkey", "WIDE": "p_partkey"}
#: Rows of the table that one task takes at most: some 1.3 million pixels or 50,000 detections.
TASK_ROWS = 20_000
#: Spherical separation of rows a and b, in arcseconds, for brute-force oracles.
SEP = "(2e0*degrees(asin(sqrt(power(sin(radians({b}.dec-{a}.dec)/2e0),2)+cos(radians({a}.dec))*cos(radians({b}.dec))*power(sin(radians({b}.ra-{a}.ra)/2e0),2))))*3600e0)"


def fixture(spark, sf_dir, name):
    """The rows of a fixture; no view of the caller's session is touched.

    A row of part gives 64 pixels or some detections, so that a file of a single task can
    stand for very many rows: its rows are dealt to all tasks before, and to more tasks if
    the table is large, so that what one task holds does not grow with it.
    """
    table, sql = SOURCE[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in DEALT:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
        rows = rows.repartition(tasks, DEALT[name])
    return spark.sql(re.sub(rf"\bfrom {table}\b", f"from {{{table}}}", sql), **{table: rows})


def with_fixtures(*names, body):
    """DuckDB SQL with these fixtures as common table expressions named like them."""
    return "with " + ", ".join(f"{'X' if n == 'WIDE' else n} as ({SOURCE[n][1]})" for n in names) + " " + body
