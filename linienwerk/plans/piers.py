"""Queries of piers."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import piers as ops
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import hav

C = F.col


@query("fx_stations fx_line_stops fx_buildings", f"""with p as (select uic pier, round(lon, 6) lon, round(lat, 6) lat, case cast(uic as int) % 3 when 0 then 2.3e-5 when 1 then 1.07e-4 else 1.03e-3 end k from fx_stations),
v as (select p.pier, p.lon px, p.lat py, x.line_id, x.seq, p.lon + (x.lon - p.lon) * k + cast(p.pier as int) % 2 * 6e-4 lon, p.lat + (x.lat - p.lat) * k lat from p join (select distinct uic, line_id from fx_line_stops) u on u.uic = p.pier join fx_line_stops x on x.line_id = u.line_id),
w as (select *, (lon - px) * (lon - px) + (lat - py) * (lat - py) q from v),
n as (select pier, line_id, arg_min(lon, (q, seq)) nx, arg_min(lat, (q, seq)) ny, arg_min(lon, seq) ax, arg_min(lat, seq) ay, arg_max(lon, seq) bx, arg_max(lat, seq) by_ from w group by 1, 2),
e as (select *, (bx - nx) * (bx - nx) + (by_ - ny) * (by_ - ny) < (ax - nx) * (ax - nx) + (ay - ny) * (ay - ny) l from n),
f as (select pier, line_id, nx, ny, case when l then bx else ax end ex, case when l then by_ else ay end ey from e),
a as (select pier, line_id, case when {hav('nx', 'ny', 'ex', 'ey')} * 1000 <= 75 then ex else nx end x, case when {hav('nx', 'ny', 'ex', 'ey')} * 1000 <= 75 then ey else ny end y from f),
s as (select a.pier, a.line_id, a.x, a.y, round(sum({hav('a.x', 'a.y', 'b.x', 'b.y')} * 1000), 6) s, max({hav('a.x', 'a.y', 'b.x', 'b.y')} * 1000) m from a join a b using (pier) group by 1, 2, 3, 4),
c as (select pier, arg_min(x, (s, line_id)) x, arg_min(y, (s, line_id)) y, arg_min(m, (s, line_id)) m from s group by 1),
j as (select p.pier, p.lon px, p.lat py, coalesce(x, p.lon) x, coalesce(y, p.lat) y, coalesce(m, 0) m from p left join c using (pier)),
o as (select pier, min({hav('x', 'y', 'lon', 'lat')}) dc, min({hav('px', 'py', 'lon', 'lat')}) dg from j, fx_buildings group by 1)
select pier, case when m > 20 then 'diverged' when {hav('px', 'py', 'x', 'y')} * 1000 < 15 then 'collapsed' when dc < dg then 'suppressed' else 'split' end status, round(x, 6) lon, round(y, 6) lat from j left join o using (pier)""")
def pier_status(spark, d):
    """Stations as piers, with the lines that call there drawn in smaller scales around them, half of them a little to the east; buildings as stops of other modes."""
    k = C("uic").cast("int") % 3
    p = view(spark, d, "fx_stations").select(C("uic").alias("pier"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.when(k == 0, 2.3e-5).when(k == 1, 1.07e-4).otherwise(1.03e-3).alias("k"))
    x = view(spark, d, "fx_line_stops")
    v = p.select("pier", C("lon").alias("px"), C("lat").alias("py"), "k").join(x.select(C("uic").alias("pier"), "line_id").distinct(), "pier").join(x.select("line_id", "seq", "lon", "lat"), "line_id")
    v = v.select("pier", "line_id", "seq", (C("px") + (C("lon") - C("px")) * C("k") + C("pier").cast("int") % 2 * 6e-4).alias("lon"), (C("py") + (C("lat") - C("py")) * C("k")).alias("lat"))
    out = ops.pier_status(p.drop("k"), v, view(spark, d, "fx_buildings"))
    return out.select("pier", "status", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
