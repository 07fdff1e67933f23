"""Queries of joins by distance and of geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.functions.line import urbanness as urban
from linienwerk.operators import spatial as ops
from linienwerk.operators.graph import connected_components
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import hav

C = F.col


def plan(x1, y1, x2, y2):
    """SQL of the planar distance in metres."""
    return f"sqrt(pow(({x2} - {x1}) * 111320 * cos(radians(46.8)), 2) + pow(({y2} - {y1}) * 111320, 2))"


D = plan("a.lon", "a.lat", "b.lon", "b.lat")


@query("fx_stops", f"select a.stop_id a, b.stop_id b from fx_stops a join fx_stops b on a.stop_id < b.stop_id and {D} <= 12005")
def cluster_edges(spark, d):
    return ops.cluster_edges(view(spark, d, "fx_stops"), "stop_id", 12005.0)


@query("fx_stops", f"""with recursive e as (select cast(a.stop_id as bigint) a, cast(b.stop_id as bigint) b from fx_stops a join fx_stops b on a.stop_id <> b.stop_id and {D} <= 7005), r(id, o) as (select cast(stop_id as bigint), cast(stop_id as bigint) from fx_stops union select r.id, e.b from r join e on e.a = r.o) select id, min(o) component from r group by id""")
def station_clusters(spark, d):
    s = view(spark, d, "fx_stops").withColumn("id", C("stop_id").cast("long"))
    e = ops.cluster_edges(s, "id", 7005.0)
    return connected_components(e.select(C("a").alias("src"), C("b").alias("dst")), s)


@query("fx_stations fx_buildings", f"select a.uic, count(*) filter ({D} <= 6001) c_in, count(b.id) c_out from fx_stations a left join fx_buildings b on {D} <= 15003 group by a.uic")
def count_within_radii(spark, d):
    return ops.count_within_radii(view(spark, d, "fx_stations"), view(spark, d, "fx_buildings"), "uic", 6001.0, 15003.0)


@query("fx_stations fx_buildings", f"with c as (select a.uic, count(*) filter ({D} <= 20001) * 5 i, count(b.id) * 4 o from fx_stations a left join fx_buildings b on {D} <= 30003 group by a.uic) select uic, case when o > 600 then 'city' when o > 300 then 'town' when i > 30 then 'village' else 'rural' end bracket from c")
def urbanness(spark, d):
    c = ops.count_within_radii(view(spark, d, "fx_stations"), view(spark, d, "fx_buildings"), "uic", 20001.0, 30003.0)
    return c.select("uic", urban(C("c_in") * 5, C("c_out") * 4).alias("bracket"))


@query("fx_stops", f"with k as (select a.stop_id from_id, b.stop_id to_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} km from fx_stops a join fx_stops b on a.stop_id <> b.stop_id) select from_id, to_id, round(km * 1000, 3) dist_m from k where km <= 11.0")
def walk_candidates(spark, d):
    return ops.walk_matrix(view(spark, d, "fx_stops"), cap_s=10**9).select("from_id", "to_id", "dist_m")


@query("fx_stops", f"with k as (select a.stop_id from_id, b.stop_id to_id, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} km from fx_stops a join fx_stops b on a.stop_id <> b.stop_id) select from_id, to_id, floor(km * 1.3 / 5.1 * 3600)::bigint duration_s from k where km <= 11.0 and floor(km * 1.3 / 5.1 * 3600) <= 7200")
def walk_matrix(spark, d):
    return ops.walk_matrix(view(spark, d, "fx_stops")).select("from_id", "to_id", "duration_s")


KNOWN = "from fx_footpaths where duration_s <= 7200 and from_id in (select stop_id from fx_stops where uic <> '4') and to_id in (select stop_id from fx_stops where uic <> '4')"


def _footpaths(spark, d):
    known = view(spark, d, "fx_stops").where("uic <> '4'")
    f = view(spark, d, "fx_footpaths").where("duration_s <= 7200")
    f = f.join(known.select(C("stop_id").alias("from_id")), "from_id", "left_semi").join(known.select(C("stop_id").alias("to_id")), "to_id", "left_semi")
    return f.select("from_id", "to_id", F.ceil(C("duration_s") / 60).cast("long").alias("minutes"))


@query("fx_footpaths fx_stops", f"select from_id, to_id, ceil(duration_s / 60.0)::bigint as minutes {KNOWN}")
def load_footpaths(spark, d):
    return _footpaths(spark, d)


@query("fx_footpaths fx_stops", f"select to_id from_id, from_id to_id, ceil(duration_s / 60.0)::bigint as minutes {KNOWN}")
def reverse_footpaths(spark, d):
    return _footpaths(spark, d).select(C("to_id").alias("from_id"), C("from_id").alias("to_id"), "minutes")


@query("fx_footpaths fx_stops", f"""with f as (select from_id, to_id, ceil(duration_s / 60.0)::bigint as minutes {KNOWN}), m as (select uic station, stop_id from fx_stops where uic <> '4')
select station, stop_id, min(minutes) as minutes from (select station, to_id stop_id, minutes from m join f on f.from_id = m.stop_id where minutes <= 45 union all select station, stop_id, 0 from m) group by 1, 2""")
def station_offsets(spark, d):
    m = view(spark, d, "fx_stops").where("uic <> '4'").select(C("uic").alias("station"), "stop_id")
    walked = m.join(_footpaths(spark, d).where("minutes <= 45"), m["stop_id"] == C("from_id")).select("station", C("to_id").alias("stop_id"), "minutes")
    return walked.unionByName(m.withColumn("minutes", F.lit(0).cast("long"))).groupBy("station", "stop_id").agg(F.min("minutes").alias("minutes"))


@query("fx_buildings fx_stops", f"select id, stop_id, rank from (select a.id, b.stop_id, row_number() over (partition by a.id order by {D}, b.stop_id) rank from fx_buildings a join fx_stops b on {D} <= 20003) where rank <= 4")
def nearest_targets(spark, d):
    return ops.nearest(view(spark, d, "fx_buildings"), view(spark, d, "fx_stops"), "id", "stop_id", 20003.0, 4).select("id", "stop_id", "rank")


@query("fx_line_stops fx_lines fx_stations", f"""with s as (select distinct uic, line_id from fx_line_stops join fx_lines using (line_id) where mode in ('bus', 'tram'))
select a.uic, count(distinct s.line_id) n from fx_stations a join fx_stations b on {D} <= 30011 join s on s.uic = b.uic where not exists (select 1 from s z where z.uic = a.uic and z.line_id = s.line_id) group by a.uic""")
def nearby_lines(spark, d):
    s = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").where("mode in ('bus', 'tram')").select("line_id"), "line_id").select("uic", "line_id").distinct()
    st = view(spark, d, "fx_stations")
    near = ops.grid_join(st.select("uic", "lon", "lat"), st.select(C("uic").alias("o"), "lon", "lat"), 30011.0).join(s.select(C("uic").alias("o"), "line_id"), "o").select("uic", "line_id").distinct()
    return near.join(s, ["uic", "line_id"], "left_anti").groupBy("uic").agg(F.count("*").alias("n"))


FLAGS = f"f as (select a.line_id, a.seq, exists (select 1 from fx_stations b where {D} <= 4007) flag from fx_line_stops a)"


@query("fx_line_stops fx_stations", f"""with {FLAGS}, x as (select *, max(flag::int) over (partition by line_id order by seq rows between 1 preceding and 1 following) g from f),
y as (select *, case when g = 1 and coalesce(lag(g) over (partition by line_id order by seq), 0) = 0 then 1 else 0 end nw from x), z as (select *, sum(nw) over (partition by line_id order by seq) run from y)
select line_id, run::bigint run, min(seq) "from", max(seq) "to" from z where g = 1 group by 1, 2 having min(seq) < max(seq)""")
def clip_runs(spark, d):
    v = view(spark, d, "fx_line_stops").select("line_id", "seq", "lon", "lat")
    near = ops.grid_join(v, view(spark, d, "fx_stations").select("lon", "lat"), 4007.0).select("line_id", "seq").distinct().withColumn("flag", F.lit(True))
    return ops.clip_runs(v.join(near, ["line_id", "seq"], "left").withColumn("flag", F.coalesce("flag", F.lit(False))), "line_id")


@query("fx_line_stops fx_stations", f"with {FLAGS} select line_id, count(*) n from f where flag group by 1")
def clip_to_buffers(spark, d):
    v = view(spark, d, "fx_line_stops").select("line_id", "seq", "lon", "lat")
    near = ops.grid_join(v, view(spark, d, "fx_stations").select("lon", "lat"), 4007.0)
    return near.select("line_id", "seq").distinct().groupBy("line_id").agg(F.count("*").alias("n"))


@query("fx_line_stops fx_lines", f"""with s as (select x.line_id, seq i, mode, lon, lat from fx_line_stops x join fx_lines using (line_id)),
n as (select a.line_id, a.i, b.line_id o, case a.mode when 'train' then 20011 else 14007 end r, min({D}) m from s a join s b on a.line_id <> b.line_id and ((a.mode = 'train' and b.mode = 'train') or (a.mode in ('bus', 'tram') and b.mode in ('bus', 'tram', 'train'))) and {D} <= case a.mode when 'train' then 20011 else 14007 end group by all),
p as (select line_id, i, sum(1 - m / r) c from n group by all) select line_id, round(avg(coalesce(c, 0)), 6) competition from s left join p using (line_id, i) group by 1""")
def line_competition(spark, d):
    s = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").select("line_id", "mode"), "line_id").select("line_id", C("seq").alias("i"), "mode", "lon", "lat")
    c = ops.line_competition(s, F.when(C("mode") == "train", 20011.0).otherwise(14007.0), 20011.0, {"train": ["train"], "bus": ["bus", "tram", "train"], "tram": ["bus", "tram", "train"]})
    return c.select("line_id", F.round("competition", 6).alias("competition"))


SEG = f"""c as (select line_id, seq, lon, lat, sum(coalesce(hop, 0)) over (partition by line_id order by seq) * 1000 m from (select *, {hav('lag(lon) over (partition by line_id order by seq)', 'lag(lat) over (partition by line_id order by seq)', 'lon', 'lat')} hop from fx_line_stops)),
g as (select *, lead(m) over w m1, lead(lon) over w x1, lead(lat) over w y1, max(m) over (partition by line_id) l from c window w as (partition by line_id order by seq))"""


@query("fx_line_stops", f"""with {SEG}, n as (select line_id, greatest(1, floor(any_value(l) / 20000.0))::bigint n from g group by 1), i as (select line_id, n, unnest(range(n)) i from n)
select i.line_id, i.i, round(lon + ((i.i + 0.5) / n * l - m) / (m1 - m) * (x1 - lon), 6) lon, round(lat + ((i.i + 0.5) / n * l - m) / (m1 - m) * (y1 - lat), 6) lat from i join g on g.line_id = i.line_id and m1 > m and (i.i + 0.5) / n * l >= m and (i.i + 0.5) / n * l < m1""")
def sample_polyline(spark, d):
    return ops.sample_polyline(view(spark, d, "fx_line_stops"), "line_id", 20000.0).select("line_id", "i", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("fx_line_stops fx_stations", f"""with {SEG}, p as (select distinct x.line_id l_id, s.uic, s.lon px, s.lat py from fx_line_stops x join fx_stations s using (uic)), j as (select p.*, g.*, cos(radians(46.8)) k from p join g on g.line_id = l_id and m1 is not null),
t as (select *, case when pow((x1 - lon) * k, 2) + pow(y1 - lat, 2) > 0 then greatest(0.0, least(1.0, ((px - lon) * k * (x1 - lon) * k + (py - lat) * (y1 - lat)) / (pow((x1 - lon) * k, 2) + pow(y1 - lat, 2)))) else 0 end t from j),
e as (select *, {plan('px', 'py', '(lon + t * (x1 - lon))', '(lat + t * (y1 - lat))')} dd from t)
select uic, line_id, round(min_by(m + t * (m1 - m), (round(dd, 6), seq)), 2) t_m, round(min_by(dd, (round(dd, 6), seq)), 2) dist_m from e group by 1, 2""")
def project_on_line(spark, d):
    pts = view(spark, d, "fx_line_stops").select("line_id", "uic").distinct().join(view(spark, d, "fx_stations").select("uic", "lon", "lat"), "uic")
    p = ops.project_on_line(pts, view(spark, d, "fx_line_stops"), "uic", "line_id")
    return p.select("uic", "line_id", F.round("t_m", 2).alias("t_m"), F.round("dist_m", 2).alias("dist_m"))


@query("", """with r as (select s_suppkey id, s_suppkey * 7.0 % 50 cx, s_suppkey * 3.0 % 40 cy, 2.2 + s_suppkey % 5 r from supplier),
c as (select unnest(range(-10, 70)) x), g as (select a.x, b.x y from c a, c b) select distinct g.x cx, g.y cy from r join g on abs(g.x + 0.5 - r.cx) + abs(g.y + 0.5 - r.cy) < r.r""")
def rasterise_polygons(spark, d):
    s = view(spark, d, "supplier")
    x, y, r = C("s_suppkey") * 7.0 % 50, C("s_suppkey") * 3.0 % 40, 2.2 + C("s_suppkey") % 5
    pts = F.array(F.struct((x - r).alias("x"), y.alias("y")), F.struct(x.alias("x"), (y - r).alias("y")), F.struct((x + r).alias("x"), y.alias("y")), F.struct(x.alias("x"), (y + r).alias("y")))
    rings = s.select(C("s_suppkey").alias("id"), F.posexplode(pts).alias("seq", "p")).select("id", "seq", "p.x", "p.y")
    return ops.rasterise_polygons(rings, 1.0)


@query("fx_stops", f"with p as (select a.uic, a.stop_id, round(sum({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}), 6) s, max({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}) m from fx_stops a join fx_stops b using (uic) group by all) select uic, min_by(stop_id, (s, stop_id)) stop_id, round(min_by(m, (s, stop_id)), 6) max_km from p group by 1")
def medoid(spark, d):
    return ops.medoid(view(spark, d, "fx_stops"), "uic", "stop_id").select("uic", "stop_id", F.round("max_km", 6).alias("max_km"))


@query("fx_stops", "select uic, round(avg(lon), 6) lon, round(avg(lat), 6) lat from fx_stops group by uic")
def cluster_centroid(spark, d):
    return view(spark, d, "fx_stops").groupBy("uic").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


@query("fx_line_stops", "select line_id, round(min(lon), 5) w, round(min(lat), 5) s, round(max(lon), 5) e, round(max(lat), 5) n from fx_line_stops group by 1")
def group_bbox(spark, d):
    return view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.round(F.min("lon"), 5).alias("w"), F.round(F.min("lat"), 5).alias("s"), F.round(F.max("lon"), 5).alias("e"), F.round(F.max("lat"), 5).alias("n"))


@query("fx_line_stops", "select line_id id, round((min(lon) + max(lon)) / 2, 6) lon, round((min(lat) + max(lat)) / 2, 6) lat from fx_line_stops group by 1")
def geometry_centre(spark, d):
    g = view(spark, d, "fx_line_stops").groupBy(C("line_id").alias("id")).agg(F.collect_list(F.struct("lon", "lat")).alias("c"))
    mid = lambda k: F.round((F.array_min(F.transform("c", lambda x: x[k])) + F.array_max(F.transform("c", lambda x: x[k]))) / 2, 6).alias(k)
    return g.select("id", mid("lon"), mid("lat"))


PLATFORMS = """pl as (select cast(p_partkey % 25 as varchar) uic, case when p_partkey % 2 = 0 then cast(p_partkey % 7 as varchar) || 'AB' else cast(p_partkey % 5 as varchar) end ref, lon + (p_partkey % 11 - 5) * 0.0006 lon, lat + (p_partkey % 13 - 6) * 0.0004 lat from part join fx_stations on uic = cast(p_partkey % 25 as varchar)),
idn as (select stop_id, uic, cast(cast(stop_id as bigint) % 5 as varchar) track, case when cast(stop_id as bigint) % 3 = 0 then cast(cast(stop_id as bigint) % 7 as varchar) || 'AB' end sector from fx_stops)"""


@query("fx_stops fx_stations", f"""with {PLATFORMS}, c as (select stop_id, uic, sector ref, 0 r from idn where sector is not null union all select stop_id, uic, track, 1 from idn),
s as (select x.stop_id, x.lon, x.lat, coalesce(a.lon, x.lon) ax, coalesce(a.lat, x.lat) ay from fx_stops x left join fx_stations a on a.uic = x.uic and cast(x.stop_id as bigint) % 8 <> 0),
j as (select s.stop_id, pl.lon px, pl.lat py, r, sqrt(pow((ax - pl.lon) * 111320 * cos(radians(ay)), 2) + pow((ay - pl.lat) * 111320, 2)) m from s join c using (stop_id) join pl using (uic, ref)),
b as (select stop_id, arg_min(px, (r, m, px, py)) px, arg_min(py, (r, m, px, py)) py from j where m < 250 group by 1)
select stop_id, round(coalesce(px, lon), 6) lon, round(coalesce(py, lat), 6) lat, px is not null snapped from s left join b using (stop_id)""")
def snap_platforms(spark, d):
    from linienwerk.operators.feed import snap_platforms as snap

    k = C("stop_id").cast("long")
    st = view(spark, d, "fx_stations").select("uic", "lon", "lat")
    stops = view(spark, d, "fx_stops").select("stop_id", F.when(k % 8 != 0, C("uic")).alias("parent"), "lon", "lat")
    identity = view(spark, d, "fx_stops").select("stop_id", "uic", (k % 5).cast("string").alias("track"), F.when(k % 3 == 0, F.concat((k % 7).cast("string"), F.lit("AB"))).alias("sector"))
    p = C("p_partkey")
    ref = F.when(p % 2 == 0, F.concat((p % 7).cast("string"), F.lit("AB"))).otherwise((p % 5).cast("string"))
    platforms = view(spark, d, "part").select((p % 25).cast("string").alias("uic"), ref.alias("ref"), p.alias("p")).join(st, "uic").select("uic", "ref", (C("lon") + (C("p") % 11 - 5) * 0.0006).alias("lon"), (C("lat") + (C("p") % 13 - 6) * 0.0004).alias("lat"))
    out = snap(stops, identity, platforms, st.withColumnRenamed("uic", "parent"))
    return out.select("stop_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "snapped")
