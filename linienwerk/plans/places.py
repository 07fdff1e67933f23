"""Queries on names of places, directions at stations, codes and shapes of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import feed, places as ops
from linienwerk.plans.fixtures import trips, view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import hav

C = F.col

FOUND = """f as (select place_id, case when place_id % 7 > 0 then name end as name, case when place_id % 3 = 0 then 'Street' || place_id % 11 end street, case when place_id % 2 = 0 then cast(place_id % 50 as varchar) end housenumber,
case when place_id % 5 > 1 then 'City' || place_id % 4 when place_id % 5 = 1 then '' end city, case when place_id % 5 = 0 then 'County' else '' end county, 'State' as state, ['shop', 'highway', 'building', 'place'][place_id % 4 + 1] osm_key, lon, lat from fx_places),
l as (select *, coalesce(nullif(city, ''), nullif(county, ''), nullif(state, '')) c, street || coalesce(' ' || housenumber, '') st from f)"""


def _found(spark, d):
    p, k = view(spark, d, "fx_places"), C("place_id")
    key = F.get(F.array(*[F.lit(x) for x in ("shop", "highway", "building", "place")]), (k % 4).cast("int"))
    text = lambda c: c.cast("string")
    return p.select("place_id", F.when(k % 7 > 0, C("name")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("Street"), text(k % 11))).alias("street"), F.when(k % 2 == 0, text(k % 50)).alias("housenumber"),
                    F.when(k % 5 > 1, F.concat(F.lit("City"), text(k % 4))).when(k % 5 == 1, "").alias("city"), F.when(k % 5 == 0, "County").otherwise("").alias("county"), F.lit("State").alias("state"), key.alias("osm_key"), "lon", "lat")


@query("fx_places", f"""with {FOUND}, x as (select place_id, c, case when osm_key = 'shop' and name is not null then name when street is not null then st else name end a, case when osm_key = 'shop' and name is not null then 'poi' when street is not null then 'address' when name is null then null when osm_key = 'highway' then 'address' else 'place' end kind from l)
select place_id, kind, case when a = c then a else a || ', ' || c end label from x""")
def place_label(spark, d):
    return _found(spark, d).select("place_id", ops.place_label().alias("p")).select("place_id", "p.kind", "p.label")


@query("fx_places", f"""with {FOUND}, x as (select place_id // 5 q_id, place_id % 5 ord, *, lon + (place_id % 9 - 4) * 0.0004 px, lat + 0.0003 py, place_id % 2 = 0 boxed from l), q as (select q_id, px qx, py qy from x where ord = 0),
m as (select x.*, {hav('lon', 'lat', 'qx', 'qy')} * 1000 dd, boxed and qx between lon - 0.001 and lon + 0.001 and qy between lat - 0.001 and lat + 0.001 inb from x join q using (q_id)),
y as (select q_id, ord, case when dd <= 60 or (inb and dd <= 200) then case when street is not null then st when osm_key = 'highway' then name end end a, coalesce(name, street) b, c from m)
select q_id, coalesce(arg_min(a || ', ' || c, ord) filter (a is not null), 'Nähe ' || (arg_min(b || ', ' || c, ord) filter (b is not null))) label from y group by 1""")
def reverse_label(spark, d):
    """Five found places to a query, whose point is near the first of them."""
    k = C("place_id")
    f = _found(spark, d).withColumn("q_id", F.floor(k / 5)).withColumn("ord", k % 5)
    box = lambda c, by: F.when(k % 2 == 0, C(c) + by)
    q = f.where("ord = 0").select("q_id", (C("lon") + (k % 9 - 4) * 0.0004).alias("lon"), (C("lat") + 0.0003).alias("lat"))
    return ops.reverse_label(f.withColumns({"w": box("lon", -0.001), "e": box("lon", 0.001), "s": box("lat", -0.001), "n": box("lat", 0.001)}), q)


@query("fx_stop_times fx_trips fx_lines fx_stops", """with recursive a as (select l.ref, l.mode, t.trip_id v, list(x.stop_id order by x.seq) u from fx_stop_times x join fx_trips t using (trip_id) join fx_lines l on l.line_id = t.route_id where t.headway is not null group by 1, 2, 3),
p as (select distinct ref, mode, v, u, unnest(u) uic from a), q as (select *, list_position(u, uic) k from p), t as (select uic, ref, mode, v, u[k + 1:] tail, k = 1 or k = len(u) e from q), z as (select uic, ref, mode, bool_or(e) e from t group by 1, 2, 3), d as (select * from t where len(tail) > 0),
m as (select distinct uic, ref, mode, v, unnest(tail) s from d), g as (select distinct x.uic, x.ref, x.mode, x.v a, y.v b from m x join m y using (uic, ref, mode, s)),
r(uic, ref, mode, id, o) as (select uic, ref, mode, v, v from d union select r.uic, r.ref, r.mode, r.id, g.b from r join g on g.uic = r.uic and g.ref = r.ref and g.mode = r.mode and g.a = r.o), c as (select uic, ref, mode, id v, min(o) comp from r group by 1, 2, 3, 4),
w as (select d.*, comp, tail[-1] la from d join c using (uic, ref, mode, v)), k as (select * from w where not exists (select 1 from w o where o.uic = w.uic and o.ref = w.ref and o.mode = w.mode and o.comp = w.comp and o.v <> w.v and list_contains(o.tail[:-2], w.la))),
n as (select k.uic, k.ref, k.mode, comp, s.stop_name nm, min(v) o from k join fx_stops s on s.stop_id = la group by all), s as (select uic, ref, mode, comp, string_agg(nm, ' · ' order by o) x, list(nm) names from n group by 1, 2, 3, 4),
j as (select uic, ref, mode, string_agg(x, ' ↔ ' order by comp) x, flatten(list(names)) names from s group by 1, 2, 3)
select j.uic, j.ref, j.mode, case when z.e and not list_contains(names, f.stop_name) then x || ' ↔ ' || f.stop_name else x end as text from j join z using (uic, ref, mode) join fx_stops f on f.stop_id = j.uic""")
def directions_from_station(spark, d):
    """Trips that run at a headway, as the variants of their lines."""
    t = trips(spark, d).where("headway is not null").select("trip_id", C("route_id").alias("line_id"))
    v = view(spark, d, "fx_stop_times").join(t, "trip_id").join(view(spark, d, "fx_lines").select("line_id", "ref", "mode"), "line_id")
    names = view(spark, d, "fx_stops").select(C("stop_id").alias("uic"), C("stop_name").alias("name"))
    return ops.directions_from_station(v.select("ref", "mode", C("trip_id").alias("variant"), "seq", C("stop_id").alias("uic")), names)


@query("", "select p_partkey k, case when p_size % 3 > 0 then cast(p_size as varchar) else '' end code from part")
def track_code(spark, d):
    return view(spark, d, "part").select(C("p_partkey").alias("k"), feed.track_code(F.when(C("p_size") % 3 > 0, C("p_size").cast("string"))).alias("code"))


@query("fx_stop_times fx_trips fx_routes fx_stops", """with s as (select x.trip_id, x.seq, lon, lat, lag(lon) over w pl, lag(lat) over w pa from fx_stop_times x join fx_stops p on p.stop_id = x.stop_id and cast(p.stop_id as bigint) % 31 <> 0 window w as (partition by x.trip_id order by x.seq)),
n as (select trip_id, count(*) n, round(sum(lon), 5) lon from s where pl is null or pl <> lon or pa <> lat group by 1), h as (select x.trip_id, count(*) n, round(sum(lon), 5) lon from fx_stop_times x join fx_stops using (stop_id) where x.trip_id % 6 = 0 group by 1),
j as (select t.trip_id variant, h.n hn, h.lon hl, n.n nn, n.lon nl, route_type from fx_trips t join fx_routes using (route_id) left join h on h.trip_id = t.trip_id left join n on n.trip_id = t.trip_id)
select variant, case when hn is not null then 'shape' when route_type = '1300' then 'straight_line' end source, case when hn is not null then hn when route_type = '1300' then coalesce(nn, 0) else 0 end::int n, coalesce(case when hn is not null then hl when route_type = '1300' then nl end, 0)::double lon,
case when hn is null and route_type <> '1300' then 'unrouted' when coalesce(hn, nn, 0) < 2 then 'too_short' end reason from j""")
def line_geometry(spark, d):
    """Each trip as a variant: a third name a shape, and half of those shapes exist."""
    st = view(spark, d, "fx_stop_times").join(view(spark, d, "fx_stops").select("stop_id", "lon", "lat"), "stop_id")
    v = view(spark, d, "fx_trips").join(view(spark, d, "fx_routes").select("route_id", "route_type"), "route_id").select(C("trip_id").alias("variant"), "route_type", F.when(C("trip_id") % 3 == 0, C("trip_id")).alias("shape_id"))
    shapes = st.where("trip_id % 6 = 0").select(C("trip_id").alias("shape_id"), "seq", "lon", "lat")
    located = C("stop_id").cast("long") % 31 != 0
    g = feed.line_geometry(v, shapes, st.select(C("trip_id").alias("variant"), "seq", F.when(located, C("lon")).alias("lon"), F.when(located, C("lat")).alias("lat")))
    return g.select("variant", "source", F.size("vertices").alias("n"), F.round(F.aggregate("vertices", F.lit(0.0), lambda a, x: a + x["lon"]), 5).alias("lon"), "reason")
