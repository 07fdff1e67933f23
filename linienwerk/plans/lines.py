"""Queries of line groups, sequences and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import lines as ops
from linienwerk.operators.graph import connected_components
from linienwerk.plans.fixtures import dealt, parts, trips, view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import hav

C = F.col


def _station_times(spark, d):
    return view(spark, d, "fx_stop_times").join(view(spark, d, "fx_stops").select("stop_id", "uic"), "stop_id").select("trip_id", "uic")


@query("fx_stop_times fx_stops", "select trip_id, list_sort(list_distinct(list(uic))) stations from fx_stop_times join fx_stops using (stop_id) group by 1")
def pattern_set(spark, d):
    return ops.pattern_set(_station_times(spark, d))


STOPSETS = "m as (select distinct t.trip_id, t.route_id * 1000 + t.dep0 % 3 part, x.stop_id from fx_stop_times x join fx_trips t using (trip_id))"


def _parts(spark, d):
    t = trips(spark, d).select("trip_id", (C("route_id") * 1000 + C("dep0") % 3).alias("part"))
    return t, view(spark, d, "fx_stop_times").select("trip_id", C("stop_id").alias("uic"))


@query("fx_stop_times fx_trips", f"""with recursive {STOPSETS}, e as (select a.trip_id a, b.trip_id b from m a join m b on a.part = b.part and a.stop_id = b.stop_id and a.trip_id <> b.trip_id group by 1, 2 having count(*) >= 2),
same as (select a.trip_id a, b.trip_id b from (select trip_id, any_value(part) part, list_sort(list(stop_id)) s from m group by 1) a join (select trip_id, any_value(part) part, list_sort(list(stop_id)) s from m group by 1) b on a.part = b.part and a.s = b.s and a.trip_id <> b.trip_id),
l as (select * from e union select * from same), r(id, o) as (select distinct trip_id, trip_id from m union select r.id, l.b from r join l on l.a = r.o), c as (select id, min(o) component from r group by 1)
select id trip_id, component, tg_id from c join (select component, substr(sha256(string_agg(stop_id, ',' order by stop_id)), 1, 8) tg_id from (select distinct component, stop_id from c join m on m.trip_id = c.id) group by 1) using (component)""")
def trip_groups(spark, d):
    t, s = _parts(spark, d)
    return ops.trip_groups(t, s, "part")


@query("fx_stop_times fx_trips", """with recursive m as (select distinct t.route_id * 100 + t.dep0 % 60 tg, t.route_id part, x.stop_id from fx_stop_times x join fx_trips t using (trip_id)),
e as (select distinct a.tg a, b.tg b from m a join m b on a.part = b.part and a.stop_id = b.stop_id and a.tg <> b.tg), n as (select distinct tg id from m), r(id, o) as (select id, id from n union select r.id, e.b from r join e on e.a = r.o) select id, min(o) component from r group by 1""")
def supergroups(spark, d):
    t = trips(spark, d).select("trip_id", (C("route_id") * 100 + C("dep0") % 60).alias("pattern_id"), C("route_id").alias("part"))
    m = view(spark, d, "fx_stop_times").join(t, "trip_id").select("part", "pattern_id", C("stop_id").alias("station"))
    return ops.sharing_components(m, "part", 1)


@query("fx_stop_times fx_trips", f"""with recursive {STOPSETS}, e as (select a.trip_id a, b.trip_id b from m a join m b on a.part = b.part and a.stop_id = b.stop_id and a.trip_id <> b.trip_id group by 1, 2 having count(*) >= 2),
n as (select distinct trip_id id from m), r(id, o) as (select id, id from n union select r.id, e.b from r join e on e.a = r.o) select id, min(o) component from r group by 1""", name="connected_components")
def components(spark, d):
    t, s = _parts(spark, d)
    m = s.join(t, "trip_id").select("part", C("trip_id").alias("pattern_id"), C("uic").alias("station"))
    return ops.sharing_components(m, "part", 2)


@query("fx_stop_times fx_trips", f"with {STOPSETS} select a.trip_id a, b.trip_id b, count(*) n from m a join m b on a.part = b.part and a.stop_id = b.stop_id and a.trip_id < b.trip_id group by 1, 2")
def shared_stations(spark, d):
    t, s = _parts(spark, d)
    n = parts(spark, d)
    m = dealt(s.join(t, "trip_id"), n, "uic", "part").distinct()
    o = m.select(C("trip_id").alias("b"), "uic", "part")
    two = m.join(o, ["uic", "part"]).where("trip_id < b").select(C("trip_id").alias("a"), "b")
    return dealt(two, n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("fx_trips fx_stop_times", "select route_id, arg_max(trip_id, (n, -trip_id)) trip_id from (select route_id, trip_id, count(*) n from fx_trips join fx_stop_times using (trip_id) group by 1, 2) group by 1")
def canonical_trip(spark, d):
    n = view(spark, d, "fx_stop_times").groupBy("trip_id").agg(F.count("*").alias("n"))
    t = trips(spark, d).select("trip_id", "route_id").join(n, "trip_id")
    return ops.canonical_trip(t, "route_id", C("n")).select("route_id", "trip_id")


@query("fx_trips fx_stop_times", """with p as (select t.route_id, t.trip_id, t.dep0 % 50 weight, t.service_id % 9 as days, list_sort(list_distinct(list(cast(cast(stop_id as int) % 4 as varchar)))) s from fx_trips t join fx_stop_times using (trip_id) group by all),
b as (select route_id, s, row_number() over (partition by route_id order by sum(weight) desc, min(trip_id)) k from p group by 1, 2)
select route_id, arg_min(trip_id, (-days, trip_id)) trip_id from p join b using (route_id, s) where k = 1 group by 1""")
def representative_trip(spark, d):
    s = view(spark, d, "fx_stop_times").select("trip_id", (C("stop_id").cast("int") % 4).cast("string").alias("uic"))
    t = trips(spark, d).select("route_id", "trip_id", (C("dep0") % 50).alias("weight"), (C("service_id") % 9).alias("days"))
    return ops.representative_trip(ops.pattern_set(s).join(t, "trip_id"), ["route_id"])


@query("fx_trips", """with x as (select route_id, trip_id, row_number() over (partition by route_id order by dep0 % 100, trip_id) k, trip_id % 60 = 7 has from fx_trips) select route_id, min_by(trip_id, k) filter (has) shape_id from x where k <= 51 group by 1""")
def shape_fallback(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("route_id").orderBy(C("dep0") % 100, "trip_id"))
    t = view(spark, d, "fx_trips").withColumn("k", k).where("k <= 51")
    return t.groupBy("route_id").agg(F.min_by(F.when(C("trip_id") % 60 == 7, C("trip_id")), F.when(C("trip_id") % 60 == 7, C("k"))).alias("shape_id"))


HOP = hav("lag(lon) over w", "lag(lat) over w", "lon", "lat")


@query("fx_line_stops", f"select line_id, seq, row_number() over w = 1 is_first, lead(seq) over w is null is_last, round(sum(coalesce(hop, 0)) over w, 6) cum_km from (select *, {HOP} hop from fx_line_stops window w as (partition by line_id order by seq)) window w as (partition by line_id order by seq)")
def first_last_flags(spark, d):
    return ops.first_last_flags(view(spark, d, "fx_line_stops")).select("line_id", "seq", "is_first", "is_last", F.round("cum_km", 6).alias("cum_km"))


@query("fx_stop_times fx_stops", f"select trip_id, round(sum(coalesce(hop, 0)), 5) km from (select trip_id, {hav('lag(lon) over w', 'lag(lat) over w', 'lon', 'lat')} hop from fx_stop_times join fx_stops using (stop_id) window w as (partition by trip_id order by seq)) group by 1")
def polyline_length(spark, d):
    v = view(spark, d, "fx_stop_times").join(view(spark, d, "fx_stops").select("stop_id", "lon", "lat"), "stop_id")
    return ops.polyline_length(v, "trip_id").select("trip_id", F.round("km", 5).alias("km"))


@query("fx_line_stops", f"select line_id, round(max(hop), 6) km from (select line_id, {HOP} hop from fx_line_stops window w as (partition by line_id order by seq)) group by 1")
def longest_gap(spark, d):
    return ops.longest_gap(view(spark, d, "fx_line_stops")).select("line_id", F.round("km", 6).alias("km"))


@query("fx_line_stops", f"select a.line_id, round(max({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}), 6) km from fx_line_stops a join fx_line_stops b using (line_id) group by 1")
def line_spread(spark, d):
    return ops.line_spread(view(spark, d, "fx_line_stops")).select("line_id", F.round("km", 6).alias("km"))


@query("fx_line_stops", f"""with x as (select *, (dep - arr > 100 and lag(seq) over w is not null and lead(seq) over w is not null)::int cut from fx_line_stops window w as (partition by line_id order by seq)),
y as (select *, coalesce(sum(cut) over (partition by line_id order by seq rows between unbounded preceding and 1 preceding), 0) seg from x), z as (select *, {hav('lag(lon) over w', 'lag(lat) over w', 'lon', 'lat')} hop from y window w as (partition by line_id, seg order by seq)),
s as (select line_id, seg, sum(coalesce(hop, 0)) km, max_by(arr, seq) - min_by(dep, seq) sec from z group by 1, 2) select line_id, round(avg(km / sec * 3600), 1) km_h from s where sec > 0 group by 1""")
def segment_speed(spark, d):
    return ops.segment_speed(view(spark, d, "fx_line_stops"), "line_id", 100)


@query("fx_line_stops", f"""with x as (select line_id, seq, stop_name, lon, lat, cast(uic as int) % 3 u, first_value(cast(uic as int) % 3) over w u0, last_value(cast(uic as int) % 3) over w u1, first_value(lon) over w x0, first_value(lat) over w y0 from fx_line_stops window w as (partition by line_id order by seq rows between unbounded preceding and unbounded following))
select line_id, arg_max(seq, (round({hav('lon', 'lat', 'x0', 'y0')}, 6), -seq)) seq, arg_max(stop_name, (round({hav('lon', 'lat', 'x0', 'y0')}, 6), -seq)) as name from x where u0 = u1 and u <> u0 group by 1""")
def loop_apex(spark, d):
    return ops.loop_apex(view(spark, d, "fx_line_stops").withColumn("uic", (C("uic").cast("int") % 3)))


@query("fx_lines", "select line_id, case when max(c) over w = min(c) over w then 1.0 else round(1 - (c - min(c) over w) / (max(c) over w - min(c) over w), 6) end salience from (select *, (line_id * 53 % 89)::double / 10 c from fx_lines) window w as (partition by mode)")
def salience_minmax(spark, d):
    s = ops.salience_minmax(view(spark, d, "fx_lines").withColumn("competition", (C("line_id") * 53 % 89) / 10))
    return s.select("line_id", F.round("salience", 6).alias("salience"))


@query("fx_lines", "select line_id from (select line_id, row_number() over (partition by mode order by line_id * 53 % 89 desc, score desc, line_id) k, greatest(1, round_even(count(*) over (partition by mode) * 0.3, 0)) n from fx_lines) where k <= n")
def salience_top_share(spark, d):
    return ops.salience_top_share(view(spark, d, "fx_lines").withColumn("salience", (C("line_id") * 53 % 89).cast("double")), 0.3).select("line_id")


SPAN = "v as (select t.route_id line_id, t.trip_id, min(x.seq) a, max(x.seq) b from fx_stop_times x join fx_trips t using (trip_id) group by 1, 2)"


def _ends(spark, d):
    """Both ends of each trip, with the trip's place in the order of departures."""
    t = trips(spark, d).select("trip_id", C("route_id").alias("line_id"), "dep0")
    s = view(spark, d, "fx_stop_times").groupBy("trip_id").agg(F.min_by("stop_id", "seq").alias("a"), F.max_by("stop_id", "seq").alias("b"))
    name = view(spark, d, "fx_stops").select(C("stop_id").alias("end"), C("uic").alias("name"))
    e = s.join(t, "trip_id").select("line_id", F.explode(F.array(F.struct((C("dep0") * 1000000 + C("trip_id")).alias("o"), F.lit(0).alias("k"), C("a").alias("end")), F.struct((C("dep0") * 1000000 + C("trip_id")).alias("o"), F.lit(1).alias("k"), C("b").alias("end")))).alias("x"))
    return e.select("line_id", (C("x.o") * 2 + C("x.k")).alias("ord"), "x.end").join(name, "end").select("line_id", "ord", "name")


@query("fx_line_stops fx_lines fx_trips fx_stop_times fx_stops", f"""with {SPAN}, e as (select v.line_id, (t.dep0 * 1000000 + v.trip_id) * 2 + k o, s.uic n from v join fx_trips t using (trip_id), (values (0), (1)) z(k) join fx_stop_times x on x.trip_id = v.trip_id and x.seq = case k when 0 then v.a else v.b end join fx_stops s using (stop_id)),
r as (select line_id, list(n order by o) x from (select line_id, n, min(o) o from e group by 1, 2) group by 1), b as (select line_id, min(lon) w, min(lat) s, max(lon) e, max(lat) n from fx_line_stops group by 1),
c as (select route_id line_id, count(distinct service_id) service from fx_trips group by 1)
select line_id, ref, mode, case when len(x) = 2 then array_to_string(x, ' ↔ ') else array_to_string(x, ' · ') end route, w, s, e, n, service from fx_lines join r using (line_id) join b using (line_id) join c using (line_id)""")
def line_index(spark, d):
    s = view(spark, d, "fx_line_stops")
    box = s.groupBy("line_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    service = view(spark, d, "fx_trips").groupBy(C("route_id").alias("line_id")).agg(F.count_distinct("service_id").alias("service"))
    return ops.line_index(view(spark, d, "fx_lines").select("line_id", "ref", "mode"), _ends(spark, d), box, service)


@query("fx_lines fx_trips", "select route_id % 50 key, min_by(colour, route_id) colour from fx_lines join (select distinct route_id from fx_trips) on route_id = line_id group by 1")
def route_colour_index(spark, d):
    t = view(spark, d, "fx_trips").select("route_id").distinct().join(view(spark, d, "fx_lines"), C("route_id") == C("line_id"))
    return t.groupBy((C("route_id") % 50).alias("key")).agg(F.min_by("colour", "route_id").alias("colour"))


@query("fx_line_stops", "select distinct a.line_id line_a, b.line_id line_b from fx_line_stops a join fx_line_stops b on a.stop_id = b.stop_id and a.line_id < b.line_id")
def lines_sharing_cluster(spark, d):
    s = view(spark, d, "fx_line_stops").select("line_id", "stop_id").distinct()
    return s.join(s.select(C("line_id").alias("line_b"), "stop_id"), "stop_id").where("line_id < line_b").select(C("line_id").alias("line_a"), "line_b").distinct()


@query("fx_line_stops fx_lines", """with recursive m as (select distinct line_id, stop_id from fx_line_stops join fx_lines using (line_id) where mode = 'train' or mode = 'tram'), e as (select distinct a.line_id a, b.line_id b from m a join m b using (stop_id) where a.line_id <> b.line_id),
r(id, o) as (select line_id, line_id from m union select r.id, e.b from r join e on e.a = r.o), c as (select id, min(o) comp from r group by 1), n as (select comp, count(*) n from c group by 1) select id line_id from c where comp = (select comp from n order by n desc, comp limit 1)""")
def intercity_base(spark, d):
    m = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").where("mode in ('train', 'tram')").select("line_id"), "line_id").select(F.lit(0).alias("part"), C("line_id").alias("pattern_id"), C("stop_id").alias("station"))
    c = ops.sharing_components(m, "part", 1)
    best = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(best.select("component")), "component").select(C("id").alias("line_id"))


@query("fx_stops", """with recursive e as (select a.s a, b.s b from (select cast(stop_id as bigint) s, uic, cast(stop_id as int) % 40 p from fx_stops) a join (select cast(stop_id as bigint) s, uic, cast(stop_id as int) % 40 p from fx_stops) b on (a.uic = b.uic or a.p = b.p) and a.s <> b.s and a.s % 3 <> 0 and b.s % 3 <> 0),
r(id, o) as (select cast(stop_id as bigint), cast(stop_id as bigint) from fx_stops union select r.id, e.b from r join e on e.a = r.o) select id as member, min(o) cluster from r group by 1""")
def merge_by_parent(spark, d):
    s = view(spark, d, "fx_stops").select(C("stop_id").cast("long").alias("id"), C("uic").alias("cluster"), (C("stop_id").cast("int") % 40).cast("string").alias("parent"))
    some = s.where("id % 3 <> 0")
    # members and the groups that they belong to are the two sides of one graph
    both = some.select("id", F.concat(F.lit("c"), "cluster").alias("g")).union(some.select("id", F.concat(F.lit("p"), "parent")))
    first = both.groupBy("g").agg(F.min("id").alias("src"))
    return connected_components(both.join(first, "g").select("src", C("id").alias("dst")), s).select(C("id").alias("member"), C("component").alias("cluster"))


@query("fx_line_stops", "select component, round(sum(n * z) / sum(n)::double, 6) z from (select line_id % 7 component, line_id % 5 + 4 z, count(*) n from fx_line_stops group by line_id) group by 1")
def weighted_avg_zoom(spark, d):
    n = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.count("*").alias("n")).select((C("line_id") % 7).alias("component"), (C("line_id") % 5 + 4).alias("z"), "n")
    return n.groupBy("component").agg(F.round(F.sum(C("n") * C("z")) / F.sum("n"), 6).alias("z"))


@query("fx_trips fx_lines", "select distinct route_id tg, score from fx_trips join fx_lines on line_id = route_id where route_id not in (select line_id from fx_lines where score > 0.4)")
def unmatched_groups(spark, d):
    g = view(spark, d, "fx_trips").select(C("route_id").alias("tg")).distinct()
    lines = view(spark, d, "fx_lines").select(C("line_id").alias("tg"), "score")
    return g.join(lines, "tg").join(lines.where("score > 0.4").select("tg"), "tg", "left_anti")


@query("fx_line_stops fx_lines", "select line_id, list(uic order by seq) uics, min_by(stop_name, seq) first_name, max_by(stop_name, seq) last_name from fx_line_stops group by 1")
def decode_stops(spark, d):
    s = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "uic"))).alias("s"), F.min_by("stop_name", "seq").alias("first_name"), F.max_by("stop_name", "seq").alias("last_name"))
    return s.select("line_id", F.transform("s", lambda x: x["uic"]).alias("uics"), "first_name", "last_name")


@query("fx_trips", "select distinct route_id, list_sort(list_distinct(list(dep0 % 9))) ids from fx_trips group by route_id")
def route_ids_per_variant(spark, d):
    return view(spark, d, "fx_trips").groupBy("route_id").agg(F.array_sort(F.collect_set(C("dep0") % 9)).alias("ids"))


@query("fx_line_stops fx_lines", """with f as (select a.line_id, min_by(uic, seq) u0, max_by(uic, seq) u1 from fx_line_stops a join fx_lines using (line_id) where mode = 'mountain' group by 1), need as (select * from f x where not exists (select 1 from f y where y.u0 = x.u1 and y.u1 = x.u0))
select -line_id line_id, row_number() over (partition by line_id order by seq desc) seq, stop_id from fx_line_stops where line_id in (select line_id from need)""")
def add_reverse_lines(spark, d):
    from pyspark.sql import Window

    s = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").where("mode = 'mountain'").select("line_id"), "line_id")
    f = s.groupBy("line_id").agg(F.min_by("uic", "seq").alias("u0"), F.max_by("uic", "seq").alias("u1"))
    need = f.join(f.select(C("u1").alias("u0"), C("u0").alias("u1")), ["u0", "u1"], "left_anti").select("line_id")
    return s.join(need, "line_id").select((-C("line_id")).alias("line_id"), F.row_number().over(Window.partitionBy("line_id").orderBy(F.desc("seq"))).alias("seq"), "stop_id")
