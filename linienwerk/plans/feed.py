"""Queries of feed cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import feed as ops
from linienwerk.plans.fixtures import trips, view
from linienwerk.plans.registry import query

C = F.col
BOX = (5.93, 45.80, 9.80, 47.60)
FOREIGN = "select distinct trip_id from fx_stop_times x left join fx_stops s on s.stop_id = x.stop_id and cast(s.stop_id as int) % 31 <> 0 where s.lon is null or not (lon between 5.93 and 9.80 and lat between 45.8 and 47.6)"


def _foreign(spark, d):
    stops = view(spark, d, "fx_stops").where(C("stop_id").cast("int") % 31 != 0)
    return ops.foreign_trips(view(spark, d, "fx_stop_times"), stops, BOX)


def _routed(spark, d):
    return view(spark, d, "fx_stop_times").join(trips(spark, d).select("trip_id", "route_id"), "trip_id").select("trip_id", "route_id", "seq", "stop_id", "arr", "dep")


@query("fx_stops", """select stop_id, case when stop_id = '5' then 7.5 when stop_id = '3' then 8.25 when uic = '5' then 7.5 when uic = '3' then 8.25 else lon end lon, case when stop_id = '5' then 47.0 when stop_id = '3' then 46.5 when uic = '5' then 47.0 when uic = '3' then 46.5 else lat end lat from fx_stops""")
def apply_stop_overrides(spark, d):
    o = spark.createDataFrame([("5", 7.5, 47.0), ("3", 8.25, 46.5)], "key string, lon double, lat double")
    return ops.apply_stop_overrides(view(spark, d, "fx_stops"), o).select("stop_id", "lon", "lat")


@query("fx_stop_times", "select trip_id, seq, stop_id from fx_stop_times where cast(stop_id as int) % 10 not in (0, 1)")
def drop_synthetic_stops(spark, d):
    n = C("stop_id").cast("int") % 10
    t = view(spark, d, "fx_stop_times").withColumn("sid", F.when(n == 0, F.concat(F.lit("WPT:"), "stop_id")).when(n == 1, F.concat(F.lit("0000"), "stop_id")).otherwise(C("stop_id")))
    return t.where(~F.startswith("sid", F.lit("WPT:")) & ~F.startswith("sid", F.lit("0000"))).select("trip_id", "seq", C("sid").alias("stop_id"))


@query("fx_stop_times fx_stops", FOREIGN)
def foreign_trips(spark, d):
    return _foreign(spark, d)


@query("fx_stop_times fx_stops fx_trips", f"select trip_id, count(*) n from fx_stop_times where trip_id not in ({FOREIGN}) group by trip_id")
def filter_trips(spark, d):
    return ops.filter_trips(view(spark, d, "fx_stop_times"), _foreign(spark, d)).groupBy("trip_id").agg(F.count("*").alias("n"))


@query("fx_transfers fx_routes fx_stop_times fx_stops", f"""with k as (select route_id from fx_routes where agency_id <> 2), f as ({FOREIGN})
select * from fx_transfers where from_route in (select route_id from k) and to_route in (select route_id from k) and (from_trip is null or from_trip not in (select trip_id from f)) and (to_trip is null or to_trip not in (select trip_id from f))""")
def filter_transfers(spark, d):
    return ops.filter_transfers(view(spark, d, "fx_transfers"), view(spark, d, "fx_routes").where("agency_id <> 2"), _foreign(spark, d))


@query("", "with r as (select * from customer where c_custkey in (select o_custkey from orders)) select 'route' kind, c_custkey id from r union all select 'agency', n_nationkey::bigint from nation where n_nationkey in (select c_nationkey from r)")
def cascade_refs(spark, d):
    """Customers as routes: a third has no order, as a trip would be."""
    routes = view(spark, d, "customer").select(C("c_custkey").alias("route_id"), C("c_nationkey").alias("agency_id"))
    agency = view(spark, d, "nation").select(C("n_nationkey").alias("agency_id"))
    r, a = ops.cascade_refs(routes, agency, view(spark, d, "orders").select(C("o_custkey").alias("route_id")))
    return r.select(F.lit("route").alias("kind"), C("route_id").cast("long").alias("id")).unionByName(a.select(F.lit("agency").alias("kind"), C("agency_id").cast("long").alias("id")))


@query("fx_routes", "select route_id, rule from fx_routes join (values (1, '5', 'a'), (2, '9', 'b'), (3, '3', 'c')) r(a, n, rule) on agency_id = a and short_name = n")
def match_overrides(spark, d):
    rules = spark.createDataFrame([(1, "5", "a"), (2, "9", "b"), (3, "3", "c")], "agency_id long, short_name string, rule string")
    return view(spark, d, "fx_routes").join(F.broadcast(rules), ["agency_id", "short_name"]).select("route_id", "rule")


@query("fx_stop_times fx_stops", "select distinct x.trip_id, x.seq, rule from fx_stop_times x left join fx_stops s using (stop_id) join (values ('a', '7'), ('b', '12'), ('c', '99')) r(rule, stop) on stop = x.stop_id or stop = s.uic")
def transfer_stop_match(spark, d):
    rules = spark.createDataFrame([("a", "7"), ("b", "12"), ("c", "99")], "rule string, stop string")
    return ops.transfer_stop_match(view(spark, d, "fx_stop_times"), rules, view(spark, d, "fx_stops"))


@query("fx_stop_times", "select trip_id, row_number() over (partition by trip_id order by seq) seq, stop_id from fx_stop_times where seq % 3 <> 0")
def renumber_sequence(spark, d):
    return ops.renumber_sequence(view(spark, d, "fx_stop_times").where("seq % 3 <> 0")).select("trip_id", "seq", "stop_id")


@query("fx_stop_times fx_trips", """with t as (select x.*, route_id, lead(stop_id) over (partition by x.trip_id order by seq) nx from fx_stop_times x join fx_trips using (trip_id)),
h as (select t.*, row_number() over (partition by trip_id order by seq) k from t where cast(stop_id as int) % 5 = 1 and cast(nx as int) % 5 = 2)
select trip_id, row_number() over (partition by trip_id order by seq) seq, stop_id, arr, dep, synthetic from (select trip_id, seq * 2 seq, '' || cast(cast(stop_id as int) % 5 as varchar) stop_id, arr, dep, false synthetic from t union all select trip_id, seq * 2 + 1, 'WPT:1', dep, dep, true from h where k = 1)""")
def insert_waypoint(spark, d):
    t = _routed(spark, d).withColumn("stop_id", (C("stop_id").cast("int") % 5).cast("string"))
    rules = view(spark, d, "fx_routes").select(F.lit("r1").alias("rule"), "route_id", F.lit("1").alias("after"), F.lit("2").alias("before"), F.lit("WPT:1").alias("waypoint"))
    return ops.insert_waypoint(t, rules).select("trip_id", "seq", "stop_id", "arr", "dep", "synthetic")


SPLIT = """t as (select x.*, route_id from fx_stop_times x join fx_trips using (trip_id)), c as (select trip_id, min(case when cast(stop_id as int) % 5 = 3 then seq end) cut, min(seq) lo, max(seq) hi from t where route_id % 2 = 0 group by 1)"""


@query("fx_stop_times fx_trips", f"""with {SPLIT}, g as (select * from c where cut > lo and cut < hi),
l as (select t.trip_id || '__1' trip_id, seq, stop_id from t join g using (trip_id) where seq <= cut union all select t.trip_id || '__2', seq, stop_id from t join g using (trip_id) where seq >= cut union all select cast(trip_id as varchar), seq, stop_id from t where trip_id not in (select trip_id from g))
select trip_id, row_number() over (partition by trip_id order by seq) seq, cast(cast(stop_id as int) % 5 as varchar) stop_id from l""")
def split_trip(spark, d):
    return _split(spark, d)[0].select("trip_id", "seq", "stop_id")


def _split(spark, d):
    t = _routed(spark, d).withColumn("stop_id", (C("stop_id").cast("int") % 5).cast("string"))
    rules = view(spark, d, "fx_routes").where("route_id % 2 = 0").select("route_id", F.lit("s").alias("rule"), F.lit("3").alias("stop"))
    return ops.split_trip(t, rules)


@query("fx_stop_times fx_trips", f"with {SPLIT} select case when cut is null then 'missing' else 'endpoint' end reason, count(*) n from c where cut is null or cut = lo or cut = hi group by 1")
def split_warnings(spark, d):
    return _split(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("fx_stop_times fx_stops fx_trips fx_routes", f"""select trip_id from (select trip_id from fx_trips join fx_routes using (route_id) where agency_id = 2 union {FOREIGN.replace('select distinct', 'select')})""")
def dropped_trips(spark, d):
    ex = view(spark, d, "fx_trips").join(view(spark, d, "fx_routes").where("agency_id = 2").select("route_id"), "route_id", "left_semi").select("trip_id")
    return ex.union(_foreign(spark, d)).distinct()


@query("fx_stop_times fx_stops fx_trips fx_routes", f"""with f as ({FOREIGN}), x as (select t.trip_id, t.route_id, case when agency_id = 2 then 'agency' when short_name like '3%' then 'ev_route' when f.trip_id is not null then 'foreign' end reason from fx_trips t join fx_routes r using (route_id) left join f using (trip_id))
select route_id, count(*) filter (reason = 'agency') by_agency, count(*) filter (reason = 'ev_route') by_ev_route, count(*) filter (reason = 'foreign') as "foreign" from x where reason is not null group by 1""")
def drop_reasons(spark, d):
    f = _foreign(spark, d).withColumn("f", F.lit(True))
    t = view(spark, d, "fx_trips").join(view(spark, d, "fx_routes"), "route_id").join(f, "trip_id", "left")
    reason = F.when(C("agency_id") == 2, "agency").when(F.startswith("short_name", F.lit("3")), "ev_route").when(C("f"), "foreign")
    return ops.drop_reasons(t.select("route_id", reason.alias("reason")).where("reason is not null"))


@query("", """with s as (select s_suppkey k, s_suppkey - s_suppkey % 4 n from supplier)
select case k % 4 when 0 then 'ch:1:sloid:' || n || ':0:1' when 1 then 'ch:1:sloid:' || n || '_gen:ch:1:sloid:' || n || ':0:1_pf:' || k || 'A-D' when 2 then (8500000 + k) || ':0:1' else 'ch:1:sloid:' || n || '_gen:missingSLOID_pf:' || k || 'AB' end stop_id,
 case k % 4 when 0 then '85' || k % 5 when 1 then '85' || n % 5 when 2 then cast(8500000 + k as varchar) else '' end uic, case k % 4 when 2 then cast(8500000 + k as varchar) else 'ch:1:sloid:' || n end station,
 case k % 4 when 0 then cast(k % 13 as varchar) when 1 then cast(n % 13 as varchar) when 3 then cast(k as varchar) else '' end track, case k % 4 when 1 then k || 'A-D' when 3 then k || 'AB' else '' end sector from s""")
def parse_stop_identity(spark, d):
    s = view(spark, d, "supplier")
    k, n = C("s_suppkey"), (C("s_suppkey") - C("s_suppkey") % 4).cast("string")
    quay = F.concat(F.lit("ch:1:sloid:"), n, F.lit(":0:1"))
    sid = F.when(k % 4 == 0, quay).when(k % 4 == 1, F.concat(F.lit("ch:1:sloid:"), n, F.lit("_gen:"), quay, F.lit("_pf:"), k.cast("string"), F.lit("A-D"))).when(k % 4 == 2, F.concat((8500000 + k).cast("string"), F.lit(":0:1"))).otherwise(F.concat(F.lit("ch:1:sloid:"), n, F.lit("_gen:missingSLOID_pf:"), k.cast("string"), F.lit("AB")))
    rows = s.select(sid.alias("stop_id"), F.when(k % 4 == 0, F.concat(F.lit("85"), (k % 5).cast("string"))).otherwise("").alias("didok"), F.lit("").alias("parent_station"), F.when(k % 4 == 0, (k % 13).cast("string")).alias("platform_code"))
    return ops.parse_stop_identity(rows).select("stop_id", "uic", "station", "track", "sector")


@query("fx_stops", "select stop_id, case when cast(stop_id as int) % 3 = 0 then uic when cast(stop_id as int) % 3 = 1 then 'P' || uic else stop_id end merge_key, case when cast(stop_id as int) % 2 = 0 then 'Q' || stop_id else stop_id end draw_id from fx_stops")
def merge_key(spark, d):
    k = C("stop_id").cast("int")
    uic, parent = F.when(k % 3 == 0, C("uic")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("P"), "uic")).otherwise("")
    return view(spark, d, "fx_stops").select("stop_id", ops.merge_key(uic, parent, C("stop_id")).alias("merge_key"), ops.draw_id(F.when(k % 2 == 0, F.concat(F.lit("Q"), "stop_id")).otherwise(""), C("stop_id")).alias("draw_id"))


@query("fx_stop_times", "select stop_id, case when p_partkey is null then 'no_atlas_match' else 'atlas_match' end status, p_size length from (select distinct stop_id from fx_stop_times) left join part on cast(p_partkey as varchar) = stop_id and p_partkey % 2 = 0")
def match_platform_attributes(spark, d):
    a = view(spark, d, "part").where("p_partkey % 2 = 0").select(C("p_partkey").cast("string").alias("sloid"), C("p_size").alias("length"), F.lit(None).cast("double").alias("compass"))
    return ops.match_platform_attributes(view(spark, d, "fx_stop_times"), a).select("stop_id", "status", "length")


@query("fx_trips fx_routes", "select trip_id, short_name, agency_id, service_id, t.route_id from fx_trips t join fx_routes r on r.route_id = t.route_id where route_type <> '1000'")
def join_trip_routes(spark, d):
    from linienwerk.functions.line import route_bucket

    r = view(spark, d, "fx_routes").withColumn("bucket", route_bucket(C("route_type"))).where("bucket <> 'ferry'")
    return view(spark, d, "fx_trips").join(r, "route_id").select("trip_id", "short_name", "agency_id", "service_id", "route_id")


@query("fx_stops", "select stop_id id, stop_name as name, uic, lon, lat from fx_stops union all select 'u' || uic, arg_min(stop_name, cast(stop_id as int)), uic, arg_min(lon, cast(stop_id as int)), arg_min(lat, cast(stop_id as int)) from fx_stops group by uic")
def stop_meta(spark, d):
    s = view(spark, d, "fx_stops").select(C("stop_id").alias("id"), C("stop_name").alias("name"), "uic", "lon", "lat")
    first = s.groupBy("uic").agg(F.min_by(F.struct("name", "lon", "lat"), C("id").cast("int")).alias("f")).select(F.concat(F.lit("u"), "uic").alias("id"), "f.name", "uic", "f.lon", "f.lat")
    return s.unionByName(first)


@query("fx_footpaths fx_stops", """with done as (select cast(s_suppkey as varchar) id from supplier where s_acctbal > 0) select 'kept' kind, from_id, count(*) n from fx_footpaths where from_id in (select id from done) group by from_id
 union all select 'todo', stop_id, 0 from fx_stops where stop_id not in (select id from done)""")
def resume_matrix(spark, d):
    done = view(spark, d, "supplier").where("s_acctbal > 0").select(C("s_suppkey").cast("string").alias("from_id"))
    kept, todo = ops.resume_matrix(done, view(spark, d, "fx_footpaths"), view(spark, d, "fx_stops").select(C("stop_id").alias("from_id")))
    kept = kept.groupBy("from_id").agg(F.count("*").alias("n")).select(F.lit("kept").alias("kind"), "from_id", "n")
    return kept.unionByName(todo.select(F.lit("todo").alias("kind"), "from_id", F.lit(0).cast("long").alias("n")))


@query("", """with o as (select o_custkey share_id, o_orderkey v, o_orderstatus = 'F' old from orders), e as (select share_id, max(v) v from o where old group by 1), i as (select share_id, min(v) v from o where not old group by 1)
select share_id, v from e union all select share_id, v from i where share_id not in (select share_id from e)""")
def upsert_shares(spark, d):
    o = view(spark, d, "orders").select(C("o_custkey").alias("share_id"), C("o_orderkey").alias("v"), (C("o_orderstatus") == "F").alias("old"))
    old = o.where("old").groupBy("share_id").agg(F.max("v").alias("v"))
    return ops.upsert_shares(old, o.where("not old").select("share_id", "v"), "share_id", C("v"))


@query("", "select o_orderkey id from orders where o_orderstatus <> 'F'")
def delete_shares(spark, d):
    o = view(spark, d, "orders").select(C("o_orderkey").alias("id"), "o_orderstatus")
    return o.select("id").join(o.where("o_orderstatus = 'F'").select("id"), "id", "left_anti")


@query("", "select count(*) n, count(*) >= 200 ok from part where p_size > 3")
def expect_min_rows(spark, d):
    n = view(spark, d, "part").agg(F.count_if(C("p_size") > 3).alias("n"))
    return n.select("n", F.when(C("n") >= 200, True).otherwise(F.raise_error(F.lit("too few rows"))).cast("boolean").alias("ok"))


@query("fx_places", "select id, any_value(name) as name from (select cast(place_id % 500 as varchar) id, first_value(name) over (partition by place_id % 500 order by place_id) as name from fx_places) group by id")
def dedup_features(spark, d):
    p = view(spark, d, "fx_places").withColumn("id", (C("place_id") % 500).cast("string"))
    return p.groupBy("id").agg(F.min_by("name", "place_id").alias("name"))
