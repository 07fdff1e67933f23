"""Queries on the access log and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.functions.geo import haversine_km
from linienwerk.operators import usage as ops
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query

C = F.col

PARSED = """p as (select event_id, split_part(line, ' ', 1) ip, strptime(regexp_extract(line, '\\[([^:]*):', 1), '%d/%b/%Y')::date as day, contains(line, 'Googlebot') bot,
 regexp_extract(line, 'fromPlace=([^& ]*)', 1) f, regexp_extract(line, 'toPlace=([^& ]*)', 1) t from fx_access_log)"""
MEASURES = "count(*) filter (not bot) hits, count(*) filter (not bot) plans, count(distinct case when not bot then ip end) unique_ips, count(*) filter (bot) bots"


@query("fx_access_log", f"with {PARSED} select day, {MEASURES} from p group by day")
def daily_access(spark, d):
    return ops.daily_access(view(spark, d, "fx_access_log"))


@query("fx_access_log", f"with {PARSED} select day, {MEASURES}, grouping(day)::int total from p group by rollup(day)")
def access_totals(spark, d):
    return ops.access_totals(view(spark, d, "fx_access_log"))


@query("fx_access_log", f"with {PARSED} select day, {MEASURES} from p group by day order by day desc")
def days_desc(spark, d):
    return ops.daily_access(view(spark, d, "fx_access_log")).orderBy(F.desc("day"))


@query("fx_access_log", f"""with {PARSED}, g as (select 'u:' || substr(f, 10) origin, 'c:' || printf('%.3f', split_part(t, ',', 1)::double) || ',' || printf('%.3f', split_part(t, ',', 2)::double) target, count(*) n, min_by(substr(f, 10), event_id) link_from, min_by(t, event_id) link_to from p where not bot group by 1, 2)
select * from g order by n desc, origin, target limit 30""")
def top_route_pairs(spark, d):
    return ops.top_route_pairs(view(spark, d, "fx_access_log"), "event_id")


@query("", """with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) k from events),
r as (select event_id, user_id, ts, k, [epoch_us(ts)] kept, true accepted from e where k = 1
 union all select e.event_id, e.user_id, e.ts, e.k, case when len(list_filter(r.kept, lambda x: x > epoch_us(e.ts) - 7200000000)) < 2 then list_append(list_filter(r.kept, lambda x: x > epoch_us(e.ts) - 7200000000), epoch_us(e.ts)) else list_filter(r.kept, lambda x: x > epoch_us(e.ts) - 7200000000) end,
  len(list_filter(r.kept, lambda x: x > epoch_us(e.ts) - 7200000000)) < 2 from r join e on e.user_id = r.user_id and e.k = r.k + 1)
select event_id, accepted from r""")
def throttle(spark, d):
    e = view(spark, d, "events").select("event_id", "user_id", "ts")
    return ops.throttle(e, "user_id", "ts", "event_id", 7200, 2).select("event_id", "accepted")


@query("", """with b as (select user_id, ts, event_id, sum(case when prev is null or ts - prev >= interval 6 hour then 1 else 0 end) over (partition by user_id order by ts, event_id) s from (select *, lag(ts) over (partition by user_id order by ts, event_id) prev from events))
select user_id, min(ts) as start, count(*) n, max_by(event_id, (ts, event_id)) as last from b group by user_id, s""")
def latest_wins(spark, d):
    return ops.bursts(view(spark, d, "events"), "user_id", "ts", "event_id", "6 hours")


@query("fx_stations", """with p as (select event_id, 5.93 + user_id * 53 % 459 / 100.0::double lon, 45.8 + user_id * 37 % 203 / 100.0::double lat from events)
select event_id, uic from (select event_id, s.uic, sqrt(pow((s.lon - p.lon) * cos(radians(46.8)), 2) + pow(s.lat - p.lat, 2)) * 111320 m, row_number() over (partition by event_id order by sqrt(pow((s.lon - p.lon) * cos(radians(46.8)), 2) + pow(s.lat - p.lat, 2)), s.uic) k from p join fx_stations s on true) where k = 1 and m <= 20000""")
def nearest_station(spark, d):
    from linienwerk.operators.spatial import nearest

    p = view(spark, d, "events").select("event_id", (5.93 + C("user_id") * 53 % 459 / 100).alias("lon"), (45.8 + C("user_id") * 37 % 203 / 100).alias("lat"))
    return nearest(p, view(spark, d, "fx_stations"), "event_id", "uic", 20000.0).select("event_id", "uic")


@query("fx_access_log fx_stations", f"""with {PARSED}, q as (select distinct 'u:' || (substr(f, 10)::bigint % 40) token from p where not bot)
select token, coalesce(name, substr(token, 3)) name from q left join fx_stations on uic = substr(token, 3)""")
def resolve_place_tokens(spark, d):
    p = ops.parse_log(view(spark, d, "fx_access_log")).where("not bot")
    n = (F.regexp_extract("request", r"fromPlace=ch_Parent(\d+)", 1).cast("long") % 40).cast("string")
    t = p.select(F.concat(F.lit("u:"), n).alias("token")).distinct()
    s = view(spark, d, "fx_stations").select(F.concat(F.lit("u:"), "uic").alias("token"), "name")
    return t.join(s, "token", "left").select("token", F.coalesce("name", F.substr("token", F.lit(3))).alias("name"))
