"""Queries of calendars, frequencies and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.functions import line
from linienwerk.operators import service as ops
from linienwerk.plans.fixtures import trips, view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import BUCKET

C = F.col

ON = "case isodow(d) when 1 then mon when 2 then tue when 3 then wed when 4 then thu when 5 then fri when 6 then sat else sun end = 1"
FULL = f"""full_cal as (select service_id, d from (select service_id, d from (select *, unnest(generate_series(start_date, end_date, interval 1 day))::date d from fx_calendar) where {ON}
 union select service_id, d from fx_calendar_dates where exception_type = 1) where (service_id, d) not in (select (service_id, d) from fx_calendar_dates where exception_type = 2))"""
SAMPLED = f"""sampled as (select service_id, d from (select service_id, d from fx_calendar join fx_samples s on d between start_date and end_date where {ON}
 union select service_id, d from fx_calendar_dates where exception_type = 1) where (service_id, d) not in (select (service_id, d) from fx_calendar_dates where exception_type = 2))"""
SEASONS = "(select d, unnest(list_filter(['annual', case when month(d) <= 3 then 'winter' when month(d) between 6 and 8 then 'summer' end], lambda x: x is not null)) season from fx_samples)"
HITS = f"hits as (select service_id, season, count(*) filter (isodow(d) < 6) wd, count(*) filter (isodow(d) >= 6) we from sampled join {SEASONS} using (d) group by 1, 2)"
FIT = "greatest(0, least(dep0 + 7200, {b} * 3600) - greatest(dep0, {a} * 3600)) // headway"
WIN = """win as (select trip_id, case when headway is null then (dep0 between 25200 and 68399)::bigint else {c} end core, case when headway is null then (dep0 between 68400 and 82799)::bigint else {e} end eve,
 case when headway is null then (dep0 between 25200 and 71999)::bigint else {w} end we from fx_trips)""".format(c=FIT.format(a=7, b=19), e=FIT.format(a=19, b=23), w=FIT.format(a=7, b=20))
NORMS = f"norms as (select season, greatest(count(*) filter (isodow(d) < 6), 1) nwd, greatest(count(*) filter (isodow(d) >= 6), 1) nwe from {SEASONS} group by 1)"
FREQ = f"""{SAMPLED}, {HITS}, {WIN}, {NORMS}, freq as (select route_id tg, season, sum(core * wd) / (any_value(nwd) * 12.0::double) f_core, sum(eve * wd) / (any_value(nwd) * 4.0::double) f_eve, sum(win.we * hits.we) / (any_value(nwe) * 13.0::double) f_we
 from fx_trips join win using (trip_id) join hits using (service_id) join norms using (season) group by 1, 2)"""
ALL = "fx_trips fx_calendar fx_calendar_dates fx_samples fx_routes"


def _full(spark, d):
    return ops.expand_calendar(view(spark, d, "fx_calendar"), view(spark, d, "fx_calendar_dates"))


def _sampled(spark, d):
    return ops.expand_calendar_sampled(view(spark, d, "fx_calendar"), view(spark, d, "fx_calendar_dates"), view(spark, d, "fx_samples"))


def _freq(spark, d):
    s = view(spark, d, "fx_samples")
    t = view(spark, d, "fx_trips").withColumn("tg", C("route_id"))
    return ops.group_frequency(t, ops.trip_windows(t), ops.sample_hits(_sampled(spark, d), s), s, ["tg"])


@query(ALL, f"with {FULL} select * from full_cal")
def expand_calendar(spark, d):
    return _full(spark, d)


@query(ALL, f"with {SAMPLED} select * from sampled")
def expand_calendar_sampled(spark, d):
    return _sampled(spark, d)


@query(ALL, f"select service_id, d from fx_calendar join fx_samples on d between start_date and end_date where {ON}")
def service_on_sample_dates(spark, d):
    return ops.service_on_sample_dates(view(spark, d, "fx_calendar"), view(spark, d, "fx_samples"))


@query(ALL, f"with {SAMPLED}, {HITS} select * from hits")
def sample_hits(spark, d):
    return ops.sample_hits(_sampled(spark, d), view(spark, d, "fx_samples"))


@query(ALL, f"with {WIN} select * from win")
def trip_windows(spark, d):
    return ops.trip_windows(view(spark, d, "fx_trips"))


@query(ALL, f"with {FREQ} select tg, season, round(f_core, 6) f_core, round(f_eve, 6) f_eve, round(f_we, 6) f_we, round(0.6 * f_core + 0.2 * f_eve + 0.2 * f_we, 6) f from freq")
def group_frequency(spark, d):
    f = _freq(spark, d)
    return f.select("tg", "season", *[F.round(c, 6).alias(c) for c in ("f_core", "f_eve", "f_we")], F.round(line.weighted_frequency(C("f_core"), C("f_eve"), C("f_we")), 6).alias("f"))


@query(ALL, f"""with {SAMPLED}, {HITS}, {WIN}, {NORMS}
select route_id tg, trip_id % 2 variant, season, round(sum(core * wd) / (any_value(nwd) * 12.0::double), 6) f_core from fx_trips join win using (trip_id) join hits using (service_id) join norms using (season) group by 1, 2, 3""")
def variant_frequency(spark, d):
    s = view(spark, d, "fx_samples")
    t = view(spark, d, "fx_trips").select("trip_id", "service_id", "dep0", "headway", C("route_id").alias("tg"), (C("trip_id") % 2).alias("variant"))
    f = ops.group_frequency(t, ops.trip_windows(t), ops.sample_hits(_sampled(spark, d), s), s, ["tg", "variant"])
    return f.select("tg", "variant", "season", F.round("f_core", 6).alias("f_core"))


@query(ALL, f"with {FULL} select route_id tg, count(distinct d) n from (select distinct route_id, service_id from fx_trips) join full_cal using (service_id) group by 1")
def active_days(spark, d):
    return ops.active_days(view(spark, d, "fx_trips").withColumn("tg", C("route_id")), _full(spark, d), ["tg"])


@query(ALL, f"with {FULL}, n as (select service_id, count(*) k from full_cal group by 1) select route_id tg, sum(k * case when headway > 0 then greatest(7200 // headway, 1) else 1 end)::bigint runs from fx_trips join n using (service_id) group by 1")
def variant_runs(spark, d):
    return ops.variant_runs(view(spark, d, "fx_trips").withColumn("tg", C("route_id")), _full(spark, d), ["tg"])


@query(ALL, f"""with {FULL} select service_id, min(d) as first, max(d) as last, {', '.join(f"count(*) filter (isodow(d) = {k + 1}) {x}" for k, x in enumerate(ops.DAYS))} from full_cal group by 1""")
def date_stats(spark, d):
    return ops.date_stats(_full(spark, d), ["service_id"])


@query(ALL, f"with {FULL} select min(d) as first, max(d) as last from full_cal")
def feed_validity(spark, d):
    return _full(spark, d).agg(F.min("d").alias("first"), F.max("d").alias("last"))


@query(ALL, f"with {FULL}, n as (select service_id, count(*) k, count(*) filter (month(d) <= 3) w, count(*) filter (month(d) between 6 and 8) s from full_cal group by 1) select route_id tg, trip_id % 5 variant, sum(k)::bigint annual, sum(w)::bigint winter, sum(s)::bigint summer from fx_trips join n using (service_id) group by 1, 2")
def variant_weights(spark, d):
    return _weights(spark, d)


def _weights(spark, d):
    m = F.month("d")
    n = _full(spark, d).groupBy("service_id").agg(F.count("*").alias("k"), F.count_if(m <= 3).alias("w"), F.count_if(m.between(6, 8)).alias("s"))
    t = view(spark, d, "fx_trips").select("service_id", C("route_id").alias("tg"), (C("trip_id") % 5).alias("variant"))
    return t.join(n, "service_id").groupBy("tg", "variant").agg(F.sum("k").alias("annual"), F.sum("w").alias("winter"), F.sum("s").alias("summer"))


@query(ALL, f"""with {FULL}, n as (select tg, route_id, count(distinct d) n from (select distinct route_id * 50 + service_id % 50 tg, route_id, service_id from fx_trips) join full_cal using (service_id) group by 1, 2), b as (select *, {BUCKET} bucket from n join fx_routes using (route_id))
select tg, n, case when bucket = 'ferry' or bucket = 'mountain' or n >= 260 then 'kept' when bucket = 'bus' and n >= 90 then 'rescued' else 'dropped' end verdict from b""")
def min_active_days_gate(spark, d):
    t = view(spark, d, "fx_trips").withColumn("tg", C("route_id") * 50 + C("service_id") % 50)
    n = ops.active_days(t, _full(spark, d), ["tg", "route_id"])
    b = line.route_bucket(C("route_type"))
    r = view(spark, d, "fx_routes").select("route_id", b.alias("bucket"), line.gate_exempt(b, line.mountain_origin(b, C("route_type"))).alias("exempt"))
    return ops.min_active_days_gate(n.join(r, "route_id"), 260, 90, 90).select("tg", "n", "verdict")


SHARE = """select {k}, {v}, round({w} / t, 6) pct, case when c = 1 then true when exempt then true
 when bool_or({w} >= greatest(1, t * 0.10)) over (partition by {k}) then {w} >= greatest(1, t * 0.10)
 when bool_or({w} >= greatest(1, t * 0.05)) over (partition by {k}) then {w} >= greatest(1, t * 0.05) else true end kept from (select *, sum({w}) over (partition by {k})::double t, count(*) over (partition by {k}) c from x)"""


@query("fx_trips fx_routes", "with x as (select route_id % 9 sg, route_id tg, count(*)::double w, bool_or(route_type in ('1300', '1400')) exempt from fx_trips join fx_routes using (route_id) group by 1, 2)" + SHARE.format(k="sg", v="tg", w="w"))
def rare_group_filter(spark, d):
    r = view(spark, d, "fx_routes").select("route_id", (line.route_bucket(C("route_type")) == "mountain").alias("mountain"))
    g = view(spark, d, "fx_trips").join(r, "route_id").groupBy((C("route_id") % 9).alias("sg"), C("route_id").alias("tg")).agg(F.count("*").alias("w"), F.bool_or("mountain").alias("mountain"))
    return ops.share_filter(g, "w", ["sg"], C("mountain")).select("sg", "tg", F.round("pct", 6).alias("pct"), "kept")


@query("fx_trips", "with x as (select route_id tg, dep0 % 14 variant, count(*)::double w, false exempt from fx_trips group by 1, 2)" + SHARE.format(k="tg", v="variant", w="w"))
def rare_variant_filter(spark, d):
    g = view(spark, d, "fx_trips").groupBy(C("route_id").alias("tg"), (C("dep0") % 14).alias("variant")).agg(F.count("*").alias("w"))
    return ops.share_filter(g, "w", ["tg"]).select("tg", "variant", F.round("pct", 6).alias("pct"), "kept")


@query(ALL, f"""with {FULL}, n as (select service_id, count(*) k, count(*) filter (month(d) <= 3) w, count(*) filter (month(d) between 6 and 8) s from full_cal group by 1), v as (select route_id tg, trip_id % 12 variant, sum(k) a, sum(w) w, sum(s) s from fx_trips join n using (service_id) group by 1, 2),
t as (select *, sum(a) over (partition by tg) ta, sum(w) over (partition by tg) tw, sum(s) over (partition by tg) ts from v), r as (select tg, variant, case when a >= greatest(1, ta * 0.1) then 'annual' when w >= greatest(1, tw * 0.1) then 'winter' when s >= greatest(1, ts * 0.1) then 'summer' end season from t)
select tg, variant, season, season is not null kept from r""")
def seasonal_variant_filter(spark, d):
    m = F.month("d")
    n = _full(spark, d).groupBy("service_id").agg(F.count("*").alias("k"), F.count_if(m <= 3).alias("w"), F.count_if(m.between(6, 8)).alias("s"))
    v = view(spark, d, "fx_trips").select("service_id", C("route_id").alias("tg"), (C("trip_id") % 12).alias("variant")).join(n, "service_id").groupBy("tg", "variant").agg(F.sum("k").alias("annual"), F.sum("w").alias("winter"), F.sum("s").alias("summer"))
    return ops.seasonal_variant_filter(v, ["tg"]).select("tg", "variant", "season", "kept")


@query(ALL, f"""with {FREQ}, g as (select route_id tg, {BUCKET} mode, route_id % 3 = 0 rescued from fx_routes), f as (select tg, season, round(0.6 * f_core + 0.2 * f_eve + 0.2 * f_we, 9) f from freq),
p as (select tg, max(case when season = 'annual' then f end) a, max(case when season = 'winter' then f end) w, max(case when season = 'summer' then f end) s from f group by 1),
x as (select g.*, a, w, s, 8.0 * case mode when 'train' then 0.25 when 'tram' then 0.6 when 'metro' then 0.8 when 'bus' then 0.75 when 'ferry' then 0.01 else 0.05 end lim from g left join p using (tg)),
y as (select *, case when a > lim then 'annual' when rescued and w > lim then 'winter' when rescued and s > lim then 'summer' end season from x)
select tg, season, season is not null passed, round(case season when 'winter' then w when 'summer' then s else a end, 6) f from y""")
def frequency_gate(spark, d):
    g = view(spark, d, "fx_routes").select(C("route_id").alias("tg"), line.route_bucket(C("route_type")).alias("mode"), (C("route_id") % 3 == 0).alias("rescued"))
    out = ops.frequency_gate(_freq(spark, d), g, 8 * line.lookup(C("mode"), line.WORST))
    return out.select("tg", "season", "passed", F.round("f", 6).alias("f"))


@query("fx_stop_times fx_stops", "select uic, round(avg(greatest(0, dep - arr - 30)), 6) avg_s from fx_stop_times join fx_stops using (stop_id) group by uic")
def dwell_by_station(spark, d):
    s = view(spark, d, "fx_stops").select("stop_id", "uic")
    j = view(spark, d, "fx_stop_times").join(s, "stop_id")
    return j.groupBy("uic").agg(F.round(F.avg(F.greatest(F.lit(0), C("dep") - C("arr") - 30)), 6).alias("avg_s"))


@query("fx_trips fx_stop_times", "select route_id, lo, hi, n from (select route_id, min(coalesce(f, dep0)) lo, max(case when headway is not null then dep0 + 7200 else f end) hi, count(*) n from fx_trips join (select trip_id, min(dep) f from fx_stop_times group by 1) using (trip_id) group by 1)")
def departure_span(spark, d):
    first = view(spark, d, "fx_stop_times").groupBy("trip_id").agg(F.min("dep").alias("f"))
    t = trips(spark, d).join(first, "trip_id")
    return t.groupBy("route_id").agg(F.min(F.coalesce("f", "dep0")).alias("lo"), F.max(F.when(C("headway").isNotNull(), C("dep0") + 7200).otherwise(C("f"))).alias("hi"), F.count("*").alias("n"))


@query("fx_trips", """with g as (select route_id, dep0, dep0 - lag(dep0) over (partition by route_id order by dep0) gap from (select distinct route_id, dep0 from fx_trips)) select route_id, dep0, gap from g where gap is not null""")
def departure_gaps(spark, d):
    from linienwerk.operators.lines import departure_gaps as gaps

    return gaps(view(spark, d, "fx_trips"), "route_id", "dep0").where("gap is not null")


@query("fx_trips", """with t as (select distinct route_id * 4 + trip_id % 40 v, dep0 from fx_trips), g as (select v, dep0, dep0 - lag(dep0) over (partition by v order by dep0) gap from t), r as (select v, gap, row_number() over (partition by v order by gap) k, count(gap) over (partition by v) n from g where gap is not null)
select v, max(gap) > greatest(3 * max(case when k = n // 2 + 1 then gap end), 5400) irregular from r where n >= 3 group by v""")
def irregular_service(spark, d):
    from linienwerk.operators.lines import irregular_service as irregular

    t = view(spark, d, "fx_trips").select((C("route_id") * 4 + C("trip_id") % 40).alias("v"), "dep0")
    return irregular(t, "v", "dep0")
