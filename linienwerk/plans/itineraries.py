"""Queries on journeys."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import trips as ops
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query

C = F.col

COMFORT = "(1 + 0.1 * ((walk_s / 60.0::double) * (walk_s / 60.0::double) / ((walk_s / 60.0::double) * (walk_s / 60.0::double) + 900) + 1 - pow(0.7::double, boardings)))"
SCORE = "(600.0::double * boardings + 2.0 * least(walk_s, 1800) + 0.5 * greatest(walk_s - 1800, 0))"


def beats(b, a):
    return f"({b}.start_s >= {a}.start_s - 60 and {b}.end_s <= {a}.end_s + 60 and ({b}.start_s > {a}.start_s + 60 or {b}.end_s < {a}.end_s - 60))"


def kept(src):
    """SQL of the itineraries of a relation that none beats."""
    return f"""e as (select *, duration_s * {COMFORT} eff, {SCORE} score from {src}), kept as (select a.* from e a where not exists (select 1 from e b where b.query_id = a.query_id and b.itin <> a.itin and
 case when {beats('b', 'a')} then (greatest(abs(a.start_s - b.start_s), abs(a.end_s - b.end_s)) > 540 or (b.eff > 0 and a.eff / b.eff - 1 > 0.2)) when {beats('a', 'b')} then false
 else (case when a.mode = 'arrive' then b.start_s >= a.start_s - 60 else b.end_s <= a.end_s + 60 end) and a.score - b.score > -300 + 430 * cbrt(greatest(120, least(abs(a.start_s - b.start_s), abs(a.end_s - b.end_s)))) end))"""


WAIT = """wt as (select itin, greatest(coalesce(max(w), 0), 0)::bigint wait_s from (select itin, case when mode <> 'WALK' then t0 - lag(t1) over v - (wk - lag(wk) over v) end w from
 (select *, sum(case when mode = 'WALK' then t1 - t0 else 0 end) over (partition by itin order by seq) wk from fx_legs) where mode <> 'WALK' window v as (partition by itin order by seq)) group by 1),
waits as (select distinct l.itin, coalesce(wait_s, 0) wait_s from fx_legs l left join wt using (itin))"""
TOTALS = "totals as (select itin, coalesce(sum(case when mode = 'WALK' then t1 - t0 end), 0)::bigint walk_s, count(*) filter (mode <> 'WALK') boardings, greatest(count(*) filter (mode <> 'WALK') - 1, 0) transfers, coalesce(max(case when mode = 'WALK' then t1 - t0 end), 0) longest_walk_s from fx_legs group by 1)"


@query("fx_legs", f"with {TOTALS} select * from totals")
def itinerary_totals(spark, d):
    return ops.itinerary_totals(view(spark, d, "fx_legs"))


@query("fx_legs", f"with {WAIT} select * from waits")
def longest_wait(spark, d):
    return ops.longest_wait(view(spark, d, "fx_legs"))


@query("fx_legs", "select itin, coalesce(bool_or(mode <> 'WALK' and t0 - coalesce(p, m) > 1500), false) long_wait from (select *, lag(t1) over (partition by itin order by seq) p, min(t0) over (partition by itin) m from fx_legs) group by 1")
def has_long_wait(spark, d):
    return ops.has_long_wait(view(spark, d, "fx_legs"), 1500)


@query("fx_legs", "select itin, seq, mode from (select *, min(case when mode <> 'WALK' then seq end) over (partition by itin) a, max(case when mode <> 'WALK' then seq end) over (partition by itin) b from fx_legs) where not (mode = 'WALK' and seq > coalesce(a, -1) and seq < coalesce(b, -1) and t1 - t0 <= 360)")
def display_legs(spark, d):
    return ops.display_legs(view(spark, d, "fx_legs")).select("itin", "seq", "mode")


@query("fx_itineraries", f"with {kept('fx_itineraries')} select itin, query_id from kept")
def dominated_itineraries(spark, d):
    return ops.dominated_itineraries(view(spark, d, "fx_itineraries")).select("itin", "query_id")


@query("fx_itineraries", f"select itin, case when round(eff, 6) = round(lo, 6) then 'best' when eff / lo - 1 <= 0.07 then 'good' when eff / lo - 1 >= 0.3 and eff - lo >= 300 then 'bad' end badge from (select *, min(eff) over (partition by query_id) lo from (select *, duration_s * {COMFORT} eff from fx_itineraries))")
def itinerary_badges(spark, d):
    return ops.itinerary_badges(view(spark, d, "fx_itineraries"))


LEVELS = """warned as (select itin, query_id, list_filter([case when longest_walk_s > 3600 then {'kind': 'long-walk', 'severity': 'strong', 'value': longest_walk_s} when longest_walk_s > 2400 then {'kind': 'long-walk', 'severity': 'medium', 'value': longest_walk_s} when longest_walk_s > 1200 then {'kind': 'long-walk', 'severity': 'standard', 'value': longest_walk_s} end,
 case when wait_s >= 10800 then {'kind': 'long-wait', 'severity': 'strong', 'value': wait_s} when wait_s >= 7200 then {'kind': 'long-wait', 'severity': 'medium', 'value': wait_s} when wait_s >= 3600 then {'kind': 'long-wait', 'severity': 'standard', 'value': wait_s} end,
 case when duration_s - lo >= 600 then case when duration_s >= 2.5 * lo then {'kind': 'very-slow', 'severity': 'strong', 'value': duration_s - lo} when duration_s >= 2 * lo then {'kind': 'very-slow', 'severity': 'medium', 'value': duration_s - lo} when duration_s >= 1.5 * lo then {'kind': 'very-slow', 'severity': 'standard', 'value': duration_s - lo} end end], lambda x: x is not null) warnings
 from (select i.*, longest_walk_s, wait_s, min(duration_s) over (partition by query_id) lo from {src} i join totals using (itin) join waits using (itin)))"""


@query("fx_legs fx_itineraries", f"with {TOTALS}, {WAIT}, {LEVELS.replace('{src}', 'fx_itineraries')} select itin, len(warnings)::bigint n, case when len(warnings) > 0 then list_last(warnings).kind || ' ' || list_last(warnings).severity || ' ' || list_last(warnings).value end final from warned")
def itinerary_warnings(spark, d):
    legs = view(spark, d, "fx_legs")
    w = ops.itinerary_warnings(view(spark, d, "fx_itineraries"), ops.itinerary_totals(legs), ops.longest_wait(legs))
    last = F.try_element_at("warnings", F.lit(-1))
    return w.select("itin", F.size("warnings").cast("long").alias("n"), F.when(F.size("warnings") > 0, F.concat_ws(" ", last["kind"], last["severity"], last["value"].cast("string"))).alias("final"))


CAP = """capped as (select *, row_number() over (partition by query_id order by case when mode = 'arrive' then start_s else end_s end, itin) rank from (select *, row_number() over (partition by query_id order by case when mode = 'arrive' then -start_s else end_s end, itin) k from {src}) where k <= 5)"""


@query("fx_itineraries", f"with {CAP.replace('{src}', 'fx_itineraries')} select query_id, itin, rank from capped")
def result_cap(spark, d):
    return ops.result_cap(view(spark, d, "fx_itineraries"), 5).select("query_id", "itin", "rank")


@query("fx_itineraries", "select query_id, itin from (select *, row_number() over (partition by query_id order by case when mode = 'arrive' then -end_s else start_s end, itin) k from fx_itineraries where itin % 3 <> 0) where k <= 4")
def adjacent_batch(spark, d):
    i = view(spark, d, "fx_itineraries")
    return ops.adjacent_batch(i, i.where("itin % 3 = 0"), 4).select("query_id", "itin")


FP = """pay as (select itin, string_agg(case when mode <> 'WALK' then concat_ws('|', mode, t0, t1, route_id, trip_id, from_stop, to_stop) else concat_ws('|', mode, t1 - t0) end, '||' order by seq) payload from fx_legs group by 1),
fps as (select itin, lpad(printf('%x', list_reduce(list_prepend(5381::bigint, list_transform(string_split(payload, ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 33 + c) % 4294967296)), 8, '0') fp from pay)"""


@query("fx_legs", f"with {FP} select itin, fp from fps")
def itinerary_fingerprint(spark, d):
    return ops.itinerary_fingerprint(view(spark, d, "fx_legs")).select("itin", "fp")


@query("fx_legs", """with p as (select itin, coalesce(string_agg(case when mode <> 'WALK' then concat_ws('|', mode, t0, t1, route_id, from_stop, to_stop) end, '||' order by seq), 'walk|' || round(sum(t1 - t0) / 60.0)::bigint) payload from fx_legs group by 1)
select itin, lpad(printf('%x', list_reduce(list_prepend(5381::bigint, list_transform(string_split(payload, ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 33 + c) % 4294967296)), 8, '0') fp from p""")
def share_fingerprint(spark, d):
    return ops.share_fingerprint(view(spark, d, "fx_legs")).select("itin", "fp")


@query("fx_legs fx_itineraries", f"""with {FP}, one as (select query_id, fp, min(itin) itin from fx_itineraries join fps using (itin) group by 1, 2), src as (select * from fx_itineraries where itin in (select itin from one)), {kept('src')}, {CAP.replace('{src}', 'kept')}, {TOTALS}, {WAIT}, {LEVELS.replace('{src}', 'capped')}
select query_id, itin, rank, case when round(eff, 6) = round(lo, 6) then 'best' when eff / lo - 1 <= 0.07 then 'good' when eff / lo - 1 >= 0.3 and eff - lo >= 300 then 'bad' end badge, len(warnings)::bigint n_warnings from (select *, min(eff) over (partition by query_id) lo from capped) join (select itin, warnings from warned) using (itin)""")
def rank_itineraries(spark, d):
    return ops.rank_itineraries(view(spark, d, "fx_legs"), view(spark, d, "fx_itineraries"), 5)


@query("fx_legs", """with t as (select *, lag(seq) over w p, lead(seq) over w n from fx_legs where mode <> 'WALK' window w as (partition by itin order by seq))
select itin, seq, case when p is null then 'start' else 'board' end kind, from_stop stop from t union all select itin, seq, case when n is null then 'end' else 'alight' end, to_stop from t""")
def transfer_points(spark, d):
    return ops.transfer_points(view(spark, d, "fx_legs"))


@query("fx_legs", "select distinct itin, stop uic from (select itin, from_stop stop from fx_legs union all select itin, to_stop from fx_legs)")
def route_members(spark, d):
    return view(spark, d, "fx_legs").select("itin", F.explode(F.array("from_stop", "to_stop")).alias("uic")).distinct()


@query("fx_legs fx_stops", "select itin, round(min(lon), 5) w, round(min(lat), 5) s, round(max(lon), 5) e, round(max(lat), 5) n from (select itin, from_stop stop_id from fx_legs union all select itin, to_stop from fx_legs) join fx_stops using (stop_id) group by 1")
def itinerary_bbox(spark, d):
    p = view(spark, d, "fx_legs").select("itin", F.explode(F.array("from_stop", "to_stop")).alias("stop_id")).join(view(spark, d, "fx_stops").select("stop_id", "lon", "lat"), "stop_id")
    return p.groupBy("itin").agg(F.round(F.min("lon"), 5).alias("w"), F.round(F.min("lat"), 5).alias("s"), F.round(F.max("lon"), 5).alias("e"), F.round(F.max("lat"), 5).alias("n"))


@query("fx_itineraries", "select itin id, case when query_id % 10 = 0 then 'error' when itin % 4 = 1 then 'gone' else 'present' end status from fx_itineraries where query_id in (select query_id from fx_itineraries where itin % 4 <> 1) or query_id % 10 = 0")
def verify_shares(spark, d):
    i = view(spark, d, "fx_itineraries").select(C("itin").alias("id"), "query_id", C("itin").cast("string").alias("fp"))
    latest = i.where("id % 4 <> 1 and query_id % 10 <> 0").select("query_id", "fp")
    some = latest.select("query_id").distinct()
    s = i.join(some, "query_id", "left_semi").unionByName(i.where("query_id % 10 = 0"))
    return ops.verify_shares(s, latest)


@query("fx_itineraries", """with g as (select query_id, t, lead(t) over (partition by query_id order by t) t1 from (select distinct query_id, start_s * 7 t from fx_itineraries)), x as (select *, unnest(generate_series(t // 86400, (t1 - 1) // 86400)) d from g where t1 - t >= 14400),
h as (select query_id, bool_or(least(t1, d * 86400 + 75600) - greatest(t, d * 86400 + 21600) >= 14400) sparse from x group by 1) select distinct i.query_id, coalesce(sparse, false) sparse from fx_itineraries i left join h using (query_id)""")
def sparse_service_gap(spark, d):
    return ops.sparse_service_gap(view(spark, d, "fx_itineraries").select("query_id", (C("start_s") * 7).alias("t")))


@query("fx_itineraries", "select query_id, itin from fx_itineraries where itin % 2 = 0 or itin % 3 = 0")
def union_results(spark, d):
    i = view(spark, d, "fx_itineraries").select("query_id", "itin")
    return i.where("itin % 2 = 0").unionByName(i.where("itin % 3 = 0")).dropDuplicates(["query_id", "itin"])


@query("fx_places", "select place_id % 60 query, name, min(place_id) place_id from fx_places group by 1, 2")
def dedup_places(spark, d):
    p = view(spark, d, "fx_places").select((C("place_id") % 60).alias("query"), "name", "place_id")
    return p.groupBy("query", "name").agg(F.min("place_id").alias("place_id"))


LEG_KEYS = "k as (select itin, seq, mode, case seq % 3 when 0 then 'ch_' || route_id when 1 then cast(route_id as varchar) else 'zz_x' || route_id end rid from fx_legs), c as (select case when line_id % 2 = 0 then 'ch_' || line_id else cast(line_id as varchar) end rid, colour from fx_lines)"


@query("fx_legs fx_lines", f"""with {LEG_KEYS} select itin, seq, coalesce(a.colour, b.colour, case mode when 'RAIL' then '#eb0000' when 'TRAM' then '#00a0a0' when 'BUS' then '#f0b000' end, '#888888') colour
from k left join c a on a.rid = k.rid left join c b on b.rid = regexp_replace(k.rid, '^[a-z]+_', '')""")
def leg_colour(spark, d):
    k = view(spark, d, "fx_legs")
    r = C("route_id").cast("string")
    legs = k.select("itin", "seq", "mode", F.when(C("seq") % 3 == 0, F.concat(F.lit("ch_"), r)).when(C("seq") % 3 == 1, r).otherwise(F.concat(F.lit("zz_x"), r)).alias("route_key"))
    i = C("line_id").cast("string")
    colours = view(spark, d, "fx_lines").select(F.when(C("line_id") % 2 == 0, F.concat(F.lit("ch_"), i)).otherwise(i).alias("route_key"), "colour")
    return ops.leg_colour(legs, colours, {"RAIL": "#eb0000", "TRAM": "#00a0a0", "BUS": "#f0b000"}, "#888888")
