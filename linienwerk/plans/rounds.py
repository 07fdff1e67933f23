"""Queries of greedy operators in rounds, of levels of lines and stations, and of batches along a curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators import gating, rounds
from linienwerk.operators.graph import connected_components
from linienwerk.operators.lines import first_last_flags
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query
from linienwerk.plans.sources import HILBERT, hilbert

C = F.col

#: A stop joins the first seed near enough whose members share no line with it; the list holds the seeds so far with their lines.
_CLUSTERS = """with recursive s as (select stop_id, kind, lon, lat, list_sort(list_distinct([line_a, line_b])) of, row_number() over (partition by kind order by stop_id) k from fx_dots),
st(kind, k, seeds, took) as (
 select kind, 0::bigint, []::struct(id bigint, lon double, lat double, of bigint[])[], null::bigint from s group by kind
 union all
 select kind, k, case when took is null then list_append(seeds, {'id': stop_id, 'lon': lon, 'lat': lat, 'of': of}) else list_transform(seeds, lambda x: case when x.id = took then {'id': x.id, 'lon': x.lon, 'lat': x.lat, 'of': list_concat(x.of, of)} else x end) end, coalesce(took, stop_id)
 from (select s.*, seeds, list_filter(seeds, lambda x: not list_has_any(x.of, s.of) and sqrt(pow((s.lon - x.lon) * 111320 * cos(radians(46.8)), 2) + pow((s.lat - x.lat) * 111320, 2)) < case s.kind when 'rail' then 300 else 50 end)[1].id took from st join s on s.kind = st.kind and s.k = st.k + 1) n)
select stop_id, took cluster from st join s using (kind, k)"""


@query("fx_dots", _CLUSTERS)
def cluster_stops_greedy(spark, d):
    s = view(spark, d, "fx_dots").select("stop_id", "kind", "lon", "lat", F.array("line_a", "line_b").alias("lines"))
    return rounds.cluster_stops_greedy(s, {"rail": 300.0, "other": 50.0})


#: Features in order, each against the list of those kept before it.
_OVERLAPPING = """with recursive f as (select line_id id, count(*) n, min(lon) w, min(lat) s, max(lon) e, max(lat) t from fx_line_stops group by line_id),
g as (select f.*, ref, row_number() over (partition by ref order by n desc, id) k from f join fx_lines l on l.line_id = f.id where w < e and s < t),
st(ref, k, kept, id, drop_it) as (
 select ref, 0::bigint, []::struct(w double, s double, e double, t double)[], null::bigint, true from g group by ref
 union all
 select ref, k, case when hit then kept else list_append(kept, {'w': w, 's': s, 'e': e, 't': t}) end, id, hit
 from (select g.*, kept, len(list_filter(kept, lambda x: greatest(w, x.w) < least(e, x.e) and greatest(s, x.s) < least(t, x.t)
   and (least(e, x.e) - greatest(w, x.w)) * (least(t, x.t) - greatest(s, x.s)) >= 0.65 * least((e - w) * (t - s), (x.e - x.w) * (x.t - x.s)))) > 0 hit from st join g on g.ref = st.ref and g.k = st.k + 1) n)
select f.id line_id from f left join st on st.id = f.id where coalesce(not drop_it, true)"""


@query("fx_line_stops fx_lines", _OVERLAPPING)
def dedup_overlapping(spark, d):
    b = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.count("*").alias("n_points"), F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    return rounds.dedup_overlapping(b.join(view(spark, d, "fx_lines").select("line_id", "ref"), "line_id"), 0.65, "line_id").select("line_id")


@query("")
def absorb_stops(spark, d):
    """A row for each stop and zoom at which it is drawn, with what it took in."""
    s = view(spark, d, "fx_dots").withColumn("rank", F.when(C("kind") == "rail", F.when(C("tier") < 5, 2).otherwise(1)).otherwise(0))
    s = s.select("stop_id", "lon", "lat", "rank", "score", (F.lit(11) - C("tier") % 4).alias("min_zoom"), (2.0 + C("tier") / 2).alias("px7"), (4.0 + C("tier")).alias("px13"), (C("score") / 10).alias("dep_hr"), F.array("line_a", "line_b").alias("lines"), F.lit(7).alias("least"))
    a = rounds.absorb_stops(s.withColumn("min_zoom", F.greatest("min_zoom", "least")))
    each = a.join(s.select("stop_id", "min_zoom"), "stop_id").withColumn("z", F.explode(F.sequence(F.lit(7), F.lit(13))))
    shown = each.where((C("z") >= C("min_zoom")) & (C("absorbed_z").isNull() | (C("z") > C("absorbed_z"))))
    i = C("z") - 7
    return shown.select("stop_id", "z", "absorbed_z", "absorber", C("score")[i].alias("score"), F.round(C("dep_hr")[i], 3).alias("dep_hr"), F.array_join(C("lines")[i].cast("array<string>"), ",").alias("lines"))


@query("")
def zoom_gating(spark, d):
    n = view(spark, d, "fx_network").hint("merge")
    edges = n.where("upper > 0").select(C("line_id").alias("src"), C("upper").cast("long").alias("dst"))
    between = edges.join(n.where("intercity").select(C("line_id").alias("src")), "src", "left_semi").join(n.where("intercity").select(C("line_id").alias("dst")), "dst", "left_semi")
    comp = connected_components(between, n.where("intercity").select(C("line_id").alias("id")))
    most = comp.groupBy("component").count().orderBy(C("count").desc(), "component").limit(1)
    return gating.zoom_gating(n.select("line_id", "candidate", "stations"), edges, comp.join(F.broadcast(most), "component", "left_semi").select(C("id").alias("line_id")))


def _rules_sql() -> str:
    """Rules as rows."""
    tiers = lambda t: "null" if t is None else "[" + ", ".join(f"'{x}'" for x in t) + "]::varchar[]"
    return ", ".join(f"({k}, '{r.mode}', '{r.kind}', {r.level}, {r.min_km}, {tiers(r.intersection)}, {tiers(r.terminus)}, '{r.mode}: {r.kind}{f' {r.min_km:g} km' if r.min_km else ''}')" for k, r in enumerate(gating.RULES))


_TIERS = "['major_train', 'main_train', 'important_train', 'train_station', 'small_train']"
_STATIONS = f"""with recursive rules as (select * from (values {_rules_sql()}) t(place, mode, kind, level, min_km, inter, term, label)),
l as (select line_id, mode, ref line_key, 7 + line_id % 6 mz, line_id % 10 = 0 intercity from fx_lines),
k as (select line_id, seq, uic, sum(coalesce(2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 0)) over (partition by line_id order by seq) km,
  seq = min(seq) over (partition by line_id) or seq = max(seq) over (partition by line_id) fin
  from (select *, lag(lon) over (partition by line_id order by seq) lo, lag(lat) over (partition by line_id order by seq) la from fx_line_stops)),
s as (select k.*, mode, line_key, mz, intercity, uic::bigint * 7 % 11 imp, {_TIERS}[uic::bigint % 5 + 1] tier from k join l using (line_id)),
o as (select place, line_id, uic, km, min_km, row_number() over (partition by place, line_id order by imp desc, uic, seq) i from s join rules r on r.mode = s.mode and kind = 'spaced' and mz <= level),
g(place, line_id, i, kept, uic) as (select place, line_id, 0::bigint, []::double[], null::varchar from o group by all
 union all select o.place, o.line_id, o.i, case when hit then kept else list_append(kept, km) end, case when not hit then o.uic end
 from (select o.*, kept, len(list_filter(kept, lambda x: abs(x - km) < min_km)) > 0 hit from g join o on o.place = g.place and o.line_id = g.line_id and o.i = g.i + 1) o),
ky as (select distinct place, level, s.mode, uic, line_key from s join rules r on r.mode = s.mode and kind = 'junction' and mz <= level),
sh as (select x.place, x.line_key a, y.line_key b, count(*) c from ky x join ky y on x.place = y.place and x.uic = y.uic and x.line_key < y.line_key group by all),
cr as (select distinct x.place, x.uic from ky x join ky y on x.place = y.place and x.uic = y.uic and x.line_key < y.line_key join sh on sh.place = x.place and a = x.line_key and b = y.line_key where c <= 2),
j as (select r.place, s.uic, any_value(tier) tier, any_value(inter) inter, any_value(term) term, any_value(level) level, any_value(label) label, bool_or(fin) fin, bool_or(cr.uic is not null) crs
  from s join rules r on r.mode = s.mode and kind = 'junction' and mz <= level left join cr on cr.place = r.place and cr.uic = s.uic group by 1, 2),
h as (select uic, greatest(level, mz)::bigint level, place, label from s join rules r on r.mode = s.mode and kind = 'all'
 union all select uic, level, place, label from s join rules r on r.mode = s.mode and kind = 'intercity' and mz <= level and intercity
 union all select g.uic, level, place, label from g join rules using (place) where g.uic is not null
 union all select uic, level, place, label from j where (crs and (inter is null or list_contains(inter, tier))) or (fin and (term is null or list_contains(term, tier)))),
b as (select uic, min({{'level': level, 'place': place, 'label': label}}) b from h group by uic),
f as (select uic, min(mz) mz from s group by uic), m as (select uic, bool_or(crs) crs, bool_or(fin) fin from j group by uic)
select uic, greatest(coalesce(b.level, 14), mz)::int as "level", coalesce(b.level, 14)::int candidate, coalesce(b.label, '') as "label", coalesce(crs, false) is_intersection, coalesce(fin, false) is_terminus from f left join b using (uic) left join m using (uic)"""


@query("fx_line_stops fx_lines", _STATIONS)
def stop_min_zoom(spark, d):
    stops = first_last_flags(view(spark, d, "fx_line_stops"), "line_id").select("line_id", C("seq").alias("idx"), "uic", C("cum_km").alias("km"))
    lines = view(spark, d, "fx_lines").select("line_id", C("ref").alias("line_key"), "mode", (7 + C("line_id") % 6).alias("min_zoom"), (C("line_id") % 10 == 0).alias("intercity"))
    tiers = F.array(*map(F.lit, ("major_train", "main_train", "important_train", "train_station", "small_train")))
    stations = view(spark, d, "fx_stations").select("uic", (C("uic").cast("long") * 7 % 11).alias("importance"), tiers[C("uic").cast("int") % 5].alias("tier"))
    return gating.stop_min_zoom(stops, lines, stations).select("uic", "level", "candidate", "label", "is_intersection", "is_terminus")


@query("fx_buildings", f"""with recursive {HILBERT}, o as (select id, lon, lat, row_number() over (order by "key", id) - 1 n from curve join fx_buildings using (id)),
r as (select id, n, n batch, 1 c, lon w, lon e, lat s, lat t from o where n = 0
 union all select id, n, case when full_ then n else batch end, case when full_ then 1 else c + 1 end, case when full_ then lon else w end, case when full_ then lon else e end, case when full_ then lat else s end, case when full_ then lat else t end
 from (select id, n, batch, c, lon, lat, w, e, s, t, c >= 50 or sqrt(pow((e - w) * 111320 * cos(radians(46.8)), 2) + pow((t - s) * 111320, 2)) > 50000 full_
  from (select o.id, o.n, batch, c, o.lon, o.lat, least(w, o.lon) w, greatest(e, o.lon) e, least(s, o.lat) s, greatest(t, o.lat) t from r join o on o.n = r.n + 1) y) z)
select id, batch from r""")
def spatial_batches(spark, d):
    return rounds.ordered_batches(hilbert(view(spark, d, "fx_buildings")), "key", "id")
