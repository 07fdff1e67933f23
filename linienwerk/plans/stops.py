"""Queries on stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.functions.line import line_weight
from linienwerk.operators.gating import crossing_stations
from linienwerk.operators import lines as line_ops, stops as ops
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query
from linienwerk.plans.scalars import hav

C = F.col

W = "case when mode = 'train' then case when upper(ref) like 'IC%' or upper(ref) like 'EC%' then 6.0 when regexp_matches(upper(ref), '^R($|[^A-Z])') then 4.0 else 3.0 end when mode in ('mountain','ferry') then 3.0 when mode = 'metro' then 2.0 when mode = 'tram' then 1.5 else 1.0 end::double"
ENDS = "ends as (select line_id, min_by(uic, seq) a, max_by(uic, seq) b, count(*) n from fx_line_stops group by 1)"
SCORES = f"""{ENDS}, con as (select uic, ref, max({W} * (1 + score) * case when uic = a or uic = b then 1.5 else 1.0 end) c from fx_line_stops join ends using (line_id) join fx_lines using (line_id) where n >= 2 group by 1, 2), scores as (select uic, sum(c) score from con group by 1)"""
INDEX = f"idx as (select uic, ref, mode, bool_or(uic = a or uic = b) terminates from fx_line_stops join ends using (line_id) join fx_lines using (line_id) group by 1, 2, 3)"
MLC = "case when mode = 'mountain' then case when terminates then 0.9 else 1.0 end when mode = 'ferry' then 1.0 when mode in ('tram', 'bus', 'regional_bus') then 0.5 else 0 end"
V = "fx_line_stops fx_lines"


def _scores(spark, d):
    return line_ops.stop_scores(view(spark, d, "fx_line_stops"), view(spark, d, "fx_lines"), line_weight(C("ref"), C("mode")))


def _index(spark, d):
    return line_ops.stop_line_index(view(spark, d, "fx_line_stops"), view(spark, d, "fx_lines"))


@query(V, f"with {SCORES} select uic, round(score, 4) score from scores")
def stop_score(spark, d):
    return _scores(spark, d).select("uic", F.round("score", 4).alias("score"))


@query(V, f"with {ENDS}, {INDEX} select * from idx")
def stop_line_index(spark, d):
    return _index(spark, d)


@query(V, f"with {ENDS}, {INDEX} select uic, round(sum({MLC}), 6)::double n from idx group by 1")
def mountain_line_count(spark, d):
    return ops.mountain_line_count(_index(spark, d))


TIER = f"""{SCORES}, {INDEX}, s as (select uic, bool_or(mode = 'train') train, bool_or(mode = 'metro') metro, bool_or(mode = 'mountain') mountain, bool_or(mode = 'ferry') ferry, bool_or(mode = 'train' and (upper(ref) like 'IC%' or upper(ref) like 'EC%')) ic, sum({MLC}) mlc from idx group by 1),
tiers as (select uic, case when uic = '4' then 'main_train' when ic and score >= 100 then 'major_train' when ic and score >= 40 then 'main_train' when train and score >= 20 then 'important_train' when train and score >= 10 then 'train_station' when train then 'small_train' when mountain then case when mlc >= 2 then 'major_mountain' else 'mountain_stop' end when ferry then 'ferry_stop'
 when score >= 15 or metro then 'major_hub' when score >= 6 then 'big_station' when score >= 1.5 then 'normal_stop' else 'small_bus' end tier from s full join scores using (uic))"""


def _tiers(spark, d):
    over = spark.createDataFrame([("4", "main_train")], "uic string, tier string")
    return ops.stop_tier(_scores(spark, d), _index(spark, d), over)


@query(V, f"with {TIER} select uic, tier from tiers")
def stop_tier(spark, d):
    return _tiers(spark, d)


@query(V, f"with {TIER} select tier, count(*) n from tiers group by 1")
def tier_distribution(spark, d):
    return _tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


@query("fx_lines", "select mode, count(*) n from fx_lines group by 1")
def mode_counts(spark, d):
    return view(spark, d, "fx_lines").groupBy("mode").agg(F.count("*").alias("n"))


@query("fx_lines", "select least(9, floor(score * 10))::int bucket, count(*) n from fx_lines group by 1")
def score_histogram(spark, d):
    return ops.score_histogram(view(spark, d, "fx_lines"))


@query("", "with s as (select (p_partkey * 37 % 1009)::double score from part), r as (select score, row_number() over (order by score) - 1 k, count(*) over () n from s where score > 0) select p::double p, score as value from r join (values (0.2), (0.5), (0.8), (0.9), (0.99), (1.0)) t(p) on k = least(floor(p * n), n - 1)")
def score_percentiles(spark, d):
    return ops.score_percentiles(view(spark, d, "part").select((C("p_partkey") * 37 % 1009).cast("double").alias("score")), [0.2, 0.5, 0.8, 0.9, 0.99, 1.0])


@query(V, "select uic, min_by(mode, case mode when 'regional_bus' then 0 when 'bus' then 1 when 'tram' then 2 when 'metro' then 3 when 'train' then 4 when 'ferry' then 5 else 6 end) mode from fx_line_stops join fx_lines using (line_id) group by 1")
def highest_mode(spark, d):
    m = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").select("line_id", "mode"), "line_id")
    return ops.highest_mode(m.select("uic", "mode"))


@query("fx_line_stops fx_lines fx_stations fx_stop_times fx_stops", """with d as (select uic, avg(greatest(0, dep - arr)) s from fx_stop_times join fx_stops using (stop_id) group by 1), b as (select uic, case cast(uic as int) % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end p from fx_stations), n as (select uic, cast(uic as int) % 6 n from fx_stations where cast(uic as int) % 6 > 0),
k as (select uic, count(distinct line_id) k, bool_or(mode = 'train') t from fx_line_stops join fx_lines using (line_id) group by 1)
select s.uic, (case when coalesce(d.s, 0) > 180 then 3 when coalesce(d.s, 0) > 0 then 2 else 0 end + b.p + case when not coalesce(t, false) then 0 when coalesce(n, 0) > 3 then 3 when coalesce(n, 0) > 0 then 2 else 0 end + case when coalesce(k, 0) >= 2 then case when t then 3 else 2 end else 0 end)::int points from fx_stations s left join d using (uic) left join b using (uic) left join n using (uic) left join k using (uic)""")
def stop_importance(spark, d):
    u = C("uic").cast("int")
    st = view(spark, d, "fx_stations")
    dwell = view(spark, d, "fx_stop_times").join(view(spark, d, "fx_stops").select("stop_id", "uic"), "stop_id").groupBy("uic").agg(F.avg(F.greatest(F.lit(0), C("dep") - C("arr"))).alias("avg_s"))
    bracket = st.select("uic", F.when(u % 4 == 0, "city").when(u % 4 == 1, "town").when(u % 4 == 2, "village").otherwise("rural").alias("bracket"))
    nearby = st.where(u % 6 > 0).select("uic", (u % 6).alias("n"))
    lines = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").select("line_id", "mode"), "line_id")
    return ops.stop_importance(st, dwell, bracket, nearby, lines.select("uic", "line_id", "mode"))


@query("fx_places", "select place_id % 80 uic, arg_min(name, (coalesce(list_position(['train','metro','tram','bus','mountain','ferry','regional_bus'], m), 100), place_id)) as name from (select *, ['bus','tram','train','ferry','x'][place_id * 7 % 5 + 1] m from fx_places) group by 1")
def station_search_index(spark, d):
    m = F.get(F.array(*[F.lit(x) for x in ("bus", "tram", "train", "ferry", "x")]), (C("place_id") * 7 % 5).cast("int"))
    p = view(spark, d, "fx_places").select((C("place_id") % 80).alias("uic"), "name", m.alias("mode"), F.lit("normal_stop").alias("tier"), C("place_id").alias("ord"))
    return ops.station_search_index(p).select("uic", "name")


@query("fx_places", """with s as (select place_id uic, name || case when place_id % 3 = 0 then ' nord' else '' end as name, ['bus','tram','train'][place_id % 3 + 1] mode from fx_places), q as (select place_id q_id, lower(substr(name, 1, 3 + (place_id % 6)::int)) txt from fx_places where place_id % 20 = 0),
t as (select q_id, string_split(trim(txt), ' ') tk from q), w as (select *, string_split(name, ' ') ws from s),
m as (select q_id, uic, mode, case when len(list_filter(tk, lambda t: not contains(name, t))) > 0 then 0
 when len(list_filter(tk, lambda t: not list_contains(ws, t))) = 0 and len(list_distinct(list_transform(tk, lambda t: list_position(ws, t)))) = len(ws) then 100
 when len(list_filter(tk, lambda t: len(list_filter(ws, lambda x: starts_with(x, t))) = 0)) = 0 and len(list_filter(tk, lambda t: list_position(ws, t) = 1)) > 0 then 80
 when len(list_filter(tk, lambda t: starts_with(ws[1], t))) > 0 then 70 when len(list_filter(tk, lambda t: not list_contains(ws, t))) = 0 then 50 when len(list_filter(tk, lambda t: list_contains(ws, t))) > 0 then 40
 when len(list_filter(tk, lambda t: len(list_filter(ws, lambda x: starts_with(x, t))) = 0)) = 0 then 30 when len(list_filter(tk, lambda t: len(list_filter(ws, lambda x: starts_with(x, t))) > 0)) > 0 then 20 else 10 end mt from t, w),
r as (select q_id, uic, round(5.0 * mt + case mode when 'train' then 100 when 'tram' then 400 / 6.0 else 50 end + 100.0 / 11, 6)::double score from m where mt > 0), k as (select *, row_number() over (partition by q_id order by score desc, uic) rank from r) select q_id, uic, score, rank from k where rank <= 8""")
def search_stations(spark, d):
    p = view(spark, d, "fx_places")
    mode = F.get(F.array(F.lit("bus"), F.lit("tram"), F.lit("train")), (C("place_id") % 3).cast("int"))
    s = p.select(C("place_id").alias("uic"), F.concat("name", F.when(C("place_id") % 3 == 0, " nord").otherwise("")).alias("name"), mode.alias("mode"), F.lit("normal_stop").alias("tier"))
    q = p.where("place_id % 20 = 0").select(C("place_id").alias("q_id"), F.substr("name", F.lit(1), (3 + C("place_id") % 6).cast("int")).alias("text"))
    return ops.search_stations(q, s)


@query(V, """with b as (select line_id, min(lon) w, min(lat) s, max(lon) e, max(lat) n, min_by(stop_name, seq) || ' ↔ ' || max_by(stop_name, seq) t from fx_line_stops group by 1), m as (select distinct uic, line_id from fx_line_stops),
x as (select uic, ref, mode, string_agg(line_id::varchar, ';' order by line_id) keys, min(w) w, min(s) s, max(e) e, max(n) n, min_by(t, line_id) route from m join fx_lines using (line_id) join b using (line_id) group by 1, 2, 3)
select uic, (row_number() over (partition by uic order by list_position(['train','metro','tram','bus','mountain','ferry','regional_bus'], mode), ref))::bigint k, ref, mode, keys, route, round(w, 5) w, round(s, 5) s, round(e, 5) e, round(n, 5) n from x""")
def station_lines(spark, d):
    s = view(spark, d, "fx_line_stops")
    box = s.groupBy("line_id").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"), F.concat(F.min_by("stop_name", "seq"), F.lit(" ↔ "), F.max_by("stop_name", "seq")).alias("route"))
    l = ops.station_lines(s, view(spark, d, "fx_lines").select("line_id", "ref", "mode").join(box, "line_id"))
    l = l.select("uic", F.posexplode("lines").alias("k", "l")).select("uic", (C("k") + 1).cast("long").alias("k"), "l.*")
    return l.select("uic", "k", "ref", "mode", F.array_join("keys", ";").alias("keys"), "route", *[F.round(c, 5).alias(c) for c in "wsen"])


@query(V, "select uic, ';' || string_agg(cast(line_id as varchar), ';' order by line_id) || ';' keys from (select distinct uic, line_id from fx_line_stops) group by 1")
def station_line_keys(spark, d):
    g = view(spark, d, "fx_line_stops").groupBy("uic").agg(F.array_sort(F.collect_set("line_id")).alias("k"))
    return g.select("uic", F.concat(F.lit(";"), F.array_join(F.transform("k", lambda x: x.cast("string")), ";"), F.lit(";")).alias("keys"))


@query(V, "select uic, round(sum(score), 6) dep_hr from (select distinct uic, line_id from fx_line_stops) join fx_lines using (line_id) group by 1")
def departures_per_hour(spark, d):
    s = view(spark, d, "fx_line_stops").select("uic", "line_id").distinct().join(view(spark, d, "fx_lines").select("line_id", "score"), "line_id")
    return s.groupBy("uic").agg(F.round(F.sum("score"), 6).alias("dep_hr"))


@query(V, "select uic, line_id, min(seq) idx, bool_or(seq = lo) is_first, bool_or(seq = hi) is_last from (select *, min(seq) over (partition by line_id) lo, max(seq) over (partition by line_id) hi from fx_line_stops) group by 1, 2")
def stop_lines(spark, d):
    f = line_ops.first_last_flags(view(spark, d, "fx_line_stops"))
    return f.groupBy("uic", "line_id").agg(F.min("seq").alias("idx"), F.bool_or("is_first").alias("is_first"), F.bool_or("is_last").alias("is_last"))


@query(V, "select uic cluster, count(distinct line_id) n from fx_line_stops group by 1")
def line_count(spark, d):
    return view(spark, d, "fx_line_stops").groupBy(C("uic").alias("cluster")).agg(F.count_distinct("line_id").alias("n"))


@query(V, """with m as (select uic, mode, colour, score width, stop_id, list_position(['train','metro','tram','bus','mountain','ferry','regional_bus'], mode) r, round(('0x' || colour[2:3])::int * 0.299 + ('0x' || colour[4:5])::int * 0.587 + ('0x' || colour[6:7])::int * 0.114, 6) k from fx_line_stops join fx_lines using (line_id))
select uic cluster, arg_min(mode, (r, k, stop_id)) mode, arg_min(colour, (r, k, stop_id)) colour, arg_min(stop_id, (r, k, stop_id)) stop_id, max(width) width from m group by 1""")
def dominant_line(spark, d):
    m = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines"), "line_id")
    return ops.dominant_line(m.select(C("uic").alias("cluster"), "mode", "colour", C("score").alias("width"), "stop_id"))


@query("fx_places fx_stations", f"select place_id stop_id, name display_name from fx_places p where exists (select 1 from fx_stations s where s.uic = cast(p.place_id % 30 as varchar) and {hav('p.lon', 'p.lat', 's.lon', 's.lat')} <= 150)")
def display_names(spark, d):
    p = view(spark, d, "fx_places").select(C("place_id").alias("stop_id"), F.concat((C("place_id") % 30).cast("string"), F.lit(", "), "name").alias("name"), "lon", "lat")
    return ops.display_names(p, view(spark, d, "fx_stations").select(C("uic").alias("key"), "lon", "lat"), F.lower(F.substring_index("name", ",", 1)), 150.0)


@query("fx_line_stops", """with p as (select distinct uic, line_id from fx_line_stops), n as (select a.line_id a, b.line_id b, count(*) c from p a join p b using (uic) where a.line_id < b.line_id group by 1, 2), x as (select distinct p.uic from p join p q using (uic) join n on n.a = p.line_id and n.b = q.line_id where c <= 2) select distinct p.uic, x.uic is not null hit from p left join x using (uic)""")
def interchange_flag(spark, d):
    p = view(spark, d, "fx_line_stops").select(F.lit(0).alias("at"), "uic", C("line_id").alias("line_key")).distinct()
    hit = crossing_stations(p).select("uic", F.lit(True).alias("hit"))
    return p.select("uic").distinct().join(hit, "uic", "left").select("uic", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("fx_line_stops fx_lines", f"""with f as (select line_id, min_by(stop_id, seq) a, max_by(stop_id, seq) b, min_by(lon, seq) ax, min_by(lat, seq) ay, max_by(lon, seq) + line_id % 4 * 0.00005 bx, max_by(lat, seq) y, mode in ('ferry', 'mountain') exempt from fx_line_stops join fx_lines using (line_id) group by line_id, mode),
p as (select distinct d.line_id from f d join f r on r.b = d.a and r.line_id <> d.line_id and not r.exempt and not d.exempt and {hav('d.ax', 'd.ay', 'r.bx', 'r.y')} * 1000 <= 10) select f.line_id, p.line_id is not null skip_first from f left join p using (line_id)""")
def terminus_pairing(spark, d):
    s = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").select("line_id", C("mode").isin("ferry", "mountain").alias("exempt")), "line_id")
    e = s.groupBy("line_id", "exempt").agg(F.min_by(F.struct("stop_id", "lon", "lat"), "seq").alias("departure"), F.max_by(F.struct("stop_id", (C("lon") + C("line_id") % 4 * 0.00005).alias("lon"), "lat"), "seq").alias("arrival"))
    return ops.terminus_pairing(e)


@query("fx_line_stops", "select distinct a.line_id from fx_line_stops a join fx_line_stops b on a.line_id = b.line_id and b.seq > a.seq and cast(b.uic as int) % 5 = cast(a.uic as int) % 5 and cast(b.stop_id as int) % 2 = 0 join (select line_id, max(seq) m from fx_line_stops group by 1) l on l.line_id = a.line_id and b.seq < m where a.seq = 1 and cast(a.stop_id as int) % 2 = 1")
def layover_skip(spark, d):
    s = view(spark, d, "fx_line_stops").select("line_id", "seq", (C("uic").cast("int") % 5).alias("u"), (C("stop_id").cast("int") % 2 == 0).alias("code"))
    last = s.groupBy("line_id").agg(F.max("seq").alias("m"))
    a = s.where("seq = 1 and not code").select("line_id", "u")
    b = s.join(last, "line_id").where("seq > 1 and seq < m and code").select("line_id", "u")
    return a.join(b, ["line_id", "u"], "left_semi").select("line_id")
