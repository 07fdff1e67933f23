"""Queries of column functions and simple filters, over the adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from linienwerk.operators.usage import BOTS
from linienwerk.functions import geo, line, text, times, trip
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query

C = F.col

#: SQL of the bucket of a route type, for the oracles.
BUCKET = """case when route_type in ('100','101','102','103','105','106','107','109') then 'train' when route_type in ('116','1300','1303','1400') then 'mountain'
 when route_type = '401' then 'metro' when route_type in ('700','702','800') then 'bus' when route_type = '900' then 'tram' when route_type = '1000' then 'ferry' else '' end"""


@query("fx_stop_times", "select trip_id, seq, case when dep % 97 = 0 then null else (dep // 3600) * 3600 + dep % 3600 end secs from fx_stop_times")
def parse_gtfs_time(spark, d):
    t = view(spark, d, "fx_stop_times")
    s = F.when(C("dep") % 97 == 0, "bad").otherwise(F.format_string("%02d:%02d:%02d", F.floor(C("dep") / 3600), F.floor(C("dep") % 3600 / 60), C("dep") % 60))
    return t.select("trip_id", "seq", times.parse_gtfs_time(s).cast("long").alias("secs"))


@query("fx_places", "select place_id, lon between 5.93 and 10.52 and lat between 45.8 and 47.83 inside from fx_places")
def in_bbox(spark, d):
    return view(spark, d, "fx_places").select("place_id", geo.in_bbox(C("lon"), C("lat")).alias("inside"))


@query("", "select s_suppkey agency_id from supplier where contains(lower(s_name), '#00000001') or contains(lower(s_name), '#00000007')")
def excluded_agencies(spark, d):
    tokens = F.array(F.lit("#00000001"), F.lit("#00000007"))
    return view(spark, d, "supplier").where(F.exists(tokens, lambda t: F.contains(F.lower("s_name"), t))).select(C("s_suppkey").alias("agency_id"))


@query("fx_routes", "select route_id, case when agency_id in (2, 5) then 'agency' when upper(trim(short_name)) like '3%' then 'ev_route' end reason from fx_routes where agency_id in (2, 5) or upper(trim(short_name)) like '3%'")
def excluded_routes(spark, d):
    r = view(spark, d, "fx_routes")
    reason = F.when(C("agency_id").isin(2, 5), "agency").when(F.startswith(F.upper(F.trim("short_name")), F.lit("3")), "ev_route")
    return r.select("route_id", reason.alias("reason")).where("reason is not null")


@query("fx_stop_times", "select trip_id, seq, arr, greatest(arr, dep - 40) dep, dep - 40 < arr repaired from fx_stop_times")
def repair_times(spark, d):
    t = view(spark, d, "fx_stop_times").withColumn("dep", C("dep") - 40)
    return t.select("trip_id", "seq", "arr", F.greatest("arr", "dep").alias("dep"), (C("dep") < C("arr")).alias("repaired"))


@query("", "select p_partkey k, " + BUCKET.replace("route_type", "cast(p_partkey % 1500 as varchar)") + " t from part")
def route_bucket(spark, d):
    return view(spark, d, "part").select(C("p_partkey").alias("k"), line.route_bucket((C("p_partkey") % 1500).cast("string")).alias("t"))


@query("fx_routes", f"select route_id, case when b = 'train' and agency_id in (1, 3) then 'mountain' else b end bucket from (select *, {BUCKET} b from fx_routes)")
def rebucket_mountain(spark, d):
    return view(spark, d, "fx_routes").select("route_id", line.rebucket_mountain(line.route_bucket(C("route_type")), C("agency_id").cast("string"), ["1", "3"]).alias("bucket"))


@query("", """with x as (select p_partkey k, case when p_size % 3 = 0 then 'N' || p_partkey % 7 when p_size % 3 = 1 then cast(p_partkey as varchar) else 'B' end ref, ['146','153','9'][p_size % 3 + 1] a, p_retailprice / 100.0 km, case when p_partkey % 5 = 0 then '800' else '700' end rt from part),
y as (select *, regexp_replace(ref, '[^0-9]', '', 'g') dg from x)
select k, case when rt = '800' then 'bus' when length(dg) = 3 and a in ('153','792') and dg[1] in ('1','3') then 'bus' when length(dg) >= 3 then 'regional_bus'
 when length(dg) = 2 and a in ('146','605','859','766','236','801','7088','812','819') then 'regional_bus' when length(dg) = 0 and km >= 10 then 'regional_bus' else 'bus' end m from y""")
def bus_mode(spark, d):
    p = view(spark, d, "part")
    ref = F.when(C("p_size") % 3 == 0, F.concat(F.lit("N"), (C("p_partkey") % 7).cast("string"))).when(C("p_size") % 3 == 1, C("p_partkey").cast("string")).otherwise("B")
    agency = F.get(F.array(F.lit("146"), F.lit("153"), F.lit("9")), C("p_size") % 3)
    return p.select(C("p_partkey").alias("k"), line.bus_mode(F.lit("bus"), agency, ref, C("p_retailprice") / 100, F.when(C("p_partkey") % 5 == 0, "800").otherwise("700")).alias("m"))


@query("fx_routes", f"select route_id, case when b = 'mountain' then case route_type when '1400' then 'funicular' when '1300' then 'aerial' when '1303' then 'aerial' when '116' then 'rack' end end origin from (select *, {BUCKET} b from fx_routes)")
def mountain_origin(spark, d):
    return view(spark, d, "fx_routes").select("route_id", line.mountain_origin(line.route_bucket(C("route_type")), C("route_type")).alias("origin"))


@query("fx_routes", f"select route_id, b = 'ferry' or route_type in ('1300','1303','1400') ge, route_type in ('1300','1303','1400') fge from (select *, {BUCKET} b from fx_routes)")
def gate_exempt(spark, d):
    b = line.route_bucket(C("route_type"))
    o = line.mountain_origin(b, C("route_type"))
    return view(spark, d, "fx_routes").select("route_id", line.gate_exempt(b, o).alias("ge"), line.freq_gate_exempt(b, o).alias("fge"))


@query("fx_stops", "select stop_id, case when uic in ('7') then true when uic in ('12', '85') then false else starts_with(uic, '85') end inside from (select stop_id, case when cast(uic as int) % 2 = 0 then '85' || uic else uic end uic from fx_stops)")
def in_service_area(spark, d):
    uic = F.when(C("uic").cast("int") % 2 == 0, F.concat(F.lit("85"), "uic")).otherwise(C("uic"))
    return view(spark, d, "fx_stops").select("stop_id", line.in_service_area(uic, ["7"], ["12", "85"]).alias("inside"))


@query("fx_lines", "select line_id, mode = 'train' and (upper(ref) like 'IC%' or upper(ref) like 'EC%') ic, case when mode = 'train' then case when upper(ref) like 'IC%' or upper(ref) like 'EC%' then 6.0 when upper(ref) like 'IR%' then 5.0 when upper(ref) like 'RE%' or regexp_matches(upper(ref), '^R($|[^A-Z])') then 4.0 else 3.0 end when mode in ('mountain','ferry') then 3.0 when mode = 'metro' then 2.0 when mode = 'tram' then 1.5 else 1.0 end w from fx_lines")
def train_class_weight(spark, d):
    return view(spark, d, "fx_lines").select("line_id", line.is_intercity(C("ref"), C("mode")).alias("ic"), line.line_weight(C("ref"), C("mode")).alias("w"))


@query("fx_lines", "select line_id from fx_lines where mode = 'train' and (upper(ref) like 'IC%' or upper(ref) like 'ICE%' or upper(ref) like 'EC%')")
def is_intercity(spark, d):
    return view(spark, d, "fx_lines").where(line.is_intercity(C("ref"), C("mode"))).select("line_id")


@query("fx_lines", "select concat_ws('~', ref, agency_id, mode, route_type) key from fx_lines")
def line_key(spark, d):
    return view(spark, d, "fx_lines").select(text.line_key(C("ref"), C("agency_id"), C("mode"), C("route_type")).alias("key"))


@query("fx_access_log", f"""select event_id, regexp_matches(regexp_extract(line, '"([^"]*)"$', 1), '(?i){BOTS}') bot from fx_access_log""")
def is_bot(spark, d):
    from linienwerk.operators.usage import is_bot as bot

    return view(spark, d, "fx_access_log").select("event_id", bot(F.regexp_extract("line", '"([^"]*)"$', 1)).alias("bot"))


@query("fx_places", "select place_id, name from fx_places where category not in ('Brand#3', 'Brand#5') and not (category = 'Brand#7' and kind = 'SMALL') and lon between 5.93 and 10.52 and lat between 45.8 and 47.83")
def geocode_exclude(spark, d):
    rules = spark.createDataFrame([("Brand#3", None), ("Brand#5", None), ("Brand#7", "SMALL")], "category string, k string")
    p = view(spark, d, "fx_places")
    out = p.join(F.broadcast(rules), (p["category"] == rules["category"]) & (rules["k"].isNull() | (p["kind"] == rules["k"])), "left_anti")
    return out.where(geo.in_bbox(C("lon"), C("lat"))).select("place_id", "name")


@query("fx_stops", "select stop_id, lon from fx_stops where cast(stop_id as int) % 9 <> 0")
def drop_unlocated(spark, d):
    s = view(spark, d, "fx_stops").withColumn("lon_text", F.when(C("stop_id").cast("int") % 9 == 0, "n/a").otherwise(C("lon").cast("string")))
    return s.withColumn("lon", F.expr("try_cast(lon_text as double)")).where("lon is not null").select("stop_id", "lon")


@query("fx_stops", "select stop_id, lat, lon, stop_name as name from fx_stops where cast(stop_id as int) % 4 <> 1")
def hop_candidates(spark, d):
    s = view(spark, d, "fx_stops").withColumn("location_type", F.when(C("stop_id").cast("int") % 4 == 1, "1").when(C("stop_id").cast("int") % 4 == 2, "").otherwise("0"))
    return s.where(F.coalesce(C("location_type"), F.lit("")).isin("", "0")).select("stop_id", "lat", "lon", C("stop_name").alias("name"))


@query("", "select p_partkey k, strip_accents(lower(replace(replace(p_name, 'u', 'Ü'), 'e', 'é'))) f, len(list_filter(regexp_split_to_array(p_name, '[^a-zA-Z]+'), lambda x: x <> '')) n from part")
def fold(spark, d):
    p = view(spark, d, "part")
    return p.select(C("p_partkey").alias("k"), text.fold(F.replace(F.replace(C("p_name"), F.lit("u"), F.lit("Ü")), F.lit("e"), F.lit("é"))).alias("f"), F.size(text.name_words(C("p_name"))).cast("long").alias("n"))


@query("fx_lines", "select line_id, coalesce(nullif(lower(replace(case when line_id % 3 = 0 then '' else 'S ' || ref end, ' ', '')), ''), ref) n from fx_lines")
def name_norm(spark, d):
    long_name = F.when(C("line_id") % 3 == 0, "").otherwise(F.concat(F.lit("S "), "ref"))
    return view(spark, d, "fx_lines").select("line_id", text.name_norm(long_name, C("ref")).alias("n"))


@query("", """with x as (select p_partkey k, case when p_partkey % 3 = 0 then split_part(p_name, ' ', 1) || ', ' || p_type when p_partkey % 3 = 1 then p_name else upper(split_part(p_name, ' ', 1)) || 'x ' || p_type end dest, split_part(p_name, ' ', 1) || ', Stop' here, split_part(p_name, ' ', 1) city from part),
y as (select *, case when lower(dest) like lower(city) || ',%' or lower(dest) like lower(city) || ' %' then trim(substr(dest, length(city) + 2)) else dest end s from x)
select k, s stripped, coalesce(nullif(trim(split_part(s, ',', 1)), ''), dest) short from y""")
def shorten_destination(spark, d):
    p = view(spark, d, "part")
    first = F.substring_index("p_name", " ", 1)
    dest = F.when(C("p_partkey") % 3 == 0, F.concat(first, F.lit(", "), "p_type")).when(C("p_partkey") % 3 == 1, C("p_name")).otherwise(F.concat(F.upper(first), F.lit("x "), "p_type"))
    return p.select(C("p_partkey").alias("k"), text.strip_city_prefix(dest, first).alias("stripped"), text.shorten_destination(dest, F.concat(first, F.lit(", Stop"))).alias("short"))


@query("", "select p_partkey k, p_name n from part")
def strip_mode_suffix(spark, d):
    suffix = F.get(F.array(F.lit(" (Tram)"), F.lit(" (bus)"), F.lit("(ZUG)"), F.lit("")), C("p_size") % 4)
    return view(spark, d, "part").select(C("p_partkey").alias("k"), text.strip_mode_suffix(F.concat("p_name", suffix)).alias("n"))


@query("", "select p_partkey k, [lower(p_name), lower(split_part(p_name, ' ', 1))] c from part")
def city_keys(spark, d):
    return view(spark, d, "part").select(C("p_partkey").alias("k"), text.city_keys(F.concat("p_name", F.lit(", "), "p_type")).alias("c"))


@query("", "select p_partkey k, regexp_extract(p, '^([0-9]+)', 1) n, coalesce(nullif(regexp_extract(p, '^([0-9]+)', 1), ''), p) t from (select p_partkey, case when p_partkey % 2 = 0 then p_size || 'A-D' else 'K' end p from part)")
def platform_number(spark, d):
    code = F.when(C("p_partkey") % 2 == 0, F.concat(C("p_size").cast("string"), F.lit("A-D"))).otherwise("K")
    return view(spark, d, "part").select(C("p_partkey").alias("k"), text.platform_number(code).alias("n"), text.track_from_code(code).alias("t"))


PLACES_SQL = """select event_id, case event_id % 4 when 0 then 'ch_Parent' || (8500000 + user_id) when 1 then 'ch_Parentch:1:sloid:' || user_id when 2 then '47.' || (1000 + user_id) || '7,8.25' else 'Somewhere ' || user_id end raw from events"""


def _raw():
    return F.when(C("event_id") % 4 == 0, F.concat(F.lit("ch_Parent"), (8500000 + C("user_id")).cast("string"))).when(C("event_id") % 4 == 1, F.concat(F.lit("ch_Parentch:1:sloid:"), C("user_id").cast("string"))).when(C("event_id") % 4 == 2, F.concat(F.lit("47."), (1000 + C("user_id")).cast("string"), F.lit("7,8.25"))).otherwise(F.concat(F.lit("Somewhere "), C("user_id").cast("string")))


@query("", f"""select event_id, case event_id % 4 when 0 then 'u:' || substr(raw, 10) when 1 then 'p:' || substr(raw, 4) when 2 then 'c:' || printf('%.3f', split_part(raw, ',', 1)::double) || ',8.250' else '?:' || raw end token,
 case event_id % 4 when 0 then substr(raw, 10) when 1 then 'p:' || substr(raw, 4) when 2 then raw end url, case event_id % 4 when 0 then substr(raw, 10) when 1 then substr(raw, 10) else regexp_extract(raw, '^([0-9]+)', 1) end station from ({PLACES_SQL})""")
def place_token(spark, d):
    e = view(spark, d, "events").withColumn("raw", _raw())
    return e.select("event_id", text.place_token(C("raw")).alias("token"), text.place_url_token(C("raw")).alias("url"), text.station_of(C("raw")).alias("station"))


@query("", "select event_id, case event_id % 3 when 0 then 'current' when 1 then 'point' else 'station' end kind, case event_id % 3 when 0 then 'me' when 1 then printf('%.7f,%.7f', 47 + user_id / 1000.0, 8.5) else cast(user_id as varchar) end again from events")
def parse_endpoint(spark, d):
    token = F.when(C("event_id") % 3 == 0, "me").when(C("event_id") % 3 == 1, F.concat((47 + C("user_id") / 1000).cast("string"), F.lit(",8.5"))).otherwise(C("user_id").cast("string"))
    e = view(spark, d, "events").withColumn("e", text.endpoint(token))
    return e.select("event_id", C("e.type").alias("kind"), text.format_endpoint(C("e.type"), C("e.uic"), C("e.lat"), C("e.lon")).alias("again"))


@query("fx_access_log", "select event_id, regexp_extract(line, 'fromPlace=([^& ]*)', 1) origin, regexp_extract(line, 'toPlace=([^& ]*)', 1) target, null::varchar via from fx_access_log")
def parse_plan_query(spark, d):
    r = F.regexp_extract("line", r'"([^"]*)"', 1)
    return view(spark, d, "fx_access_log").select("event_id", text.query_param(r, "fromPlace").alias("origin"), text.query_param(r, "toPlace").alias("target"), text.query_param(r, "via").alias("via"))


@query("fx_calendar_dates", "select service_id, d, exception_type, case when month(d) in (1,2,3) then 'winter' when month(d) in (6,7,8) then 'summer' end season from fx_calendar_dates")
def season_of(spark, d):
    return view(spark, d, "fx_calendar_dates").select("service_id", "d", "exception_type", times.season_of(C("d")).alias("season"))


@query("fx_access_log", "select event_id, strptime(regexp_extract(line, '\\[([^:]*):', 1), '%d/%b/%Y')::date as day from fx_access_log")
def parse_log_time(spark, d):
    return view(spark, d, "fx_access_log").select("event_id", times.log_day(F.regexp_extract("line", r"\[([^\]]+)\]", 1)).alias("day"))


@query("fx_calendar_dates", """select service_id, list_aggregate([case when c[i] > 0 and c[i] * 2 >= list_max(c) then '1' else '0' end for i in range(1, 8)], 'string_agg', '') mask from
 (select service_id, [count(*) filter (isodow(d) = 1), count(*) filter (isodow(d) = 2), count(*) filter (isodow(d) = 3), count(*) filter (isodow(d) = 4), count(*) filter (isodow(d) = 5), count(*) filter (isodow(d) = 6), count(*) filter (isodow(d) = 7)] c from fx_calendar_dates group by 1)""")
def weekday_mask(spark, d):
    c = view(spark, d, "fx_calendar_dates").groupBy("service_id").agg(F.array(*[F.count_if(F.weekday("d") == k) for k in range(7)]).alias("c"))
    return c.select("service_id", times.weekday_mask(C("c")).alias("mask"))


@query("fx_calendar_dates", "select service_id, (max(d) - min(d) + 1)::int as days, strftime(min(d), '%Y-%m-%d') as first from fx_calendar_dates group by 1")
def day_diff(spark, d):
    return view(spark, d, "fx_calendar_dates").groupBy("service_id").agg((F.datediff(F.max("d"), F.min("d")) + 1).alias("days"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first"))


HAV = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def hav(x1, y1, x2, y2):
    """SQL of the great-circle distance, for the oracles."""
    return HAV.format(a=f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))")


@query("fx_stops", f"select a.stop_id a, b.stop_id b, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) km, round(sqrt(pow((b.lon - a.lon) * 111320 * cos(radians(46.8)), 2) + pow((b.lat - a.lat) * 111320, 2)), 3) m from fx_stops a join fx_stops b on cast(b.stop_id as int) = cast(a.stop_id as int) + 1")
def haversine_km(spark, d):
    a = view(spark, d, "fx_stops").withColumn("k", C("stop_id").cast("int"))
    b = a.select(C("stop_id").alias("b"), C("lon").alias("lon2"), C("lat").alias("lat2"), (C("k") - 1).alias("k"))
    return a.join(b, "k").select(C("stop_id").alias("a"), "b", F.round(geo.haversine_km(C("lon"), C("lat"), C("lon2"), C("lat2")), 6).alias("km"), F.round(geo.planar_m(C("lon"), C("lat"), C("lon2"), C("lat2"), 46.8), 3).alias("m"))


@query("fx_stations", """with b as (select uic, lon - 0.3 w, lat - 0.2 s, lon + 0.3 e, lat + 0.2 n from fx_stations) select a.uic a, b.uic b,
 round(case when least(a.e, b.e) > greatest(a.w, b.w) and least(a.n, b.n) > greatest(a.s, b.s) then (least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)) / least((a.e - a.w) * (a.n - a.s), (b.e - b.w) * (b.n - b.s)) else 0 end, 6) share from b a join b on cast(b.uic as int) = cast(a.uic as int) + 1""")
def bbox_overlap(spark, d):
    box = F.struct((C("lon") - 0.3).alias("w"), (C("lat") - 0.2).alias("s"), (C("lon") + 0.3).alias("e"), (C("lat") + 0.2).alias("n"))
    s = view(spark, d, "fx_stations").select("uic", box.alias("x"), C("uic").cast("int").alias("k"))
    return s.join(s.select(C("uic").alias("b"), C("x").alias("y"), (C("k") - 1).alias("k")), "k").select(C("uic").alias("a"), "b", F.round(geo.bbox_overlap(C("x"), C("y")), 6).alias("share"))


@query("fx_lines", "select line_id, round(1 - 0.5 * pow(0.5, (score * 20 - 1) / 4) - 0.049, 6) t from fx_lines")
def promotion_threshold(spark, d):
    return view(spark, d, "fx_lines").select("line_id", F.round(line.promotion_threshold(C("score") * 20), 6).alias("t"))


@query("fx_lines", """with b as (select *, case mode when 'train' then 4.0 when 'tram' then 8.6 when 'metro' then 12.0 when 'bus' then 10.0 when 'ferry' then 1.33 else 1.0 end best,
 case mode when 'train' then 0.25 when 'tram' then 0.6 when 'metro' then 0.8 when 'bus' then 0.75 when 'ferry' then 0.01 else 0.05 end worst, round(0.6 * score * 9 + 0.2 * score + 0.2 * (1 - score), 6) f from fx_lines),
s as (select *, case when f <= worst then 0 when f >= best then 1 else round(pow((ln(f) - ln(worst)) / (ln(best) - ln(worst)), 2.5), 4) end sc from b)
select line_id, f, sc::double sc, round(case mode when 'train' then 2 + 3 * sc when 'tram' then 0.7 + 2.3 * sc when 'metro' then 1 + 2 * sc when 'bus' then 0.7 + 1.8 * sc when 'ferry' then 1 + 1.5 * sc else 1.5 end, 2)::double width from s""")
def frequency_score(spark, d):
    f = F.round(line.weighted_frequency(C("score") * 9, C("score"), 1 - C("score")), 6)
    s = view(spark, d, "fx_lines").withColumn("f", f).withColumn("sc", line.frequency_score(C("f"), C("mode")))
    return s.select("line_id", "f", "sc", line.line_width(C("sc"), C("mode")).alias("width"))


@query("fx_itineraries", "select itin, round(600.0 * boardings + 2.0 * least(walk_s, 1800) + 0.5 * greatest(walk_s - 1800, 0), 4) score, round(1 + 0.1 * ((walk_s / 60.0) * (walk_s / 60.0) / ((walk_s / 60.0) * (walk_s / 60.0) + 900) + 1 - pow(0.7, boardings)), 6) comfort from fx_itineraries")
def itinerary_score(spark, d):
    return view(spark, d, "fx_itineraries").select("itin", F.round(trip.itinerary_score(C("walk_s"), C("boardings")), 4).alias("score"), F.round(trip.comfort_factor(C("walk_s"), C("boardings")), 6).alias("comfort"))


@query("fx_stations", "select uic, round(100 * exp(-(lon - 5) * 10 / 30.0), 6) s from fx_stations")
def distance_decay(spark, d):
    return view(spark, d, "fx_stations").select("uic", F.round(trip.distance_decay((C("lon") - 5) * 10), 6).alias("s"))


@query("fx_lines", "select line_id, round(case mode when 'train' then 100 when 'metro' then 500 / 6.0 when 'tram' then 400 / 6.0 when 'bus' then 50 when 'mountain' then 200 / 6.0 when 'ferry' then 100 / 6.0 else 0 end, 6) m, round(case when line_id % 13 = 12 then 0 else 100 * (11 - line_id % 13) / 11.0 end, 6)::double t from fx_lines")
def mode_score(spark, d):
    names = "major_train main_train important_train train_station small_train major_mountain ferry_stop mountain_stop major_hub big_station normal_stop small_bus other".split()
    tier = F.get(F.array(*[F.lit(x) for x in names]), (C("line_id") % 13).cast("int"))
    return view(spark, d, "fx_lines").select("line_id", F.round(line.mode_score(C("mode")), 6).alias("m"), F.round(line.tier_score(tier), 6).alias("t"))


@query("fx_stop_times", "select trip_id, substr(sha256(string_agg(stop_id, ',' order by stop_id)), 1, 8) id from (select distinct trip_id, stop_id from fx_stop_times) group by trip_id")
def content_id(spark, d):
    return view(spark, d, "fx_stop_times").groupBy("trip_id").agg(F.collect_set("stop_id").alias("s")).select("trip_id", trip.content_id(C("s")).alias("id"))


@query("", """with r as (select o_custkey route_id, count(*) n from orders group by 1)
select route_id, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(route_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 8 shard from r""")
def shard_of(spark, d):
    r = view(spark, d, "orders").groupBy(C("o_custkey").alias("route_id")).agg(F.count("*").alias("n"))
    return r.withColumn("shard", trip.shard_of(C("route_id"), 8))


@query("fx_itineraries", """with h as (select itin, sha256(concat_ws('|', itin::varchar, query_id::varchar, 'x')) h from fx_itineraries)
select itin, list_aggregate(list_transform(range(8), lambda k: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', ('0x' || substr(h, 2 * k + 1, 2))::int % 62 + 1, 1)), 'string_agg', '') id from h""")
def share_id(spark, d):
    return view(spark, d, "fx_itineraries").select("itin", trip.share_id(C("itin").cast("string"), C("query_id").cast("string"), F.lit("x")).alias("id"))


del query
