"""Queries that write tables in the formats of feeds, maps, logs and shares, and read them back; streams over written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query
from linienwerk.shared import fresh_dir
from linienwerk.sources import features, gtfs
from linienwerk.streaming import jobs

C = F.col


def _feed(spark, table: str, df: DataFrame) -> str:
    folder = fresh_dir(spark, "feed")
    gtfs.sink_feed({table: df}, folder)
    return folder


def _clock(s):
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s / 60 % 60).cast("int"), (s % 60).cast("int"))


@query("fx_stops", "select stop_id, stop_name, round(lon, 6) lon, round(lat, 6) lat from fx_stops")
def scan_gtfs(spark, d):
    s = view(spark, d, "fx_stops").select("stop_id", F.concat(F.lit(" "), "stop_name", F.lit(" ")).alias("stop_name"), C("lat").alias("stop_lat"), C("lon").alias("stop_lon"))
    t = gtfs.scan_gtfs(spark, _feed(spark, "stops", s), "stops")
    return t.select("stop_id", "stop_name", F.round(C("stop_lon").cast("double"), 6).alias("lon"), F.round(C("stop_lat").cast("double"), 6).alias("lat"))


@query("fx_routes fx_trips", "select r.route_id, short_name || ', \"x\"' as name, route_type, count(*) trips from fx_routes r join fx_trips using (route_id) group by all")
def sink_feed(spark, d):
    folder = fresh_dir(spark, "feed")
    routes = view(spark, d, "fx_routes").select("route_id", "agency_id", F.concat("short_name", F.lit(', "x"')).alias("route_short_name"), "route_type")
    gtfs.sink_feed({"routes": routes, "trips": view(spark, d, "fx_trips").select("trip_id", "route_id", "service_id")}, folder)
    r, t = gtfs.scan_gtfs(spark, folder, "routes"), gtfs.scan_gtfs(spark, folder, "trips")
    return r.join(t.select("trip_id", "route_id"), "route_id").groupBy(C("route_id").cast("long").alias("route_id"), C("route_short_name").alias("name"), "route_type").agg(F.count("*").alias("trips"))


@query("fx_stop_times fx_stops", "select x.trip_id shape_id, x.seq::int seq, round(lon, 6) lon, round(lat, 6) lat from fx_stop_times x join fx_stops using (stop_id) where x.arr % 10 <> 3")
def scan_shapes(spark, d):
    j = view(spark, d, "fx_stop_times").join(view(spark, d, "fx_stops"), "stop_id")
    bad = F.when(C("arr") % 10 == 3, F.lit("x")).otherwise(C("lat").cast("string"))
    s = j.select(C("trip_id").alias("shape_id"), bad.alias("shape_pt_lat"), C("lon").alias("shape_pt_lon"), C("seq").alias("shape_pt_sequence"))
    t = gtfs.scan_shapes(spark, _feed(spark, "shapes", s))
    return t.select(C("shape_id").cast("long").alias("shape_id"), "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("fx_trips", "select trip_id, dep0::int start_s, (dep0 + 7200)::int end_s, headway::int headway_s from fx_trips where headway is not null")
def scan_frequencies(spark, d):
    f = view(spark, d, "fx_trips").where("headway is not null").select("trip_id", _clock(C("dep0")).alias("start_time"), _clock(C("dep0") + 7200).alias("end_time"), C("headway").alias("headway_secs"))
    t = gtfs.scan_frequencies(spark, _feed(spark, "frequencies", f))
    return t.select(C("trip_id").cast("long").alias("trip_id"), C("start_s").cast("int").alias("start_s"), C("end_s").cast("int").alias("end_s"), "headway_s")


@query("", "select cast(p_partkey as varchar) sloid, case when p_size % 5 > 0 then p_size / 2.0 end::double length, case when p_size % 3 > 0 then p_size * 7.0 end::double compass from part where p_size % 2 = 0")
def scan_platform_attributes(spark, d):
    k = C("p_size")
    p = view(spark, d, "part").select(C("p_partkey").alias("sloid"), F.when(k % 2 == 0, "BOARDING_PLATFORM").otherwise("BOARDING_AREA").alias("trafficPointElementType"), F.when(k % 5 > 0, (k / 2).cast("string")).otherwise("?").alias("length"), F.when(k % 3 > 0, (k * 7).cast("string")).alias("compassDirection"))
    path = fresh_dir(spark, "platforms")
    p.write.option("header", True).option("sep", ";").csv(path)
    return gtfs.scan_platform_attributes(spark, path)


@query("fx_routes", "select route_id, rule from fx_routes join (values (1, '5', 'a'), (2, '9', 'b')) r(a, n, rule) on agency_id = a and short_name = n")
def load_overrides(spark, d):
    """Rules of routes; the third lacks a name and is skipped."""
    rules = gtfs.load_overrides(spark, [{"agency_id": 1, "short_name": "5", "rule": "a"}, {"agency_id": 2, "short_name": "9", "rule": "b"}, {"agency_id": 3, "rule": "c"}], "agency_id long, short_name string, rule string")
    return view(spark, d, "fx_routes").join(rules, ["agency_id", "short_name"]).select("route_id", "rule")


def _props():
    k = C("p_size")
    tags = {"highway": F.when(k % 5 == 0, F.lit("residential")).when(k % 5 == 1, F.lit("motorway")), "railway": F.when(k % 7 == 0, F.lit("tram")).when(k % 7 == 1, F.lit("rail")).when(k % 7 == 2, F.lit("platform")),
            "building": F.when(k % 4 == 0, F.lit("yes")).when(k % 4 == 1, F.lit("no")), "name": C("p_name"), "landuse": F.when(k % 6 == 0, F.lit("retail")).when(k % 6 == 1, F.lit("forest"))}
    return F.map_filter(F.create_map(*[x for t, v in tags.items() for x in (F.lit(t), v)]), lambda _, v: v.isNotNull())


@query("", """select p_partkey k, rule from part, (values ('rail'), ('tram'), ('street'), ('platform'), ('building'), ('built_up')) r(rule)
where case rule when 'rail' then p_size % 7 = 1 when 'tram' then p_size % 7 = 0 when 'platform' then p_size % 7 = 2 when 'street' then p_size % 5 = 0 when 'building' then p_size % 4 = 0 else p_size % 6 = 0 end""")
def osm_tag_filter(spark, d):
    f = view(spark, d, "part").select(C("p_partkey").alias("k"), _props().alias("props"))
    out = [features.osm_tag_filter(f, r).select("k", F.lit(r).alias("rule")) for r in ("rail", "tram", "street", "platform", "building", "built_up")]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query("", "select p_partkey k, p_name as name, case when p_size % 4 = 0 then 'yes' when p_size % 4 = 1 then 'no' end building, (1 + (p_size % 4 < 2)::int)::int n from part")
def keep_tags(spark, d):
    t = view(spark, d, "part").select(C("p_partkey").alias("k"), features.keep_tags(_props(), ["name", "building"]).alias("p"))
    return t.select("k", C("p")["name"].alias("name"), C("p")["building"].alias("building"), F.size("p").alias("n"))


def _features(spark, d):
    b = view(spark, d, "fx_buildings")
    point = F.array(C("lon"), C("lat"))
    f = F.struct(F.lit("Feature").alias("type"), C("id").cast("string").alias("id"), F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"), F.struct((C("id") % 9).cast("string").alias("kind")).alias("properties"))
    return b.select("id", F.to_json(f).alias("json"))


@query("fx_buildings", "select cast(id as varchar) id, 'Point' geom_type, round(lon, 6) lon, round(lat, 6) lat, cast(id % 9 as varchar) kind from fx_buildings where id % 10 <> 7")
def scan_geojson_seq(spark, d):
    """A tenth of the lines is cut off and goes; half of the others begin with the record separator."""
    path = fresh_dir(spark, "seq")
    line = F.when(C("id") % 10 == 7, F.substring("json", 1, 30)).when(C("id") % 2 == 0, F.concat(F.lit("\u001e"), "json")).otherwise(C("json"))
    _features(spark, d).select(line.alias("value")).write.text(path)
    xy = F.from_json("coords", "array<double>")
    return features.scan_geojson_seq(spark, path).select("id", "geom_type", F.round(xy[0], 6).alias("lon"), F.round(xy[1], 6).alias("lat"), C("props")["kind"].alias("kind"))


@query("fx_line_stops fx_lines", """with s as (select line_id, seq, lon, lat, lag(lon) over w pl, lag(lat) over w pa from fx_line_stops window w as (partition by line_id order by seq)), k as (select * from s where pl is null or pl <> lon or pa <> lat)
select cast(line_id as varchar) id, ref, count(*) n, round(sum(lon), 5) lon, round(sum(lat), 5) lat from k join fx_lines using (line_id) group by 1, 2 having count(*) >= 2""")
def scan_feature_collection(spark, d):
    """A collection for each mode."""
    path = fresh_dir(spark, "collections")
    pts = F.transform("p", lambda x: F.array(x["lon"], x["lat"], F.lit(1.0)))
    g = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p")).join(view(spark, d, "fx_lines").select("line_id", "ref", "mode"), "line_id")
    f = F.struct(F.lit("Feature").alias("type"), C("line_id").cast("string").alias("id"), F.struct(F.lit("LineString").alias("type"), pts.alias("coordinates")).alias("geometry"), F.struct("ref").alias("properties"))
    g = g.groupBy("mode").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(f).alias("features"))).alias("value"))
    g.repartition("mode").write.partitionBy("mode").text(path)
    c = features.scan_feature_collection(spark, path)
    total = lambda k: F.round(F.aggregate("line", F.lit(0.0), lambda a, x: a + x[k]), 5).alias(k)
    return c.select("id", C("props")["ref"].alias("ref"), F.size("line").cast("long").alias("n"), total("lon"), total("lat"))


@query("fx_access_log", "select line from fx_access_log")
def scan_access_log(spark, d):
    path = fresh_dir(spark, "log")
    view(spark, d, "fx_access_log").select(C("line").alias("value")).write.option("compression", "gzip").text(path)
    return features.scan_access_log(spark, path)


@query("fx_line_stops fx_lines", "select cast(line_id as varchar) line_id, ref, 'LineString' geom_type, count(*)::int n, round(sum(lon), 5) lon from fx_line_stops join fx_lines using (line_id) group by 1, 2")
def sink_features(spark, d):
    path = fresh_dir(spark, "features")
    g = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p")).join(view(spark, d, "fx_lines").select("line_id", "ref"), "line_id")
    features.sink_features(g.select("line_id", "ref", F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("lon_lat"), F.lit(5).alias("min_zoom")), path)
    xy = F.from_json("coords", "array<array<double>>")
    return features.scan_geojson_seq(spark, path).select(C("props")["line_id"].alias("line_id"), C("props")["ref"].alias("ref"), "geom_type", F.size(xy).alias("n"), F.round(F.aggregate(xy, F.lit(0.0), lambda a, x: a + x[0]), 5).alias("lon"))


@query("fx_line_stops fx_lines", "select case when mode in ('train', 'mountain', 'metro') then 'rail' when mode = 'tram' then 'tram' when mode = 'regional_bus' then 'regional' else 'bus' end grp, mode, count(*) n from fx_line_stops join fx_lines using (line_id) group by 1, 2")
def sink_by_mode_group(spark, d):
    path = fresh_dir(spark, "groups")
    s = view(spark, d, "fx_line_stops").join(view(spark, d, "fx_lines").select("line_id", "mode"), "line_id")
    features.sink_by_mode_group(s.select("uic", "line_id", "mode"), path)
    return spark.read.schema("uic string, line_id long, mode string, grp string").parquet(path).groupBy("grp", "mode").agg(F.count("*").alias("n"))


@query("fx_lines", "select line_id, ref, colour from fx_lines")
def sink_lookup_json(spark, d):
    path = fresh_dir(spark, "lookup")
    features.sink_lookup_json(view(spark, d, "fx_lines").select("line_id", "ref", "colour"), "line_id", path)
    return spark.read.schema("line_id long, ref string, colour string").json(path)


LEGS = "l as (select itin, count(*) n, arg_min(from_stop, seq) a, arg_max(to_stop, seq) b from fx_legs group by 1)"


@query("fx_legs", f"with {LEGS} select itin id, itin % 7 <> 3 and itin % 5 <> 2 and itin % 11 <> 1 and n <= 30 valid from l")
def validate_share(spark, d):
    """Shares of all journeys: some of an unknown version, with a colour too few, or with an endpoint off the globe."""
    leg = F.struct(C("mode"), F.lit("2026-01-01T10:00").alias("startTime"), F.lit("2026-01-01T11:00").alias("endTime"))
    g = view(spark, d, "fx_legs").groupBy(C("itin").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", leg.alias("leg")))).alias("l"))
    i, n = C("id"), F.size("l")
    colours = F.array_repeat(F.lit("#00ff00"), F.when(i % 5 == 2, n - 1).otherwise(n))
    share = F.struct(F.when(i % 7 == 3, 2).otherwise(1).alias("v"), F.lpad(F.lower(F.hex("id")), 8, "0").alias("fingerprint"), F.struct(F.lit("station").alias("type"), F.lit("8500").alias("uic")).alias("from"),
                     F.struct(F.lit("point").alias("type"), F.when(i % 11 == 1, 97.0).otherwise(47.0).alias("lat"), F.lit(8.0).alias("lon")).alias("to"),
                     F.struct(F.lit("2026-01-01T10:00").alias("startTime"), F.lit("2026-01-01T11:00").alias("endTime"), F.transform("l", lambda x: x["leg"]).alias("legs")).alias("itinerary"), colours.alias("legColors"))
    return features.validate_share(g.select("id", F.to_json(share).alias("json"))).select("id", "valid")


@query("fx_legs fx_stops", f"""with {LEGS} select itin, case when itin % 2 = 0 then 'point' else 'station' end from_type, case when itin % 2 = 0 then null else '8500' end from_uic, case when itin % 2 = 0 then round(x.lat, 6) end from_lat,
case when itin % 3 = 0 then 'point' else 'station' end to_type, case when itin % 3 = 0 then round(y.lat, 6) end to_lat, n::int n, 'from mode to' fields from l left join fx_stops x on x.stop_id = a left join fx_stops y on y.stop_id = b""")
def strip_itinerary(spark, d):
    at = view(spark, d, "fx_stops").select("stop_id", "lat", "lon")
    legs = view(spark, d, "fx_legs").join(at.select(C("stop_id").alias("from_stop"), F.struct("lat", "lon").alias("from")), "from_stop", "left").join(at.select(C("stop_id").alias("to_stop"), F.struct("lat", "lon").alias("to")), "to_stop", "left")
    g = legs.groupBy("itin").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("mode", "from", "to", F.lit("_p~iF").alias("legGeometry"), F.array(F.lit("x")).alias("intermediateStops")).alias("leg")))).alias("l")).select("itin", F.transform("l", lambda x: x["leg"]).alias("legs"))
    end = lambda n: F.struct(F.when(C("itin") % n == 0, "current").otherwise("station").alias("type"), F.when(C("itin") % n != 0, "8500").alias("uic"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    a, b, bare = features.strip_itinerary(end(2), end(3), C("legs"))
    t = g.select("itin", a.alias("a"), b.alias("b"), bare.alias("legs"))
    fields = " ".join(sorted(t.schema["legs"].dataType.elementType.names))
    return t.select("itin", C("a.type").alias("from_type"), C("a.uic").alias("from_uic"), F.round("a.lat", 6).alias("from_lat"), C("b.type").alias("to_type"), F.round("b.lat", 6).alias("to_lat"), F.size("legs").alias("n"), F.lit(fields).alias("fields"))


def _streamed(spark, df: DataFrame, job, ts: str | None = None, batches: int = 4) -> DataFrame:
    """What a job gives for the table's rows as a stream of files, once all are read; with ``ts`` in micro-batches, one for each stretch of time."""
    src, out = fresh_dir(spark, "stream-in"), fresh_dir(spark, "stream-out")
    if ts is None:
        df.write.parquet(src)
    else:
        a, b = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
        cut = F.least(F.lit(batches - 1), F.floor((F.unix_micros(ts) - (a or 0)) * batches / (((b or 0) - (a or 0)) or 1)))
        for k in range(batches):  # files are read in the order of their writing
            df.where(cut == k).coalesce(1).write.mode("append").parquet(src)
    reader = spark.readStream.schema(df.schema)
    live = job((reader if ts is None else reader.option("maxFilesPerTrigger", 1)).parquet(src))
    live.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", fresh_dir(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(out)


@query("fx_access_log", """with p as (select strptime(regexp_extract(line, '\\[([^:]*):', 1), '%d/%b/%Y')::date as day, contains(line, 'Googlebot') bot, split_part(line, ' ', 1) ip from fx_access_log)
select day, count(*) filter (not bot) hits, count(*) filter (not bot) plans, count(distinct ip) filter (not bot) unique_ips, count(*) filter (bot) bots from p group by day having day <= (select max(day) - 2 from p)""")
def stream_daily_access(spark, d):
    """Days that the watermark has closed; the batch twin counts them anew."""
    return _streamed(spark, view(spark, d, "fx_access_log").select("line"), lambda s: jobs.stream_daily_access(s, "1 day")).select("day", "hits", "plans", "unique_ips", "bots")


@query("", """with recursive e as (select event_id, user_id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) k from events),
r(event_id, user_id, t, k, kept, accepted) as (select null::bigint, user_id, null::bigint, 0::bigint, []::bigint[], null::boolean from e group by user_id
 union all select event_id, user_id, t, k, case when len(kept) < 2 then list_append(kept, t) else kept end, len(kept) < 2
 from (select e.*, list_filter(r.kept, lambda x: x > e.t - 7200000000) kept from r join e on e.user_id = r.user_id and e.k = r.k + 1) n)
select event_id, accepted from r where t < (select max(t) // 1000 * 1000 - 172800000000 from e)""")
def stream_throttle(spark, d):
    """Events that the watermark has passed, in four micro-batches."""
    e = view(spark, d, "events").select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _streamed(spark, e, lambda s: jobs.stream_throttle(s, "user_id", "ts", 7200, 2, "2 days", ("event_id",)), "ts").select("event_id", "accepted")


@query("", "select distinct user_id share_id from events")
def stream_create_once(spark, d):
    e = view(spark, d, "events").select(C("user_id").alias("share_id"), C("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, e, lambda s: jobs.stream_create_once(s, late="60 days")).select("share_id")
