"""Cleaning of a timetable feed: overrides, filters with their cascades, splits, inserted way points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.functions.geo import DEGREE_M, in_bbox, planar_m
from linienwerk.functions.text import track_from_code
from linienwerk.sources.features import line_points


def apply_stop_overrides(stops: DataFrame, overrides: DataFrame) -> DataFrame:
    """``stops, overrides (key, lon, lat) → stops``: moved by exact stop_id, else by the station's uic. Rules are a small hand-kept table."""
    o = F.broadcast(overrides.select("key", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")))
    by = lambda p: [F.col("key").alias(f"{p}k"), F.col("_lon").alias(f"{p}x"), F.col("_lat").alias(f"{p}y")]
    j = stops.join(o.select(*by("a")), F.col("stop_id") == F.col("ak"), "left").join(o.select(*by("b")), F.col("uic") == F.col("bk"), "left")
    return j.withColumns({"lon": F.coalesce("ax", "bx", "lon"), "lat": F.coalesce("ay", "by", "lat")}).select(*stops.columns)


def foreign_trips(stop_times: DataFrame, stops: DataFrame, box: tuple = (5.93, 45.80, 10.52, 47.83)) -> DataFrame:
    """``→ trip_id``: trips with any stop that has no coordinates or lies outside the box."""
    s = stops.select("stop_id", F.coalesce(in_bbox(F.col("lon"), F.col("lat"), box), F.lit(False)).alias("inside"))
    j = stop_times.select("trip_id", "stop_id").join(s, "stop_id", "left")
    return j.groupBy("trip_id").agg(F.bool_and(F.coalesce("inside", F.lit(False))).alias("all")).where("not all").select("trip_id")


def filter_transfers(transfers: DataFrame, kept_routes: DataFrame, dropped_trips: DataFrame) -> DataFrame:
    """Transfers that name only kept routes and no dropped trip; nulls name nothing."""
    t = transfers
    for c in ("from_route", "to_route"):
        r = kept_routes.select(F.col("route_id").alias("_r"), F.lit(True).alias("_ok")).distinct()
        t = t.join(r, F.col(c) == F.col("_r"), "left").where(F.col(c).isNull() | F.col("_ok")).drop("_r", "_ok")
    for c in ("from_trip", "to_trip"):
        t = t.join(dropped_trips.select(F.col("trip_id").alias("_t")), F.col(c) == F.col("_t"), "left_anti")
    return t


def filter_trips(table: DataFrame, dropped: DataFrame) -> DataFrame:
    return table.join(dropped.select("trip_id"), "trip_id", "left_anti")


def cascade_refs(routes: DataFrame, agency: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes that kept trips use, and agencies that kept routes use."""
    r = routes.join(trips.select("route_id"), "route_id", "left_semi")
    return r, agency.join(r.select("agency_id"), "agency_id", "left_semi")


def transfer_stop_match(stop_times: DataFrame, rules: DataFrame, identity: DataFrame) -> DataFrame:
    """``stop_times, rules (rule, stop), identity (stop_id, uic) → (trip_id, seq, rule)``: by exact id, station, or legacy prefix; three equal joins, each row once."""
    s = stop_times.join(identity.select("stop_id", "uic"), "stop_id", "left")
    r = F.broadcast(rules)
    keys = (F.col("stop_id"), F.col("uic"), F.substring_index("stop_id", ":", 1))
    out = [s.join(r, k == F.col("stop")).select("trip_id", "seq", "rule") for k in keys]
    return out[0].union(out[1]).union(out[2]).distinct()


def renumber_sequence(stop_times: DataFrame) -> DataFrame:
    return stop_times.withColumn("seq", F.row_number().over(Window.partitionBy("trip_id").orderBy("seq")).cast("long"))


def insert_waypoint(stop_times: DataFrame, rules: DataFrame) -> DataFrame:
    """``stop_times, rules (rule, route_id, after, before, waypoint) → stop_times``: the first place where ``before`` follows ``after`` gets a synthetic row in between.

    The row's times are the departure before it; the sequence is numbered anew.
    ``stop_times`` carry their route_id.
    """
    w = Window.partitionBy("trip_id").orderBy("seq")
    pairs = stop_times.withColumn("_next", F.lead("stop_id").over(w))
    hits = pairs.join(rules.withColumnRenamed("route_id", "_route"), (F.col("route_id") == F.col("_route")) & (F.col("stop_id") == F.col("after")) & (F.col("_next") == F.col("before")))
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("trip_id", "rule").orderBy("seq"))).where("_k = 1")
    new = first.select("trip_id", "route_id", (F.col("seq") * 2 + 1).alias("seq"), F.col("waypoint").alias("stop_id"), F.col("dep").alias("arr"), "dep", F.lit(True).alias("synthetic"))
    old = stop_times.select("trip_id", "route_id", (F.col("seq") * 2).alias("seq"), "stop_id", "arr", "dep", F.lit(False).alias("synthetic"))
    return renumber_sequence(old.unionByName(new))


def split_trip(stop_times: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``stop_times (with route_id), rules (rule, route_id, stop) → (legs, warnings)``: trips cut at the first row at the rule's stop, which belongs to both legs.

    A trip where that row is missing, the first or the last stays whole and is
    reported with the reason.
    """
    s = stop_times.join(rules.select(F.col("route_id").alias("_r"), "rule", "stop"), F.col("route_id") == F.col("_r"))
    t = s.groupBy("trip_id", "rule").agg(F.min(F.when(F.col("stop_id") == F.col("stop"), F.col("seq"))).alias("cut"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    reason = F.when(F.col("cut").isNull(), "missing").when((F.col("cut") == F.col("lo")) | (F.col("cut") == F.col("hi")), "endpoint")
    t = t.withColumn("reason", reason)
    good = t.where("reason is null").groupBy(F.col("trip_id").alias("_t")).agg(F.min("cut").alias("cut"))
    j = stop_times.join(good, F.col("trip_id") == F.col("_t"), "left")
    part = F.when(F.col("cut").isNull(), F.array(F.lit(0))).when(F.col("seq") < F.col("cut"), F.array(F.lit(1))).when(F.col("seq") > F.col("cut"), F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    legs = j.withColumn("leg", F.explode(part))
    name = F.when(F.col("leg") == 0, F.col("trip_id").cast("string")).otherwise(F.concat(F.col("trip_id").cast("string"), F.lit("__"), F.col("leg").cast("string")))
    legs = legs.select(name.alias("trip_id"), "route_id", "seq", "stop_id", "arr", "dep")
    return renumber_sequence(legs), t.where("reason is not null").select("trip_id", "rule", "reason")


def _station(sid: Column) -> Column:
    bare = F.regexp_replace(sid, "^Parent", "")
    return F.when(F.startswith(bare, F.lit("ch:1:sloid:")), F.array_join(F.slice(F.split(bare, ":"), 1, 4), ":")).otherwise(F.substring_index(bare, ":", 1))


def parse_stop_identity(stops: DataFrame) -> DataFrame:
    """``(stop_id, didok, parent_station, platform_code) → (stop_id, uic, station, track, sector, quay, parent)``; empty text is unknown.

    A sector row (``…_gen:<quay>_pf:<sector>``) takes its track from the quay
    that it names, else the digits before its own sector, and the quay's uic
    where it has none.
    """
    e = lambda c: F.coalesce(F.trim(c), F.lit(""))
    s = stops.where(~F.startswith("stop_id", F.lit("WPT:"))).select("stop_id", e("didok").alias("uic"), F.regexp_replace(e("parent_station"), "^Parent", "").alias("parent"), e("platform_code").alias("pc"))
    head = F.substring_index(F.substring_index("stop_id", ":", 1), "_", 1)
    s = s.withColumn("uic", F.when((F.col("uic") == "") & head.rlike(r"^\d+$"), head).otherwise(F.col("uic")))
    gen = F.contains("stop_id", F.lit("_gen:"))
    rest = F.regexp_extract("stop_id", r"^.*?_gen:(.*)$", 1)
    mid, pf = F.substring_index(rest, "_pf:", 1), F.regexp_extract(rest, r"_pf:(.*)$", 1)
    s = s.withColumn("quay", F.when(gen & (mid != "missingSLOID"), mid).otherwise("")).withColumn("sector", F.when(gen, F.coalesce(F.nullif(F.col("pc"), F.lit("")), pf)).otherwise(""))
    s = s.withColumn("station", F.when(gen, _station(F.regexp_extract("stop_id", r"^(.*?)_gen:", 1))).when(F.col("parent") != "", F.col("parent")).otherwise(_station(F.col("stop_id")))).withColumn("track", F.when(gen, "").otherwise(F.col("pc")))
    q = s.select(F.col("stop_id").alias("_q"), F.col("track").alias("_track"), F.col("uic").alias("_uic"))
    # most rows name no quay: they meet nothing, and so aren't shuffled to one place for their empty key
    named = s.where("quay <> ''").join(q, F.col("quay") == F.col("_q"), "left").drop("_q")
    j = named.unionByName(s.where("quay = ''"), allowMissingColumns=True)
    sector = F.col("sector") != ""
    track = F.when(sector, F.coalesce(F.nullif(F.col("_track"), F.lit("")), track_from_code(F.col("sector")))).otherwise(F.col("track"))
    uic = F.when(sector & (F.col("uic") == ""), F.coalesce("_uic", F.lit(""))).otherwise(F.col("uic"))
    return j.select("stop_id", uic.alias("uic"), "station", track.alias("track"), "sector", "quay", "parent")


def merge_key(identity_uic: Column, parent: Column, stop_id: Column) -> Column:
    return F.coalesce(F.nullif(identity_uic, F.lit("")), F.nullif(parent, F.lit("")), stop_id)


def draw_id(quay: Column, stop_id: Column) -> Column:
    return F.coalesce(F.nullif(quay, F.lit("")), stop_id)


def match_platform_attributes(stops: DataFrame, attributes: DataFrame) -> DataFrame:
    """``stops (stop_id), attributes (sloid, length, compass) → (stop_id, status, length, compass)``."""
    a = attributes.select(F.col("sloid").alias("_s"), "length", "compass", F.lit(True).alias("_ok"))
    j = stops.select("stop_id").distinct().join(a, F.col("stop_id") == F.col("_s"), "left")
    return j.select("stop_id", F.when(F.col("_ok"), "atlas_match").otherwise("no_atlas_match").alias("status"), "length", "compass")


def drop_reasons(trips: DataFrame) -> DataFrame:
    """``(route_id, reason) → (route_id, by_agency, by_ev_route, foreign)``."""
    return trips.groupBy("route_id").agg(F.count_if(F.col("reason") == "agency").alias("by_agency"), F.count_if(F.col("reason") == "ev_route").alias("by_ev_route"), F.count_if(F.col("reason") == "foreign").alias("foreign"))


def track_code(track: Column) -> Column:
    """The public code of a stop's track, empty where it has none."""
    return F.coalesce(track, F.lit(""))


def resume_matrix(done: DataFrame, out: DataFrame, todo: DataFrame, key: str = "from_id") -> tuple[DataFrame, DataFrame]:
    """Rows of finished sources, which are kept, and the sources still to do; rows of unfinished ones go, as they may be partial."""
    finished = done.select(key).distinct()
    return out.join(finished, key, "left_semi"), todo.select(key).distinct().join(finished, key, "left_anti")


def upsert_shares(existing: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """What exists stays; of what comes in for other ids the first by ``order`` is added."""
    rest = [c for c in incoming.columns if c != key]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(key, *[F.col("_first")[c].alias(c) for c in rest])
    return existing.unionByName(first.join(existing.select(key), key, "left_anti"))


def snap_platforms(stops: DataFrame, identity: DataFrame, platforms: DataFrame, anchors: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """``stops (stop_id, parent, lon, lat), identity (stop_id, uic, track, sector), platforms (uic, ref, lon, lat), anchors (parent, lon, lat) → (stop_id, lon, lat, snapped)``.

    A stop moves to the nearest platform of its station and code within the
    radius of its parent, or of itself without one; its sector is tried before
    its track. Other stops stay.

    Stops with one anchor and code look together, and platforms at one place
    are one; both meet in stretches of latitude of the radius.
    """
    a = anchors.select("parent", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    s = stops.join(a, "parent", "left").select("stop_id", F.coalesce("_x", "lon").alias("_x"), F.coalesce("_y", "lat").alias("_y"))
    codes = identity.where("uic <> ''").select("stop_id", "uic", F.posexplode(F.filter(F.array("sector", "track"), lambda c: c.isNotNull() & (c != ""))).alias("rank", "ref"))
    stretch = lambda y: F.floor(y * (DEGREE_M / radius_m))
    p = platforms.select("uic", "ref", F.col("lon").alias("_px"), F.col("lat").alias("_py")).distinct()
    p = p.withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: stretch(F.col("_py")) + k)))
    ask = s.join(codes, "stop_id").where("_x is not null and _y is not null")
    j = ask.select("uic", "ref", "_x", "_y").distinct().withColumn("_b", stretch(F.col("_y"))).join(p, ["uic", "ref", "_b"])
    j = j.withColumn("_m", planar_m(F.col("_px"), F.col("_py"), F.col("_x"), F.col("_y"), F.col("_y"))).where(F.col("_m") < radius_m)
    near = j.groupBy("uic", "ref", "_x", "_y").agg(F.min(F.struct("_m", "_px", "_py")).alias("_n"))
    best = ask.join(near, ["uic", "ref", "_x", "_y"]).groupBy("stop_id").agg(F.min_by(F.struct("_n._px", "_n._py"), F.struct("rank", "_n._m", "_n._px", "_n._py")).alias("_p"))
    out = stops.join(best, "stop_id", "left")
    return out.select("stop_id", F.coalesce("_p._px", "lon").alias("lon"), F.coalesce("_p._py", "lat").alias("lat"), F.col("_p").isNotNull().alias("snapped"))


def line_geometry(variants: DataFrame, shapes: DataFrame, stops: DataFrame, straight: tuple[str, ...] = ("1300", "1303")) -> DataFrame:
    """``variants (variant, route_type, shape_id), shapes (shape_id, seq, lon, lat), stops (variant, seq, lon, lat) → (variant, vertices, source, reason)``.

    The shape of the variant's trip; without one, aerial lines run straight
    through their located stops, equal neighbours made one, and others are
    ``unrouted``. Under two points a line is ``too_short``.
    """
    line = lambda rows, by: rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("v")).select(by, F.transform("v", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("v"))
    shaped = line(shapes, "shape_id").withColumnRenamed("v", "shape")
    through = line(stops.where("lon is not null and lat is not null"), "variant").select("variant", line_points(F.col("v")).alias("through"))
    aerial = F.col("route_type").isin(*straight)
    j = variants.join(shaped, "shape_id", "left").join(through, "variant", "left")
    none = F.array().cast("array<struct<lon:double,lat:double>>")
    v = F.when(F.col("shape").isNotNull(), F.col("shape")).when(aerial, F.coalesce("through", none)).otherwise(none)
    source = F.when(F.col("shape").isNotNull(), "shape").when(aerial, "straight_line")
    j = j.select("variant", v.alias("vertices"), source.alias("source"))
    return j.withColumn("reason", F.when(F.col("source").isNull(), "unrouted").when(F.size("vertices") < 2, "too_short"))
