"""Stations: tiers, importance, search, lines at a station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.shared import Stash
from linienwerk.functions.line import INTERCITY, MODE_RANK, mode_score, tier_score
from linienwerk.functions.text import fold, match_tier, name_words


def stop_tier(scores: DataFrame, index: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``scores (uic, score), index (uic, ref, mode, terminates) → (uic, tier)``: the first of twelve rules that holds, unless a station has its tier by hand."""
    at = lambda m: F.bool_or(F.col("mode") == m)
    ic = F.lit(False)
    for p in INTERCITY:
        ic = ic | F.startswith(F.upper(F.coalesce("ref", F.lit(""))), F.lit(p))
    mountain = F.when(F.col("mode") == "mountain", F.when(F.col("terminates"), 0.9).otherwise(1.0)).when(F.col("mode") == "ferry", 1.0).when(F.col("mode").isin("tram", "bus", "regional_bus"), 0.5).otherwise(0.0)
    s = index.groupBy("uic").agg(at("train").alias("train"), at("metro").alias("metro"), at("mountain").alias("mountain"), at("ferry").alias("ferry"), F.bool_or((F.col("mode") == "train") & ic).alias("ic"), F.sum(mountain).alias("mlc"))
    j = s.join(scores, "uic", "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    sc = F.round("score", 6)
    tier = (
        F.when(yes("ic") & (sc >= 100), "major_train").when(yes("ic") & (sc >= 40), "main_train").when(yes("train") & (sc >= 20), "important_train").when(yes("train") & (sc >= 10), "train_station").when(yes("train"), "small_train")
        .when(yes("mountain"), F.when(F.round("mlc", 6) >= 2.0, "major_mountain").otherwise("mountain_stop")).when(yes("ferry"), "ferry_stop").when((sc >= 15) | yes("metro"), "major_hub").when(sc >= 6, "big_station").when(sc >= 1.5, "normal_stop").otherwise("small_bus")
    )
    if overrides is None:
        return j.select("uic", tier.alias("tier"))
    o = F.broadcast(overrides.select("uic", F.col("tier").alias("_tier")))
    return j.join(o, "uic", "left").select("uic", F.coalesce("_tier", tier).alias("tier"))


def mountain_line_count(index: DataFrame) -> DataFrame:
    m = F.when(F.col("mode") == "mountain", F.when(F.col("terminates"), 0.9).otherwise(1.0)).when(F.col("mode") == "ferry", 1.0).when(F.col("mode").isin("tram", "bus", "regional_bus"), 0.5).otherwise(0.0)
    return index.groupBy("uic").agg(F.round(F.sum(m), 6).alias("n"))


def score_percentiles(scores: DataFrame, ps: list[float]) -> DataFrame:
    """Values at place int(p n) of the non-zero scores in order, and the largest as 1.0.

    Places are found over all partitions: equal scores are one row with their
    number first, and only those are numbered.
    """
    c = scores.where("score > 0").groupBy("score").agg(F.count("*").alias("n"))
    stash = Stash(scores.sparkSession, "percentiles")
    # in order over all partitions: a place is a partition's offset and a sum within it
    c = stash.put(stash.put(c).repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = c.groupBy("part").agg(F.sum("n").alias("m"))
    parts = parts.select("part", (F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy()).alias("all"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("run", run).join(parts, "part").withColumn("to", F.col("base") + F.col("run")).withColumn("from", F.col("to") - F.col("n"))
    p = c.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in ps]))).withColumn("k", F.least(F.floor(F.col("p") * F.col("all")), F.col("all") - 1))
    return p.where((F.col("k") >= F.col("from")) & (F.col("k") < F.col("to"))).select("p", F.col("score").alias("value"))


def score_histogram(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def highest_mode(station_modes: DataFrame) -> DataFrame:
    """``(uic, mode) → (uic, mode)``: the last of train, metro, tram, bus, regional_bus that is there; else ferry, else mountain."""
    order = {m: i for i, m in enumerate(("mountain", "ferry", "train", "metro", "tram", "bus", "regional_bus"))}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("mode")]
    return station_modes.groupBy("uic").agg(F.max_by("mode", rank).alias("mode"))


def stop_importance(stations: DataFrame, dwell: DataFrame, bracket: DataFrame, nearby: DataFrame, lines: DataFrame) -> DataFrame:
    """``→ (uic, points)`` for dwell, urbanness, lines nearby (train stations) and interchange."""
    k = lines.groupBy("uic").agg(F.count_distinct("line_id").alias("k"), F.bool_or(F.col("mode") == "train").alias("train"))
    j = stations.select("uic").join(dwell, "uic", "left").join(bracket, "uic", "left").join(nearby, "uic", "left").join(k, "uic", "left")
    z = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    points = F.when(z("avg_s", 0.0) > 180, 3).when(z("avg_s", 0.0) > 0, 2).otherwise(0)
    points = points + F.when(F.col("bracket") == "city", 3).when(F.col("bracket") == "town", 2).when(F.col("bracket") == "village", 1).otherwise(0)
    points = points + F.when(~z("train", False), 0).when(z("n", 0) > 3, 3).when(z("n", 0) > 0, 2).otherwise(0)
    points = points + F.when(z("k", 0) >= 2, F.when(z("train", False), 3).otherwise(2)).otherwise(0)
    return j.select("uic", points.alias("points"))


def station_search_index(rows: DataFrame) -> DataFrame:
    """``(uic, name, mode, tier, ord) → a row per uic``: of the best mode, the first seen among equals."""
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(MODE_RANK) for x in (m, i)])[F.col("mode")]
    w = Window.partitionBy("uic").orderBy(F.coalesce(rank, F.lit(99)), "ord")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def search_stations(queries: DataFrame, stations: DataFrame, k: int = 8) -> DataFrame:
    """``queries (q_id, text), stations (uic, name, mode, tier) → (q_id, uic, score, rank)``.

    Every token of a query must stand somewhere in the name. So an index of the
    names' letter pairs (and letters, for tokens of one) is asked for the pair
    of the query that the fewest names have: texts and names meet by that pair
    alone. Equal texts are asked once and equal names scored once. Of stations
    alike in name, mode and tier only the first ``k`` can be among the best, so
    no more of them are listed. A query with a pair that no name has finds
    nothing. Null names and texts find nothing.
    """
    grams = lambda c, w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (w - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(w))))
    stash = Stash(stations.sparkSession, "search")
    s = stations.select("uic", "mode", "tier", fold(F.col("name")).alias("f")).where("f <> '' and uic is not null")
    first = F.row_number().over(Window.partitionBy("f", "mode", "tier").orderBy("uic"))
    s = stash.put(s.withColumn("_k", first).where(F.col("_k") <= k).drop("_k"))
    names = s.select("f").distinct()
    index = names.select("f", F.explode(F.array_union(grams(F.col("f"), 2), grams(F.col("f"), 1))).alias("g"))
    often = index.groupBy("g").agg(F.count("*").alias("names"))
    q = stash.put(queries.select("q_id", F.filter(F.split(fold(F.trim("text")), r"\s+"), lambda t: t != "").alias("tokens")).where("size(tokens) > 0"))
    texts = q.select("tokens").distinct()
    asked = texts.select("tokens", F.explode(F.array_distinct(F.flatten(F.transform("tokens", lambda t: grams(t, 2))))).alias("g")).join(often, "g", "left")
    rarest = asked.groupBy("tokens").agg(F.min_by("g", F.struct(F.coalesce("names", F.lit(0)), "g")).alias("g"))
    m = rarest.join(index, "g").withColumn("words", name_words(F.col("f")))
    m = m.select("tokens", "f", match_tier(F.col("f"), F.col("words"), F.col("tokens")).alias("m")).where("m > 0")
    j = m.join(s, "f").withColumn("score", F.round(5.0 * F.col("m") + mode_score(F.col("mode")) + tier_score(F.col("tier")), 6))
    w = Window.partitionBy("tokens").orderBy(F.desc("score"), "uic")
    best = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("tokens", "uic", "score", "rank")
    return q.join(best, "tokens").select("q_id", "uic", "score", "rank")


def station_lines(line_stops: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines (line_id, ref, mode, route, w, s, e, n) → (uic, lines)``: for each station its names, by mode and name, each with the keys of its lines, the box round them and the first one's route."""
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(MODE_RANK) for x in (m, i)])[F.col("mode")]
    j = line_stops.select("uic", "line_id").distinct().join(lines, "line_id")
    g = j.groupBy("uic", "ref", "mode").agg(F.array_sort(F.collect_list("line_id")).alias("keys"), F.min_by("route", "line_id").alias("route"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    l = g.groupBy("uic").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(rank, F.lit(99)).alias("rank"), "ref", "mode", "keys", "route", "w", "s", "e", "n"))).alias("lines"))
    return l.select("uic", F.transform("lines", lambda x: x.dropFields("rank")).alias("lines"))


def terminus_pairing(ends: DataFrame, radius_m: float = 10.0) -> DataFrame:
    """``ends (line_id, exempt, departure (stop_id, lon, lat), arrival (…)) → (line_id, skip_first)``.

    A line's first stop isn't drawn where another line arrives at the same stop
    within the radius; lines whose directions are drawn as one are exempt on
    both sides.
    """
    from linienwerk.functions.geo import haversine_km

    d = ends.where(~F.col("exempt") & F.col("departure.stop_id").isNotNull()).select("line_id", F.col("departure.stop_id").alias("stop_id"), F.col("departure.lon").alias("x"), F.col("departure.lat").alias("y"))
    a = ends.where(~F.col("exempt")).select(F.col("line_id").alias("other"), F.col("arrival.stop_id").alias("stop_id"), F.col("arrival.lon").alias("ax"), F.col("arrival.lat").alias("ay"))
    near = (F.col("other") != F.col("line_id")) & (haversine_km(F.col("x"), F.col("y"), F.col("ax"), F.col("ay")) * 1000 <= radius_m)
    hit = d.join(a, "stop_id").where(near).select("line_id").distinct().withColumn("hit", F.lit(True))
    return ends.select("line_id").join(hit, "line_id", "left").select("line_id", F.coalesce("hit", F.lit(False)).alias("skip_first"))


def dominant_line(members: DataFrame) -> DataFrame:
    """``(cluster, mode, colour, width, stop_id) → a row per cluster``: lowest mode rank, in it the darkest colour; the largest width of all."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for i, m in enumerate(MODE_RANK) for x in (m, i)])[F.col("mode")], F.lit(99))
    part = lambda k: F.conv(F.substring("colour", 2 * k, 2), 16, 10).cast("int")
    dark = F.round(part(1) * 0.299 + part(2) * 0.587 + part(3) * 0.114, 6)
    g = members.groupBy("cluster").agg(F.min_by(F.struct("mode", "colour", "stop_id"), F.struct(rank, dark, F.col("stop_id"))).alias("d"), F.max("width").alias("width"))
    return g.select("cluster", "d.mode", "d.colour", "d.stop_id", "width")


def display_names(stops: DataFrame, stations: DataFrame, keys: Column, most_km: float = 25.0) -> DataFrame:
    """``stops (stop_id, name, lon, lat), stations (key, lon, lat) → stops with a comma whose first part names a station nearby``."""
    from linienwerk.functions.geo import haversine_km

    s = stops.where(F.contains("name", F.lit(","))).withColumn("key", keys)
    t = stations.select("key", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    near = s.join(t, "key").where(haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")) <= most_km)
    return near.select("stop_id", F.trim(F.regexp_replace("name", "^[^,]*,", "")).alias("display_name")).distinct()
