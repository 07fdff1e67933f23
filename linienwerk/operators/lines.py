"""Trip patterns, line groups and lines: grouping by shared stations, sequences, geometry, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.functions.geo import haversine_km
from linienwerk.functions.trip import content_id
from linienwerk.operators.graph import connected_components
from linienwerk.shared import Stash


#: Pairs of stations in a partition.
PAIR_ROWS = 1_000_000


def pattern_set(stop_times: DataFrame, by: str = "trip_id", station: str = "uic") -> DataFrame:
    """Sorted distinct stations of each trip."""
    return stop_times.groupBy(by).agg(F.sort_array(F.collect_set(station)).alias("stations"))


def sharing_components(members: DataFrame, part: str, least: int) -> DataFrame:
    """``(part, pattern_id long, station) → (id, component)``: patterns of a part that share ``least`` stations are one.

    With one station enough, members of a station are linked to its first, so
    a station that everything serves adds a link for each member and no pairs.
    With two, members of each pair of stations are linked to the pair's first:
    links follow the length of patterns, not their number. More than two need
    the pairs of patterns; they are counted within a part alone.
    """
    if least == 2:
        return pair_components(members.groupBy(part, "pattern_id").agg(F.sort_array(F.collect_set("station")).alias("stations")), part)
    m = members.select(part, "pattern_id", "station").distinct()
    nodes = m.select(F.col("pattern_id").alias("id"))
    if least == 1:
        edges = m.withColumn("dst", F.min("pattern_id").over(Window.partitionBy(part, "station"))).select(F.col("pattern_id").alias("src"), "dst")
    else:
        o = m.select(part, F.col("pattern_id").alias("dst"), "station")
        edges = m.withColumnRenamed("pattern_id", "src").join(o, [part, "station"]).where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("src", "dst")
    return connected_components(edges, nodes)


def pair_components(sets: DataFrame, part: str) -> DataFrame:
    """``(part, pattern_id long, stations sorted array) → (id, component)``: patterns of a part that share two stations are one."""
    own = Stash(sets.sparkSession, "sets", tidy=True).put(sets)
    return connected_components(pair_edges(own, part), own.select(F.col("pattern_id").alias("id")), tidy=True)


def pair_edges(own: DataFrame, part: str) -> DataFrame:
    """``(part, pattern_id long, stations sorted array) → (src, dst)``: patterns of a part that share two stations, each linked to the pair's first. Sets are read twice.

    Pairs of stations are sorted by a hash first, as one number is compared
    faster than two texts. Of a pair's only pattern nothing is left. Many pairs
    are dealt out in partitions of one size, so a task makes and sorts no more
    of them in a larger table. The hash is made behind that: it would be a
    third of what is sent, as it can't be compressed.
    """
    n = own.select(F.sum(F.size("stations").cast("long") * (F.size("stations") - 1) / 2)).first()[0] or 0
    n = int(n // PAIR_ROWS) + 1 if n > 4 * PAIR_ROWS else 0
    own = own.where(F.col(part).isNotNull() & (F.size("stations") > 1))
    two = (own.repartition(n, "pattern_id") if n else own).select(part, "pattern_id", "stations", F.posexplode("stations").alias("_i", "x"))
    two = two.select(part, "pattern_id", "x", F.explode(F.slice("stations", F.col("_i") + 2, F.size("stations"))).alias("y"))
    two = (two.repartition(n, part, "x", "y") if n else two).withColumn("_h", F.xxhash64(part, "x", "y"))
    w = Window.partitionBy("_h", part, "x", "y")
    return two.withColumn("dst", F.min("pattern_id").over(w)).where("pattern_id <> dst").select(F.col("pattern_id").alias("src"), "dst")


def trip_groups(trips: DataFrame, stop_times: DataFrame, part: str, least: int = 2) -> DataFrame:
    """``→ (trip_id, component, tg_id)``: trips of a part whose station sets share two stations, named by the hash of all their stations.

    Equal sets are one pattern, so pairs are between distinct ones. The sets are
    written once with the first trip of each, which all later steps read.
    """
    p = pattern_set(stop_times).join(trips.select("trip_id", part), "trip_id")
    same = Window.partitionBy(F.xxhash64(part, "stations"), part, "stations")
    p = Stash(p.sparkSession, "patterns").put(p.withColumn("pattern_id", F.when(F.col(part).isNull(), F.col("trip_id")).otherwise(F.min("trip_id").over(same))))
    first = p.where("trip_id = pattern_id").select(part, "pattern_id", "stations")
    comp = pair_components(first, part) if least == 2 else sharing_components(first.withColumn("station", F.explode("stations")), part, least)
    comp = comp.withColumnRenamed("id", "pattern_id")
    ids = first.select("pattern_id", "stations").join(comp, "pattern_id").groupBy("component").agg(content_id(F.array_distinct(F.flatten(F.collect_set("stations")))).alias("tg_id"))
    return p.select("trip_id", "pattern_id").join(comp, "pattern_id").join(ids, "component").select("trip_id", "component", "tg_id")


def canonical_trip(trips: DataFrame, by: str, score: Column) -> DataFrame:
    """The trip of each group with the highest score, the smallest id among equals."""
    w = Window.partitionBy(by).orderBy(score.desc(), "trip_id")
    return trips.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def representative_trip(trips: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, trip_id, stations, weight, days)``: the heaviest station set of a variant (the one with the smallest trip wins a tie), and in it the trip with most days."""
    sets = trips.groupBy(*by, "stations").agg(F.sum("weight").alias("_w"), F.min("trip_id").alias("_t"))
    best = sets.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_w"), "_t"))).where("_k = 1").select(*by, "stations")
    j = trips.join(best, [*by, "stations"])
    return j.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("days"), "trip_id"))).where("_k = 1").select(*by, "trip_id")


def first_last_flags(line_stops: DataFrame, by: str = "line_id") -> DataFrame:
    """``+ is_first, is_last, cum_km``"""
    w = Window.partitionBy(by).orderBy("seq")
    hop = F.coalesce(haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    s = line_stops.withColumn("is_first", F.row_number().over(w) == 1).withColumn("is_last", F.lead("seq").over(w).isNull()).withColumn("_hop", hop)
    return s.withColumn("cum_km", F.sum("_hop").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_hop")


def polyline_length(vertices: DataFrame, by: str) -> DataFrame:
    return first_last_flags(vertices, by).groupBy(by).agg(F.max("cum_km").alias("km"))


def longest_gap(line_stops: DataFrame, by: str = "line_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy("seq")
    hop = haversine_km(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return line_stops.withColumn("_hop", hop).groupBy(by).agg(F.max("_hop").alias("km"))


def line_spread(line_stops: DataFrame, by: str = "line_id") -> DataFrame:
    """Largest distance between two stations of a line; distinct places of one line alone are paired."""
    a = line_stops.select(by, "uic", "lon", "lat").dropDuplicates([by, "lon", "lat"])
    b = a.select(by, F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    return a.join(b, by).groupBy(by).agg(F.max(haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))).alias("km"))


def segment_speed(stop_rows: DataFrame, by: str, long_s: int = 600) -> DataFrame:
    """Mean km/h over segments of a trip, cut after an interior stop with a long dwell; the hop after it is in no segment."""
    w = Window.partitionBy(by).orderBy("seq")
    r = stop_rows.withColumn("_cut", ((F.col("dep") - F.col("arr")) > long_s) & F.lag("seq").over(w).isNotNull() & F.lead("seq").over(w).isNotNull())
    r = r.withColumn("_seg", F.coalesce(F.sum(F.col("_cut").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    v = Window.partitionBy(by, "_seg").orderBy("seq")
    r = r.withColumn("_hop", F.coalesce(haversine_km(F.lag("lon").over(v), F.lag("lat").over(v), F.col("lon"), F.col("lat")), F.lit(0.0)))
    s = r.groupBy(by, "_seg").agg(F.sum("_hop").alias("km"), (F.max_by("arr", "seq") - F.min_by("dep", "seq")).alias("sec")).where("sec > 0")
    return s.groupBy(by).agg(F.round(F.avg(F.col("km") / F.col("sec") * 3600), 1).alias("km_h"))


def departure_gaps(departures: DataFrame, by: str, at: str) -> DataFrame:
    return departures.select(by, at).distinct().withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at)))


def irregular_service(departures: DataFrame, by: str, at: str) -> DataFrame:
    """Directions with four departures or more: irregular if the largest gap is over three upper medians and 5400 s."""
    g = departure_gaps(departures, by, at).where("gap is not null")
    r = g.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("gap"))).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    s = r.where(F.col("_n") >= 3).groupBy(by).agg(F.max("gap").alias("most"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("gap"))).alias("mid"))
    return s.select(by, (F.col("most") > F.greatest(3 * F.col("mid"), F.lit(5400))).alias("irregular"))


def loop_apex(line_stops: DataFrame, by: str = "line_id") -> DataFrame:
    """Lines that end where they begin: the interior stop farthest from there."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = line_stops.withColumns({"_u0": F.first("uic").over(w), "_u1": F.last("uic").over(w), "_x": F.first("lon").over(w), "_y": F.first("lat").over(w)}).where("_u0 = _u1 and uic <> _u0")
    far = F.round(haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")), 6)
    return s.groupBy(by).agg(F.max_by(F.struct("seq", "stop_name"), F.struct(far, -F.col("seq"))).alias("a")).select(by, F.col("a.seq").alias("seq"), F.col("a.stop_name").alias("name"))


def salience_minmax(lines: DataFrame) -> DataFrame:
    """``(line_id, mode, competition) → + salience``: 1 for the least competition of the mode down to 0; 1 where all are alike."""
    w = Window.partitionBy("mode")
    span = F.max("competition").over(w) - F.min("competition").over(w)
    return lines.withColumn("salience", F.when(span == 0, 1.0).otherwise(1 - (F.col("competition") - F.min("competition").over(w)) / span))


def salience_top_share(lines: DataFrame, share: float) -> DataFrame:
    """The lines of the top share of each mode, half-even in number and one at least."""
    k = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("salience"), F.desc("score"), "line_id"))
    n = F.greatest(F.lit(1), F.bround(F.count("*").over(Window.partitionBy("mode")) * share, 0))
    return lines.withColumn("_k", k).withColumn("_n", n).where("_k <= _n").drop("_k", "_n")


def line_index(lines: DataFrame, ends: DataFrame, boxes: DataFrame, service: DataFrame) -> DataFrame:
    """``lines (line_id, ref, mode), ends (line_id, ord, name), boxes (line_id, w, s, e, n), service (line_id, …) → one row with all and the route``: termini in the order seen; two by an arrow, more by dots."""
    t = ends.groupBy("line_id", "name").agg(F.min("ord").alias("ord")).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("t"))
    names = F.transform("t", lambda x: x["name"])
    return lines.join(t, "line_id").join(boxes, "line_id").join(service, "line_id").withColumn("route", F.when(F.size(names) == 2, F.array_join(names, " ↔ ")).otherwise(F.array_join(names, " · "))).drop("t")


def stop_scores(line_stops: DataFrame, lines: DataFrame, weight: Column, terminal: float = 1.5) -> DataFrame:
    """``→ (uic, score)``: of each name the best contribution at the station (weight times 1 + score, more at a terminus), summed over names."""
    w = Window.partitionBy("line_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = line_stops.withColumn("_a", F.first("uic").over(w)).withColumn("_b", F.last("uic").over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("_n >= 2")
    s = s.select("line_id", "uic", ((F.col("uic") == F.col("_a")) | (F.col("uic") == F.col("_b"))).alias("term")).distinct()
    j = s.join(lines, "line_id").withColumn("c", weight * (1 + F.col("score")) * F.when(F.col("term"), terminal).otherwise(1.0))
    return j.groupBy("uic", "ref").agg(F.max("c").alias("c")).groupBy("uic").agg(F.sum("c").alias("score"))


def stop_line_index(line_stops: DataFrame, lines: DataFrame) -> DataFrame:
    """``→ (uic, ref, mode, terminates)``: whether any variant of the line ends at the station."""
    w = Window.partitionBy("line_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = line_stops.withColumn("_a", F.first("uic").over(w)).withColumn("_b", F.last("uic").over(w))
    j = s.join(lines.select("line_id", "ref", "mode"), "line_id")
    return j.groupBy("uic", "ref", "mode").agg(F.bool_or((F.col("uic") == F.col("_a")) | (F.col("uic") == F.col("_b"))).alias("terminates"))
