"""Network operators: linear referencing, built-up corridors, zoom levels, rescues, service summaries, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from linienwerk.functions.geo import haversine_km
from linienwerk.functions.line import is_intercity, promotion_threshold
from linienwerk.functions.times import weekday_mask
from linienwerk.operators.lines import departure_gaps, first_last_flags


def _segments(vertices: DataFrame, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy("seq")
    v = first_last_flags(vertices, by).withColumn("m0", F.col("cum_km") * 1000)
    return v.select(by, "seq", F.col("lon").alias("x0"), F.col("lat").alias("y0"), "m0", F.lead("lon").over(w).alias("x1"), F.lead("lat").over(w).alias("y1"), F.lead("m0").over(w).alias("m1"))


def point_at(vertices: DataFrame, places: DataFrame, by: str) -> DataFrame:
    """``places (by, k, t_m) → (by, k, lon, lat)``: points at metres along lines, clamped to their ends."""
    s = _segments(vertices, by).where("m1 > m0")
    ends = s.groupBy(by).agg(F.max("m1").alias("_end"))
    p = places.join(ends, by).withColumn("_t", F.greatest(F.lit(0.0), F.least("t_m", "_end")))
    j = p.join(s, by).where((F.col("_t") >= F.col("m0")) & ((F.col("_t") < F.col("m1")) | ((F.col("_t") == F.col("_end")) & (F.col("m1") == F.col("_end")))))
    f = (F.col("_t") - F.col("m0")) / (F.col("m1") - F.col("m0"))
    return j.select(by, "k", (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("lon"), (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("lat"))


def bearing_at(vertices: DataFrame, places: DataFrame, by: str, window_m: float) -> DataFrame:
    """``→ (by, k, bearing)``: radians from east of the chord over a window about each place."""
    two = places.select(by, F.col("k").alias("_k"), F.explode(F.array(F.struct((F.col("t_m") - window_m).alias("t"), F.lit(0).alias("e")), F.struct((F.col("t_m") + window_m).alias("t"), F.lit(1).alias("e")))).alias("p"))
    pts = point_at(vertices, two.select(by, F.struct("_k", "p.e").alias("k"), F.col("p.t").alias("t_m")), by)
    g = pts.groupBy(by, F.col("k._k").alias("k")).agg(F.max_by(F.struct("lon", "lat"), "k.e").alias("b"), F.min_by(F.struct("lon", "lat"), "k.e").alias("a"))
    return g.select(by, "k", F.atan2(F.col("b.lat") - F.col("a.lat"), (F.col("b.lon") - F.col("a.lon")) * F.cos(F.radians(F.col("a.lat")))).alias("bearing"))


def line_midpoint(vertices: DataFrame, by: str) -> DataFrame:
    half = first_last_flags(vertices, by).groupBy(by).agg((F.max("cum_km") * 500).alias("t_m")).withColumn("k", F.lit(0))
    return point_at(vertices, half, by).drop("k")


def slice_line(vertices: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """``spans (by, a_m, b_m) → (by, ord, lon, lat)``: the part of a line between two places, its ends cut exactly."""
    ends = spans.select(by, F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("a_m").alias("t")), F.struct(F.lit(1).alias("k"), F.col("b_m").alias("t")))).alias("e")).select(by, F.col("e.k").alias("k"), F.col("e.t").alias("t_m"))
    cut = point_at(vertices, ends, by).join(spans, by).select(by, F.when(F.col("k") == 0, F.col("a_m")).otherwise(F.col("b_m")).alias("m"), "lon", "lat")
    v = first_last_flags(vertices, by).withColumn("m", F.col("cum_km") * 1000).join(spans, by).where("m > a_m and m < b_m").select(by, "m", "lon", "lat")
    return cut.unionByName(v).withColumn("ord", F.row_number().over(Window.partitionBy(by).orderBy("m"))).select(by, "ord", "lon", "lat")


def hull_spread(cells: DataFrame, by: str, size_m: float) -> DataFrame:
    """``(by, cx, cy) → (by, km)``: largest distance of two cells; only the outermost cells of each row can be its ends."""
    row = cells.groupBy(by, "cy").agg(F.min("cx").alias("a"), F.max("cx").alias("b"))
    p = row.select(by, F.explode(F.array_distinct(F.array("a", "b"))).alias("x"), F.col("cy").alias("y"))
    j = p.join(p.select(by, F.col("x").alias("u"), F.col("y").alias("v")), by)
    return j.groupBy(by).agg((F.max(F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))) * size_m / 1000).alias("km"))


def corridor_builtup(samples: DataFrame, built: DataFrame, by: str, radius_cells: int) -> DataFrame:
    """``samples (by, cx, cy, hx, hy), built (cx, cy) → (by, share)``: of the half discs left and right of the heading the one more built-up counts; the mean over cells."""
    n = range(-radius_cells, radius_cells + 1)
    disc = [(x, y) for x in n for y in n if x * x + y * y <= radius_cells * radius_cells]
    around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in disc]))
    s = samples.dropDuplicates([by, "cx", "cy"]).withColumn("o", around).withColumns({"bx": F.col("cx") + F.col("o.x"), "by_": F.col("cy") + F.col("o.y")})
    b = built.select(F.col("cx").alias("bx"), F.col("cy").alias("by_"), F.lit(1).alias("hit")).distinct()
    left = F.col("hx") * F.col("o.y") - F.col("hy") * F.col("o.x") >= 0
    j = s.join(b, ["bx", "by_"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    part = lambda side: F.coalesce(F.sum(F.when(side, F.col("hit"))) / F.count(F.when(side, 1)), F.lit(0.0))
    per = j.groupBy(by, "cx", "cy").agg(F.greatest(part(left), part(~left)).alias("s"))
    return per.groupBy(by).agg(F.avg("s").alias("share"))


def promote_city_bus(groups: DataFrame) -> DataFrame:
    """``(tg, mode, share, spread_km, rescued) → (tg, promoted)``: regional buses through built-up land become city buses unless they hold a rescued variant."""
    return groups.select("tg", ((F.col("mode") == "regional_bus") & ~F.col("rescued") & (F.col("share") >= promotion_threshold(F.col("spread_km")))).alias("promoted"))


def line_min_zoom(lines: DataFrame) -> DataFrame:
    """``(line_id, ref, mode, km, spread, gap, top30, top50) → (line_id, level)``: the first rule of the mode that holds."""
    m, km, spread, gap = F.col("mode"), F.col("km"), F.col("spread"), F.col("gap")
    step = lambda c, *rules: [(c >= x, z) for x, z in rules]
    rules = {
        "train": [(is_intercity(F.col("ref"), m), 4), ((km >= 30) & F.col("top50"), 5)],
        "metro": step(spread, (20, 8)),
        "ferry": step(gap, (20, 6), (10, 7), (5, 8)),
        "mountain": step(km, (15, 6), (8, 7), (5, 8), (2, 9), (0.5, 10)),
        "regional_bus": [((spread >= 25) & F.col("top30"), 7), ((spread >= 15) & F.col("top50"), 8), (spread >= 5, 9)],
        "tram": step(spread, (8, 9)),
        "bus": step(spread, (5, 10)),
    }
    last = {"train": 6, "metro": 9, "ferry": 9, "mountain": 11, "regional_bus": 10, "tram": 10, "bus": 11}
    out = F.lit(None)
    for mode, own in rules.items():
        level = F.lit(last[mode])
        for cond, z in reversed(own):
            level = F.when(F.coalesce(cond, F.lit(False)), z).otherwise(level)
        out = F.when(m == mode, level).otherwise(out)
    return lines.select("line_id", F.coalesce(out, F.lit(13)).cast("int").alias("level"))


def unique_stop_rescue(variants: DataFrame, stations: DataFrame, coords: DataFrame, far_m: float = 1000.0, least_share: float = 0.02) -> DataFrame:
    """``variants (tg, variant, kept, rescued, share), stations (tg, variant, uic), coords (uic, lon, lat) → (tg, variant)``: dropped variants of rescued groups that come back.

    They serve a station that no kept variant serves anywhere, that is far from
    every kept station of their own group, and have the least share.
    """
    v = variants.join(stations, ["tg", "variant"])
    kept = v.where("kept").select("tg", "uic").distinct()
    new = v.where("not kept and rescued").where(F.col("share") >= least_share).join(kept.select("uic").distinct(), "uic", "left_anti").join(coords, "uic")
    near = kept.join(coords.select("uic", F.col("lon").alias("_x"), F.col("lat").alias("_y")), "uic").select("tg", "_x", "_y")
    close = new.join(near, "tg").where(haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")) * 1000 < far_m).select("tg", "variant", "uic")
    return new.join(close, ["tg", "variant", "uic"], "left_anti").select("tg", "variant").distinct()


def service_summary(departures: DataFrame, dates: DataFrame, feed_days: int | None) -> DataFrame:
    """``departures (line_id, a, b, dep, runs, days), dates (line_id, a, b, first, last, wd0…wd6) → a row per line``.

    For each pair of ends, whichever way: ``route``, as its busier direction
    goes; ``days``, the weekdays served; ``rpd``, runs a day of that direction;
    ``irregular``, whether its departures have an odd gap; ``dep0``, ``dep1``,
    first and last departure, averaged over the directions; ``from``, ``to``,
    its dates, if they span less than three quarters of the feed's.
    ``variants`` has them, busiest first. The line itself has the busiest one's
    figures, the days of all, and dates by the same rule. Without a length of
    the feed no dates are told.
    """
    by = ["line_id", "a", "b"]
    g = departures.groupBy(*by).agg(F.sum("runs").alias("runs"), F.max("days").alias("days"), F.min("dep").alias("first"), F.max("dep").alias("last"))
    gaps = departure_gaps(departures.withColumn("d", F.struct(*by)), "d", "dep").where("gap is not null")
    r = gaps.withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("gap"))).withColumn("n", F.count("*").over(Window.partitionBy("d")))
    odd = r.where("n >= 3").groupBy("d").agg((F.max("gap") > F.greatest(3 * F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("gap"))), F.lit(5400))).alias("odd")).select("d.*", "odd")
    pair = lambda: (F.least("a", "b").alias("end_a"), F.greatest("a", "b").alias("end_b"))
    j = g.join(odd, by, "left").withColumn("rpd", F.when(F.col("days") > 0, F.col("runs") / F.col("days")).otherwise(0.0))
    busier = F.struct(F.round("rpd", 9), F.col("a"))
    route = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat_ws(" ↔ ", "a", "b"))
    s = j.groupBy("line_id", *pair()).agg(F.max_by(route, busier).alias("route"), F.round(F.max("rpd"), 1).alias("rpd"), F.coalesce(F.max_by("odd", busier), F.lit(False)).alias("irregular"), F.round(F.avg("first")).cast("long").alias("dep0"), F.round(F.avg("last")).cast("long").alias("dep1"))
    d = dates.groupBy("line_id", *pair()).agg(F.array(*[F.max(f"wd{k}") for k in range(7)]).alias("wd"), F.min("first").alias("first"), F.max("last").alias("last"))
    own = s.join(d, ["line_id", "end_a", "end_b"]).withColumn("days", weekday_mask(F.col("wd")))
    seasonal = F.coalesce(F.datediff("last", "first") + 1 < F.lit(0.75 * feed_days if feed_days else None), F.lit(False))
    own = own.withColumn("from", F.when(seasonal, F.col("first"))).withColumn("to", F.when(seasonal, F.col("last")))
    row = F.struct((-F.col("rpd")).alias("order"), "end_a", "end_b", "route", "days", "rpd", "irregular", "dep0", "dep1", "from", "to")
    any_day = F.concat(*[F.max(F.substr("days", F.lit(k), F.lit(1))) for k in range(1, 8)])
    out = own.groupBy("line_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), any_day.alias("days"), F.min("first").alias("first"), F.max("last").alias("last"))
    top = F.get("rows", F.lit(0))
    told = ("route", "days", "rpd", "irregular", "dep0", "dep1", "from", "to")
    variants = F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in told]))
    return out.select("line_id", "days", *[top[c].alias(c) for c in ("rpd", "irregular", "dep0", "dep1")], F.when(seasonal, F.col("first")).alias("from"), F.when(seasonal, F.col("last")).alias("to"), variants.alias("variants"))


def group_audit(groups: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``groups (tg), stages [(reason, dropped (tg))] → (tg, reason)``: every group with the first stage that dropped it, else ``kept``."""
    out = groups.select("tg")
    for k, (_, dropped) in enumerate(stages):
        out = out.join(dropped.select("tg").distinct().withColumn(f"_{k}", F.lit(True)), "tg", "left")
    return out.select("tg", F.coalesce(*[F.when(F.col(f"_{k}"), F.lit(reason)) for k, (reason, _) in enumerate(stages)], F.lit("kept")).alias("reason"))


def match_ways(points: DataFrame, segments: DataFrame, radius_m: float, tolerance: float, lat0: float = 46.8) -> DataFrame:
    """``points (point_id, lon, lat, bearing), segments (way_id, x0, y0, x1, y1) → (point_id, way_id)``: the nearest way whose direction fits, modulo a half turn.

    Segments are cut into parts of at most twice the radius, and met by the cell
    of a part's middle: a part within reach has its middle within two radii.
    """
    import math

    from linienwerk.operators.spatial import grid_join

    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow((F.col("x1") - F.col("x0")) * math.cos(math.radians(lat0)), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) * 111320.0 / (2 * radius_m)))
    at = lambda a, b, f: F.col(a) + (F.col(b) - F.col(a)) * f / F.col("_n")
    parts = segments.withColumn("_n", n.cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    parts = parts.select("way_id", *[F.when(F.col("_n") == 1, F.col(whole)).otherwise(at(a, b, F.col("_i") + k)).alias(whole) for whole, a, b, k in (("x0", "x0", "x1", 0), ("y0", "y0", "y1", 0), ("x1", "x0", "x1", 1), ("y1", "y0", "y1", 1))])
    mid = parts.select("way_id", "x0", "y0", "x1", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat"))
    j = grid_join(points, mid, 2 * radius_m, lat0)
    k = math.cos(math.radians(lat0))
    dx, dy = (F.col("x1") - F.col("x0")) * k, F.col("y1") - F.col("y0")
    px, py = (F.col("lon") - F.col("x0")) * k, F.col("lat") - F.col("y0")
    len2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / len2))
    turn = F.pmod(F.atan2(dy, dx) - F.col("bearing"), F.lit(math.pi))
    j = j.where(len2 > 0).withColumn("_d", F.sqrt(F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2)) * 111320.0).withColumn("_a", F.least(turn, math.pi - turn))
    j = j.where((F.col("_d") <= radius_m) & (F.col("_a") <= tolerance))
    w = Window.partitionBy("point_id").orderBy(F.round("_d", 6), F.round("_a", 6), "way_id")
    return j.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("point_id", "way_id", F.round("_d", 3).alias("dist_m"))




def arrival_skip(line_ends: DataFrame, line_stops: DataFrame, modes: tuple[str, ...] = ("tram", "bus")) -> DataFrame:
    """``line_ends (line_id, ref, mode, stop_id, uic, code?, paired), line_stops (ref, mode, uic, code?) → (line_id)``: lines whose last stop isn't drawn.

    Arrivals of trams and buses that no departure pairs with, and stops without
    a code where a line of the same name calls at the station with one.
    """
    alone = line_ends.where(F.col("mode").isin(*modes) & ~F.col("paired")).select("line_id")
    coded = line_stops.where("code is not null").select("ref", "mode", "uic").distinct()
    shadowed = line_ends.where("code is null").join(coded, ["ref", "mode", "uic"], "left_semi").select("line_id")
    return alone.union(shadowed).distinct()


#: Variants in a partition.
VARIANT_ROWS = 200_000


def resplit_groups(variants: DataFrame, frequency: DataFrame, groups: DataFrame, worst: Column, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """``variants (tg, variant_id long, station, rescued), frequency (variant_id, season, f_core, f_eve, f_we), groups (tg, mode, rescued, exempt)``
    ``→ (tg, variant_id, group), (tg, group, split, passed, season, f)``.

    After filters, the variants of a group that still share ``least`` stations
    hang together. A group that is one component keeps its key. Of any other
    the key is retired: each component is a group of its own, named by the hash
    of its stations, whose frequency is summed anew and has to pass the gate
    again; a component counts as rescued if the group and one of its variants
    are, and exempt ones always pass. Variants of components that don't pass
    have a null group. Two components of one group with the same stations are
    an error; that the eight digits of two names agree is none.

    A written table of variants may have ``stations``, an array, in place of a
    row for each; it isn't written again. Variants meet their frequency and
    their component once; those that share with none are components as they
    are, and only the others are grouped.
    """
    from linienwerk.operators.graph import connected_components
    from linienwerk.operators.lines import pair_edges, sharing_components
    from linienwerk.operators.service import SEASONS, gated
    from linienwerk.shared import Stash

    stash = Stash(variants.sparkSession, "resplit", tidy=True)
    rescued = F.coalesce("rescued", F.lit(False))
    if "stations" in variants.columns:
        own = variants.select("tg", "variant_id", F.array_sort(F.array_distinct(F.array_compact("stations"))).alias("stations"), rescued.alias("rescued"))
    else:
        own = stash.put(variants.groupBy("tg", "variant_id").agg(F.array_sort(F.collect_set("station")).alias("stations"), F.max(rescued).alias("rescued")))
    sets = own.select("tg", F.col("variant_id").alias("pattern_id"), "stations")
    if least == 2:
        comp = connected_components(pair_edges(sets, "tg"), tidy=True)
    else:
        comp = sharing_components(sets.select("tg", "pattern_id", F.explode("stations").alias("station")), "tg", least)

    n = own.count() // VARIANT_ROWS
    n = n + 1 if n > 4 else 0
    dealt = lambda df, *by: df.repartition(n, *by) if n else df
    kinds = {s: [f"{s}_{c}" for c in ("f_core", "f_eve", "f_we")] for s in SEASONS}
    sums = [c for s in SEASONS for c in kinds[s]]
    of_one = dealt(frequency, "variant_id").groupBy("variant_id").agg(*[F.sum(F.when(F.col("season") == s, F.col(c.removeprefix(f"{s}_")))).alias(c) for s in SEASONS for c in kinds[s]])
    v = dealt(own, "variant_id").join(of_one.hint("merge"), "variant_id", "left")
    v = stash.put(v.join(comp.select(F.col("id").alias("variant_id"), "component").hint("merge"), "variant_id", "left"))

    alone = v.where("component is null").select("tg", F.col("variant_id").alias("component"), F.array_join("stations", ",").alias("all"), F.col("rescued").alias("any_rescued"), *sums)
    many = v.where("component is not null").select("tg", "component", "rescued", *sums, F.posexplode_outer("stations").alias("_i", "station"))
    once = F.coalesce("_i", F.lit(0)) == 0
    many = many.groupBy("tg", "component").agg(F.array_join(F.array_sort(F.collect_set("station")), ",").alias("all"), F.max("rescued").alias("any_rescued"), *[F.sum(F.when(once, F.col(c))).alias(c) for c in sums])
    parts = alone.unionByName(many).withColumn("all", F.sha2("all", 256))

    # of names, only those whose 64 bits agree are compared in full
    like = dealt(parts.select("tg", F.xxhash64("all").alias("_h")), "tg", "_h").groupBy("tg", "_h").agg(F.count("*").alias("n"))
    of = like.groupBy("tg").agg((F.sum("n") > 1).alias("split"), (F.max("n") > 1).alias("clash"))
    of = stash.put(of.join(groups.select("tg", "mode", "exempt", F.coalesce("rescued", F.lit(False)).alias("rescued")), "tg"))
    if of.where("clash").limit(1).count():
        same = parts.join(of.where("clash").select("tg"), "tg", "left_semi").groupBy("tg", "all").agg(F.count("*").alias("n")).where("n > 1").select("tg", F.lit(True).alias("same")).distinct()
        of = of.join(same, "tg", "left").withColumn("clash", F.coalesce("same", F.lit(False))).drop("same")

    j = parts.join(of, "tg").withColumn("rescued", F.col("rescued") & F.col("any_rescued"))
    named = F.when(F.col("clash"), F.raise_error(F.lit("two components of a group have the same stations")).cast("string")).when(F.col("split"), F.substr("all", F.lit(1), F.lit(8))).otherwise(F.col("tg").cast("string"))
    j = gated(j.withColumns({s: 0.6 * F.col(core) + 0.2 * F.col(eve) + 0.2 * F.col(we) for s, (core, eve, we) in kinds.items()}), worst)
    free = F.coalesce("exempt", F.lit(False))
    passed = ~F.col("split") | free | F.col("season").isNotNull()
    season = F.when(F.col("split"), F.when(free, "annual").otherwise(F.col("season")))
    out = j.select("tg", "component", named.alias("named"), "split", passed.alias("passed"), season.alias("season"), F.when(F.col("split"), F.col("f")).alias("f"))
    of_variant = v.select("tg", "variant_id", F.coalesce("component", "variant_id").alias("component")).join(out.select("component", F.when(F.col("passed"), F.col("named")).alias("group")), "component")
    return of_variant.select("tg", "variant_id", "group"), out.select("tg", F.col("named").alias("group"), "split", "passed", "season", "f")


def hybrid_stop(narrow: DataFrame, tram: DataFrame, points: DataFrame, most_m: float = 2.0) -> DataFrame:
    """``(point_id, dist_m)`` of the nearest ways of two kinds → ``(point_id, hybrid)``: narrow gauge within ``most_m`` and nearer than any tram way."""
    n = narrow.groupBy("point_id").agg(F.min("dist_m").alias("_n"))
    t = tram.groupBy("point_id").agg(F.min("dist_m").alias("_t"))
    j = points.select("point_id").join(n, "point_id", "left").join(t, "point_id", "left")
    return j.select("point_id", F.coalesce((F.col("_n") <= most_m) & (F.col("_t").isNull() | (F.col("_n") < F.col("_t"))), F.lit(False)).alias("hybrid"))
