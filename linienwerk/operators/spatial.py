"""Joins by distance over a grid of cells.

Both sides get the cell of their place; the smaller side is repeated over the
cells around it, and rows of equal cells are compared. The cell is the join key; the
partition of a very dense cell is split by adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.functions.geo import DEGREE_M, haversine_km, planar_m
from linienwerk.shared import Stash


def cells(lon: Column, lat: Column, size_m: float, lat0: float) -> tuple[Column, Column]:
    """Integer cell of a place, of a side that is ``size_m`` at ``lat0``."""
    return F.floor(lon * (DEGREE_M * math.cos(math.radians(lat0)) / size_m)), F.floor(lat * (DEGREE_M / size_m))


def grid_join(left: DataFrame, right: DataFrame, radius_m: float, lat0: float = 46.8, strict: bool = False, parts: int | None = None) -> DataFrame:
    """All pairs within ``radius_m`` (planar at ``lat0``): the left columns, the right ones, and ``dist_m``.

    Both have ``lon`` and ``lat``; the right side's columns must have other
    names except for these, which are dropped from it. Pairs at the radius
    count, unless ``strict``. Rows without a place match nothing. ``parts`` is
    the number of partitions, for joins that give far more than they read.
    """
    cx, cy = cells(F.col("lon"), F.col("lat"), radius_m, lat0)
    a = left.withColumn("_cx", cx).withColumn("_cy", cy)
    around = F.explode(F.flatten(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda x: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda y: F.struct((F.col("_cx0") + x).alias("x"), (F.col("_cy0") + y).alias("y"))))))
    b = right.withColumn("_cx0", cx).withColumn("_cy0", cy).withColumn("_c", around).withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y"), "_lon": F.col("lon"), "_lat": F.col("lat")}).drop("_c", "_cx0", "_cy0", "lon", "lat")
    if parts:
        a, b = a.repartition(parts, "_cx", "_cy"), b.repartition(parts, "_cx", "_cy")
    j = a.join(b, ["_cx", "_cy"]).withColumn("dist_m", planar_m(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"), lat0))
    return j.where(F.col("dist_m") < radius_m if strict else F.col("dist_m") <= radius_m).drop("_cx", "_cy", "_lon", "_lat")


def within(left: DataFrame, right: DataFrame, radius_m: float, lat0: float = 46.8) -> DataFrame:
    """Left rows with any right row within the radius."""
    left = left.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in left.columns else left
    return grid_join(left, right.select("lon", "lat"), radius_m, lat0).dropDuplicates(["_row"]).drop("_row", "dist_m")


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, radius_m: float, k: int = 1, lat0: float = 46.8) -> DataFrame:
    """``(point_id, target_id, dist_m, rank)``: the nearest targets of each point, ties by target id.

    The search begins with a radius in which targets spread evenly would be four
    times as many as asked for, and doubles it for the points that haven't found
    enough: all that is nearer is known then. So a point meets a few times ``k``
    targets however dense they are; only the rest goes up to ``radius_m``.
    """
    stash = Stash(points.sparkSession, "nearest")
    t = targets.select(target_id, "lon", "lat").where("lon is not null and lat is not null")
    n, x0, x1, y0, y1 = t.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    side = [max((b - a) * DEGREE_M * f, radius_m / 64) for a, b, f in ((x0, x1, math.cos(math.radians(lat0))), (y0, y1, 1.0))] if n else [0.0, 0.0]
    even = math.sqrt(4 * k * side[0] * side[1] / (math.pi * n)) if n else radius_m
    r = radius_m / 2 ** max(0, math.floor(math.log2(radius_m / max(even, radius_m / 1024))))
    w = Window.partitionBy(point_id).orderBy("dist_m", target_id)
    rest, found = points.select(point_id, "lon", "lat"), None
    while True:
        j = grid_join(rest, t, r, lat0, parts=1 + rest.count() * k // 100_000)
        last = r >= radius_m
        if last:
            near = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(point_id, target_id, "dist_m", "rank")
            return near if found is None else found.unionByName(near)
        first = stash.put(j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(point_id, target_id, "dist_m", "rank"))
        full = first.where(F.col("rank") == k).select(point_id)
        done = first.join(full, point_id, "left_semi")
        found = done if found is None else found.unionByName(done)
        rest = stash.put(rest.join(full, point_id, "left_anti"))
        if not rest.limit(1).count():
            return found
        r = min(radius_m, 2 * r)


def count_within_radii(points: DataFrame, targets: DataFrame, point_id: str, inner_m: float, outer_m: float) -> DataFrame:
    """``(point_id, c_in, c_out)``: targets within two radii; points without any have zeros."""
    j = grid_join(points.select(point_id, "lon", "lat"), targets.select("lon", "lat"), outer_m)
    c = j.groupBy(point_id).agg(F.count_if(F.col("dist_m") <= inner_m).alias("c_in"), F.count("*").alias("c_out"))
    z = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return points.select(point_id).join(c, point_id, "left").select(point_id, z("c_in"), z("c_out"))


def cluster_edges(points: DataFrame, point_id: str, radius_m: float) -> DataFrame:
    other = points.select(F.col(point_id).alias("b"), "lon", "lat")
    return grid_join(points.select(F.col(point_id).alias("a"), "lon", "lat"), other, radius_m).where("a < b").select("a", "b")


def line_competition(samples: DataFrame, radius: Column, most_m: float, comparators: dict[str, list[str]]) -> DataFrame:
    """``samples (line_id, i, mode, lon, lat) → (line_id, competition)``: for each sample the nearest sample of every other line of comparable mode adds 1 − d / r; the mean over samples."""
    other = samples.select(F.col("line_id").alias("o_line"), F.col("mode").alias("o_mode"), "lon", "lat")
    j = grid_join(samples, other, most_m)
    fit = F.lit(False)
    for mode, modes in comparators.items():
        fit = fit | ((F.col("mode") == mode) & F.col("o_mode").isin(modes))
    near = j.withColumn("_r", radius).where((F.col("line_id") != F.col("o_line")) & fit & (F.col("dist_m") <= F.col("_r")))
    best = near.groupBy("line_id", "i", "o_line").agg(F.min("dist_m").alias("d"), F.first("_r").alias("r"))
    per = best.groupBy("line_id", "i").agg(F.sum(1 - F.col("d") / F.col("r")).alias("c"))
    return samples.select("line_id", "i").join(per, ["line_id", "i"], "left").groupBy("line_id").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("competition"))


def sample_polyline(vertices: DataFrame, by: str, step_m: float) -> DataFrame:
    """``vertices (by, seq, lon, lat) → (by, i, lon, lat)``: samples at (i + ½) / n of the length, n = length / step, one at least."""
    from linienwerk.operators.lines import first_last_flags

    w = Window.partitionBy(by).orderBy("seq")
    v = first_last_flags(vertices, by).withColumn("m", F.col("cum_km") * 1000)
    s = v.withColumns({"_m1": F.lead("m").over(w), "_x1": F.lead("lon").over(w), "_y1": F.lead("lat").over(w)}).where("_m1 > m")
    n = F.greatest(F.lit(1), F.floor(F.max("_m1").over(Window.partitionBy(by)) / step_m))
    # a segment lists its own samples: those whose place is from its start up to its end
    s = s.withColumn("_n", n).withColumn("_l", F.max("_m1").over(Window.partitionBy(by)))
    lo = F.greatest(F.lit(0), F.ceil(F.col("m") / F.col("_l") * F.col("_n") - 0.5).cast("long"))
    hi = F.least(F.col("_n").cast("long") - 1, F.ceil(F.col("_m1") / F.col("_l") * F.col("_n") - 0.5).cast("long") - 1)
    s = s.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    t = ((F.col("i") + 0.5) / F.col("_n") * F.col("_l") - F.col("m")) / (F.col("_m1") - F.col("m"))
    return s.select(by, "i", (F.col("lon") + t * (F.col("_x1") - F.col("lon"))).alias("lon"), (F.col("lat") + t * (F.col("_y1") - F.col("lat"))).alias("lat"))


def project_on_line(points: DataFrame, vertices: DataFrame, point_id: str, by: str, lat0: float = 46.8) -> DataFrame:
    """``points (point_id, by, lon, lat), vertices → (point_id, by, t_m, dist_m)``: the nearest place on the point's own line, metres along it."""
    from linienwerk.operators.lines import first_last_flags

    w = Window.partitionBy(by).orderBy("seq")
    v = first_last_flags(vertices, by).select(by, "seq", F.col("lon").alias("x0"), F.col("lat").alias("y0"), F.lead("lon").over(w).alias("x1"), F.lead("lat").over(w).alias("y1"), (F.col("cum_km") * 1000).alias("m0"), (F.lead("cum_km").over(w) * 1000).alias("m1")).where("x1 is not null")
    k = F.cos(F.radians(F.lit(lat0)))
    j = points.join(v, by)
    dx, dy = (F.col("x1") - F.col("x0")) * k, F.col("y1") - F.col("y0")
    px, py = (F.col("lon") - F.col("x0")) * k, F.col("lat") - F.col("y0")
    t = F.when(dx * dx + dy * dy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / (dx * dx + dy * dy)))).otherwise(0.0)
    j = j.withColumn("_t", t).withColumn("_d", planar_m(F.col("lon"), F.col("lat"), F.col("x0") + F.col("_t") * (F.col("x1") - F.col("x0")), F.col("y0") + F.col("_t") * (F.col("y1") - F.col("y0")), lat0))
    best = j.groupBy(point_id, by).agg(F.min_by(F.struct((F.col("m0") + F.col("_t") * (F.col("m1") - F.col("m0"))).alias("t"), F.col("_d").alias("d")), F.struct(F.round("_d", 6), "seq")).alias("b"))
    return best.select(point_id, by, F.col("b.t").alias("t_m"), F.col("b.d").alias("dist_m"))


def rasterise_polygons(rings: DataFrame, cell: float) -> DataFrame:
    """``rings (id, seq, x, y) → (cx, cy)``: cells whose centre lies inside, even-odd, by crossings of each row of centres."""
    w = Window.partitionBy("id").orderBy("seq")
    e = rings.withColumns({"x1": F.coalesce(F.lead("x").over(w), F.first("x").over(w)), "y1": F.coalesce(F.lead("y").over(w), F.first("y").over(w))}).where("y <> y1")
    lo = F.ceil(F.least("y", "y1") / cell - 0.5).cast("long")
    hi = (F.ceil(F.greatest("y", "y1") / cell - 0.5) - 1).cast("long")
    e = e.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn("cy", F.explode(F.sequence("_lo", "_hi")))
    x = F.col("x") + ((F.col("cy") + 0.5) * cell - F.col("y")) / (F.col("y1") - F.col("y")) * (F.col("x1") - F.col("x"))
    c = e.select("id", "cy", x.alias("at"))
    row = Window.partitionBy("id", "cy").orderBy("at")
    c = c.withColumn("k", F.row_number().over(row)).withColumn("to", F.lead("at").over(row)).where("k % 2 = 1 and to is not null")
    a, b = F.ceil(F.col("at") / cell - 0.5).cast("long"), (F.ceil(F.col("to") / cell - 0.5) - 1).cast("long")
    return c.withColumn("_a", a).withColumn("_b", b).where("_b >= _a").select(F.explode(F.sequence("_a", "_b")).alias("cx"), "cy").distinct()


def clip_runs(flagged: DataFrame, by: str) -> DataFrame:
    """``(by, seq, flag) → (by, run, from, to)``: runs of flagged vertices, one more at each side, those that touch made one, two vertices at least."""
    w = Window.partitionBy(by).orderBy("seq")
    f = flagged.withColumn("_f", F.max(F.col("flag").cast("int")).over(w.rowsBetween(-1, 1)))
    f = f.withColumn("_new", ((F.col("_f") == 1) & (F.coalesce(F.lag("_f").over(w), F.lit(0)) == 0)).cast("int")).withColumn("run", F.sum("_new").over(w)).where("_f = 1")
    return f.groupBy(by, "run").agg(F.min("seq").alias("from"), F.max("seq").alias("to")).where(F.col("from") < F.col("to"))


def medoid(points: DataFrame, by: str, point_id: str) -> DataFrame:
    """``(by, point_id, max_km)``: the member with the smallest sum of distances, and its largest one. Pairs within one small group only."""
    o = points.select(by, F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    d = points.join(o, by).withColumn("_d", haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))).groupBy(by, point_id).agg(F.sum("_d").alias("s"), F.max("_d").alias("max_km"))
    return d.groupBy(by).agg(F.min_by(F.struct(point_id, "max_km"), F.struct(F.round("s", 6), point_id)).alias("m")).select(by, f"m.{point_id}", "m.max_km")


def walk_matrix(stops: DataFrame, most_m: float = 11000.0, detour: float = 1.3, km_h: float = 5.1, cap_s: int = 7200, duration_fn: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """``(from_id, to_id, dist_m, duration_s)`` of ordered pairs on foot: great-circle distance times a detour, at walking speed; self pairs and those over the cap go.

    ``duration_fn`` gives the seconds of a way from the places of its ends (lon,
    lat, lon, lat) instead, as a pandas UDF that asks a router does; pairs
    without a way, where it is null, go.
    """
    o = stops.select(F.col("stop_id").alias("to_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), "lon", "lat")
    j = grid_join(stops.select(F.col("stop_id").alias("from_id"), "lon", "lat"), o, most_m * 1.02).where("from_id <> to_id")
    km = haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    j = j.withColumn("km", km).where(F.col("km") * 1000 <= most_m)
    seconds = duration_fn(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) if duration_fn else F.col("km") * detour / km_h * 3600
    return j.select("from_id", "to_id", F.round(F.col("km") * 1000, 3).alias("dist_m"), F.floor(seconds).cast("long").alias("duration_s")).where(F.col("duration_s") <= cap_s)
