"""Greedy choices in rounds: what is first come, first served becomes a few joins.

A row may decide as soon as nothing better near it is undecided. All that can
decide do so at once, and a round's table is written to the shared folder. So
no component of rows that touch each other has to fit in a task, and the answer
is that of a loop over all rows in order. There are as many rounds as the
longest chain of neighbours, each worse than the last, in which none is dropped
early: a handful where ranks are mixed, and at worst half the chain.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.functions.geo import DEGREE_M, haversine_km
from linienwerk.operators.spatial import grid_join
from linienwerk.shared import Stash


def first_come(edges: DataFrame, order: str = "place") -> DataFrame:
    """``(a, b, place) → (b, a)``: who is dropped, and the best one kept that drops it.

    An edge says that ``a`` goes before ``b`` and keeps ``b`` from being kept.
    ``place`` orders the better ends of one ``b``, the best first. Edges must
    follow one total order. Who isn't in the result is kept. Repeated edges and
    an empty table are harmless; nulls are ignored.
    """
    stash = Stash(edges.sparkSession, "rounds")
    every = stash.put(edges.where("a is not null and b is not null").select("a", "b", order))
    left, kept = stash.put(every.select("a", "b").distinct()), None
    while left.limit(1).count():
        worse = left.select(F.col("b").alias("a")).distinct()
        now = stash.put(left.select("a").distinct().join(worse, "a", "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        gone = stash.put(left.join(now, "a", "left_semi").select("b").distinct())
        out = gone.select(F.col("b").alias("a"))
        rest = stash.put(left.join(now.unionByName(out), "a", "left_anti").join(gone, "b", "left_anti").select("a", "b"))
        stash.drop(left)
        stash.drop(gone)
        left = rest
    if kept is None:
        return every.select("b", "a")
    return every.join(kept.distinct(), "a", "left_semi").groupBy("b").agg(F.min_by("a", F.struct(order, "a")).alias("a"))


# --- boxes


def overlapping_boxes(boxes: DataFrame, by: str, box_id: str) -> DataFrame:
    """``boxes (by, box_id, w, s, e, n) → (x, y, shared, least)``: pairs of one ``by`` whose boxes overlap, x < y; the common area and the smaller box's.

    A box has the level of its longer side, rounded up to a power of two, and
    is entered in the cells of that size that it touches: four at most. There
    it meets boxes of its level and smaller ones, which are entered in the
    cells of all levels above theirs. A pair is taken in the one cell where its
    common part begins.
    """
    b = boxes.where("w < e and s < n").select(F.col(by).alias("by"), F.col(box_id).alias("id"), "w", "s", "e", "n")
    b = b.withColumn("level", F.ceil(F.log2(F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s")))).cast("int"))
    levels = b.groupBy("by").agg(F.max("level").alias("top"))

    def entered(df: DataFrame, at: Column) -> DataFrame:
        cell = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k))
        df = df.withColumn("at", at)
        df = df.withColumn("cx", F.explode(F.sequence(cell("w", F.col("at")), cell("e", F.col("at")))))
        return df.withColumn("cy", F.explode(F.sequence(cell("s", F.col("at")), cell("n", F.col("at")))))

    big = entered(b, F.col("level")).select("by", "at", "cx", "cy", F.struct("id", "w", "s", "e", "n").alias("p"))
    small = entered(b.join(levels, "by"), F.explode(F.sequence("level", "top"))).select("by", "at", "cx", "cy", F.struct("id", "w", "s", "e", "n").alias("q"), "level")
    j = big.join(small, ["by", "at", "cx", "cy"]).where((F.col("p.id") != F.col("q.id")) & ((F.col("level") < F.col("at")) | (F.col("p.id") < F.col("q.id"))))
    w, s, e, n = (f(f"p.{c}", f"q.{c}") for f, c in ((F.greatest, "w"), (F.greatest, "s"), (F.least, "e"), (F.least, "n")))
    size = F.pow(F.lit(2.0), F.col("at"))
    j = j.where((w < e) & (s < n) & (F.floor(w / size) == F.col("cx")) & (F.floor(s / size) == F.col("cy")))
    area = lambda r: (F.col(f"{r}.e") - F.col(f"{r}.w")) * (F.col(f"{r}.n") - F.col(f"{r}.s"))
    return j.select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y"), ((e - w) * (n - s)).alias("shared"), F.least(area("p"), area("q")).alias("least"))


def dedup_overlapping(features: DataFrame, share: float = 0.65, feature_id: str = "feature_id") -> DataFrame:
    """``(feature_id, ref, n_points, w, s, e, n, …) → rows`` that stay: of features with one ref, most points first (ties: smaller id), each goes whose box shares ``share`` of the smaller box with one kept.

    Features without a ref, with a null box and with one of no area stay.
    """
    boxes = features.where("ref is not null and ref <> ''")
    rank = F.struct(-F.col("n_points"), F.col(feature_id))
    pairs = overlapping_boxes(boxes, "ref", feature_id).where(F.col("shared") >= share * F.col("least"))
    ranks = boxes.select(F.col(feature_id).alias("x"), rank.alias("rx"))
    j = pairs.join(ranks, "x").join(ranks.select(F.col("x").alias("y"), F.col("rx").alias("ry")), "y")
    ahead = F.col("rx") < F.col("ry")
    edges = j.select(F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("b"), F.least("rx", "ry").alias("place"))
    return features.join(first_come(edges).select(F.col("b").alias(feature_id)), feature_id, "left_anti")


# --- clusters round seeds


#: A tile is this many radii wide, and sees as many beyond its edge that it decides for itself.
TILE_R, HALO_R = 16.0, 4.0


def cluster_stops_greedy(stops: DataFrame, radius_m: dict[str, float], lat0: float = 46.8) -> DataFrame:
    """``(stop_id, kind, lon, lat, lines) → (stop_id, cluster)``: stops join the first seed of their kind nearer than its radius, unless a line serves them and a member already.

    As in a loop over stops by id: a stop that no cluster has taken becomes a
    seed and names the cluster, and the set of lines grows with each stop that
    it takes. Kinds without a radius, and stops without a place, are clusters of
    their own; null lines are none.

    Tiles run that loop over their stops and those around them, whose choices
    the first round guesses and each later round takes from the one before. The
    smallest stop that is wrong has right ones before it, so a round mends it;
    a round that changes nothing is the loop's answer. So no pairs are made, and
    the work of a stop follows the seeds near it.
    """
    stash = Stash(stops.sparkSession, "clusters")
    kx, ky = DEGREE_M * math.cos(math.radians(lat0)), DEGREE_M
    r = F.create_map(*[F.lit(x) for k, m in radius_m.items() for x in (k, float(m))])[F.col("kind")] if radius_m else F.lit(None).cast("double")
    s = stops.select("stop_id", "kind", "lon", "lat", F.coalesce("lines", F.array().cast(stops.schema["lines"].dataType)).alias("lines")).withColumn("r", r)
    placed = F.col("r").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    nothing = F.lit(None).cast(stops.schema["stop_id"].dataType)
    state = stash.put(s.withColumns({"cluster": F.when(placed, nothing).otherwise(F.col("stop_id")), "changed": placed}))
    alone, state = state.where("not changed").select("stop_id", "cluster"), state.where("changed")
    first = True
    while state.where("changed").limit(1).count():
        x, y, w, edge = F.col("lon") * kx, F.col("lat") * ky, F.col("r") * TILE_R, F.col("r") * (HALO_R + 2.01)
        over = lambda c: F.explode(F.sequence(F.floor((c - edge) / w), F.floor((c + edge) / w)))  # noqa: E731, B023
        out = lambda c, t: F.greatest(F.lit(0.0), F.col(t) * w - c, c - (F.col(t) + 1) * w)  # noqa: E731, B023
        t = state.withColumn("tx", over(x)).withColumn("ty", over(y))
        inside = (F.floor(x / w) == F.col("tx")) & (F.floor(y / w) == F.col("ty"))
        free = F.lit(True) if first else F.greatest(out(x, "tx"), out(y, "ty")) <= F.col("r") * HALO_R
        t = t.select(*state.columns, "tx", "ty", inside.alias("inside"), (inside | free).alias("free"))
        new = stash.put(t.groupBy("kind", "tx", "ty").applyInArrow(_cluster_tile(kx, ky), state.schema))
        if not first:  # the first table holds the stops alone too
            stash.drop(state)
        state, first = new, False
    return alone.unionByName(state.select("stop_id", "cluster"))


def _cluster_tile(kx: float, ky: float) -> Callable[[pa.Table], pa.Table]:
    """The loop over a tile's stops by id: free ones choose, the others repeat what the last round chose for them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("stop_id").combine_chunks()
        ids, given = t["stop_id"].to_pylist(), t["cluster"].to_pylist()
        lon, lat, free, lines = t["lon"].to_pylist(), t["lat"].to_pylist(), t["free"].to_pylist(), t["lines"].to_pylist()
        r = t["r"][0].as_py()
        cells: dict[tuple[int, int], tuple[list[int], dict]] = {}  # seeds by place; of each line, a bit for each seed that has it
        of: dict = {}  # of each seed, its cell and its bit
        took = [None] * len(ids)
        row = {k: i for i, k in enumerate(ids)}
        for i, k in enumerate(ids):
            x, y = lon[i], lat[i]
            mine = [g for g in lines[i] if g is not None]
            if free[i]:
                cx, cy, best = math.floor(x * kx / r), math.floor(y * ky / r), None
                for a in (cx - 1, cx, cx + 1):
                    for b in (cy - 1, cy, cy + 1):
                        c = cells.get((a, b))
                        if c is None:
                            continue
                        seeds, has = c
                        full = 0
                        for g in mine:
                            full |= has.get(g, 0)
                        open_ = ((1 << len(seeds)) - 1) & ~full
                        while open_:
                            low = open_ & -open_
                            j = seeds[low.bit_length() - 1]
                            if best is not None and j > best:
                                break
                            if math.sqrt(((lon[j] - x) * kx) ** 2 + ((lat[j] - y) * ky) ** 2) < r:
                                best = j
                                break
                            open_ ^= low
                j = i if best is None else best
            else:
                j = row.get(given[i])
                if j is None or (j != i and j not in of):
                    continue
            if j == i:
                c = cells.setdefault((math.floor(x * kx / r), math.floor(y * ky / r)), ([], {}))
                of[i] = c[1], 1 << len(c[0])
                c[0].append(i)
            took[i] = ids[j]
            has, bit = of[j]
            for g in mine:
                has[g] = has.get(g, 0) | bit
        inside = t["inside"].to_pylist()
        keep = pa.array([i for i, x in enumerate(inside) if x], pa.int64())
        new = pa.array([took[i] for i, x in enumerate(inside) if x], t.schema.field("stop_id").type)
        out = t.take(keep).select(["stop_id", "kind", "lon", "lat", "lines", "r"])
        return out.append_column("cluster", new).append_column("changed", pa.array([took[i] != given[i] for i, x in enumerate(inside) if x], pa.bool_()))

    return run


# --- stops that take others in on small maps

ZOOMS = tuple(range(7, 14))
#: Metres of the equator, and map units that a tile has at zoom 0; fixed by the map's projection.
EQUATOR_M, TILE_PX = 40075016.7, 512.0


def metres_per_px(zoom: int, lat: float = 46.5) -> float:
    return EQUATOR_M * math.cos(math.radians(lat)) / (TILE_PX * 2**zoom)


def absorb_stops(stops: DataFrame, spacing_px: float = 2.0, lat0: float = 46.5) -> DataFrame:
    """``(stop_id, lon, lat, rank, score, min_zoom, px7, px13, dep_hr, lines) → (stop_id, absorbed_z, absorber, score, dep_hr, lines)``.

    From zoom 13 down to 7, of two visible stops whose dots touch (half their
    diameters and ``spacing_px``) the one of higher rank, then higher score at
    this zoom, then smaller id takes the other in, best first. It is then drawn
    no more at this zoom and below, and its score, departures and lines at each
    zoom from its ``min_zoom`` up to this one are added to the other's. A
    diameter goes evenly from ``px7`` to ``px13`` and doesn't grow with the score.

    ``score``, ``dep_hr`` and ``lines`` (sorted, each once) come back as arrays
    for zooms 7 to 13. ``absorbed_z`` and ``absorber`` are null for stops that
    stay. Stops without a place stay; null scores, departures and lines count
    as none. ``stop_id`` must be distinct.
    """
    stash = Stash(stops.sparkSession, "absorbed")
    kind = stops.schema["lines"].dataType
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    each = lambda c: F.array(*[c] * len(ZOOMS))
    own = F.coalesce(F.array_distinct("lines"), F.array().cast(kind))
    state = stash.put(stops.select("stop_id", "lon", "lat", "rank", "min_zoom", "px7", "px13", each(zero("score")).alias("score"), each(zero("dep_hr")).alias("dep_hr"), each(own).alias("lines"), F.lit(None).cast("int").alias("absorbed_z"), F.lit(None).cast(stops.schema["stop_id"].dataType).alias("absorber")))
    widest = state.agg(F.max(F.greatest("px7", "px13"))).first()[0]
    if widest is None:
        return state.select("stop_id", "absorbed_z", "absorber", "score", "dep_hr", "lines")
    for z in reversed(ZOOMS):
        edges = touching(state.where((F.col("min_zoom") <= z) & F.col("absorber").isNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()), z, float(widest) + spacing_px, spacing_px, lat0)
        taken = stash.put(first_come(edges).select(F.col("b").alias("stop_id"), F.col("a").alias("by")))
        if not taken.limit(1).count():
            stash.drop(taken)
            continue
        gain = taken.join(state, "stop_id")
        counts = [(k, k - ZOOMS[0], (F.col("min_zoom") <= k) & F.lit(k <= z)) for k in ZOOMS]
        sums = [F.sum(F.when(ok, F.col(c)[i]).otherwise(0.0)).alias(f"{c}{k}") for c in ("score", "dep_hr") for k, i, ok in counts]
        some = [F.flatten(F.collect_list(F.when(ok, F.col("lines")[i]))).alias(f"lines{k}") for k, i, ok in counts]
        got = gain.groupBy(F.col("by").alias("stop_id")).agg(*sums, *some)
        plus = lambda c: F.array(*[F.col(c)[i] + F.coalesce(f"{c}{k}", F.lit(0.0)) for k, i, _ in counts]).alias(c)  # noqa: E731, B023
        union = F.array(*[F.array_union(F.col("lines")[i], F.coalesce(f"lines{k}", F.array().cast(kind))) for k, i, _ in counts]).alias("lines")
        j = state.join(got, "stop_id", "left").join(taken, "stop_id", "left")
        new = stash.put(j.select("stop_id", "lon", "lat", "rank", "min_zoom", "px7", "px13", plus("score"), plus("dep_hr"), union, F.when(F.col("by").isNotNull(), z).otherwise(F.col("absorbed_z")).alias("absorbed_z"), F.coalesce("absorber", "by").alias("absorber")))
        stash.drop(state)
        stash.drop(taken)
        state = new
    return state.select("stop_id", "absorbed_z", "absorber", "score", "dep_hr", F.transform("lines", lambda x: F.array_sort(x)).alias("lines"))


def touching(visible: DataFrame, zoom: int, most_px: float, spacing_px: float, lat0: float) -> DataFrame:
    """``(a, b, place)``: stops whose dots touch at a zoom, the better one first."""
    t, i, unit = (zoom - ZOOMS[0]) / (ZOOMS[-1] - ZOOMS[0]), zoom - ZOOMS[0], metres_per_px(zoom, lat0)
    wide = F.col("px7") + t * (F.col("px13") - F.col("px7"))
    # higher ranks and scores first
    dot = visible.select("stop_id", "lon", "lat", (wide / 2).alias("r"), F.struct((-F.col("rank")).alias("rank"), (-F.col("score")[i]).alias("score"), "stop_id").alias("place"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("stop_id", "r", "place")]
    # flat distances are a little off the great circle's: cells a little wider find all pairs
    j = grid_join(dot.select(*side("p"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), "lon", "lat"), dot.select(*side("q"), F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "lon", "lat"), most_px * unit * 1.02, lat0)
    far = haversine_km(F.col("p_lon"), F.col("p_lat"), F.col("q_lon"), F.col("q_lat")) * 1000
    j = j.where((F.col("p_place") < F.col("q_place")) & (far / unit <= F.col("p_r") + F.col("q_r") + spacing_px))
    return j.select(F.col("p_stop_id").alias("a"), F.col("q_stop_id").alias("b"), F.col("p_place").alias("place"))


# --- stops along a line


def spaced_along(places: DataFrame, order: Column) -> DataFrame:
    """``(key, idx, km, min_km) → rows`` that stay: of a key's places, in the given order, each unless one kept is nearer along the line than ``min_km``.

    Neighbours meet in stretches of ``min_km``; a place is entered in its own
    and looks into the next, so that long lines give no pairs of their own. A
    null ``km`` goes; a ``min_km`` of nothing keeps all.
    """
    p = places.where("km is not null").withColumn("place", order).withColumn("cell", F.floor(F.col("km") / F.nullif(F.col("min_km"), F.lit(0.0))))
    left = p.select("key", "cell", F.col("idx").alias("i"), F.col("km").alias("ki"), F.col("place").alias("pi"), "min_km")
    right = p.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") - 1))).select("key", "cell", F.col("idx").alias("j"), F.col("km").alias("kj"), F.col("place").alias("pj"))
    same = F.floor(F.col("kj") / F.col("min_km")) == F.col("cell")
    j = left.join(right, ["key", "cell"]).where((F.abs(F.col("ki") - F.col("kj")) < F.col("min_km")) & (F.col("i") != F.col("j")) & (~same | (F.col("i") < F.col("j"))))
    ahead = F.col("pi") < F.col("pj")
    end = lambda c: F.struct("key", F.col(c).alias("idx"))
    edges = j.select(F.when(ahead, end("i")).otherwise(end("j")).alias("a"), F.when(ahead, end("j")).otherwise(end("i")).alias("b"), F.least("pi", "pj").alias("place"))
    gone = first_come(edges).select("b.key", "b.idx")
    return places.where("km is not null").join(gone, ["key", "idx"], "left_anti")


# --- batches along an order


def ordered_batches(points: DataFrame, order: str, point_id: str, most: int = 50, span_m: float = 50_000.0, lat0: float = 46.8) -> DataFrame:
    """``(order, point_id, lon, lat) → (point_id, batch)``: rows in order; a new batch begins after ``most`` rows or where a batch's box would have a diagonal over ``span_m``.

    Each row is numbered and points to the row where a batch that began with it
    would end; it needs the next ``most`` rows only. Which rows really begin one
    follows by doubling these pointers from the first. So batches don't depend
    on how the rows are partitioned. ``batch`` is the number of its first row.
    """
    stash = Stash(points.sparkSession, "batches", merge=True)
    rows = points.select(F.col(order).alias("key"), F.col(point_id).alias("id"), "lon", "lat")
    at = stash.put(_numbered(rows, stash))
    # blocks of ``most`` rows, each with the block after it, hold all that a row must see
    blocks = at.withColumn("block", F.floor(F.col("n") / most)).withColumn("of", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    seen = blocks.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("n", "lon", "lat", "block"))).alias("rows"))
    kx, ky = 111_320 * math.cos(math.radians(lat0)), 111_320.0

    def ends(x: Column) -> Column:
        """The number of the first row after ``x`` that its batch hasn't room for."""
        box = F.struct(x["lon"].alias("w"), x["lon"].alias("e"), x["lat"].alias("s"), x["lat"].alias("t"), (x["n"] + 1).alias("next"), F.lit(True).alias("open"))

        def grow(a: Column, r: Column) -> Column:
            w, e, s, t = F.least(a["w"], r["lon"]), F.greatest(a["e"], r["lon"]), F.least(a["s"], r["lat"]), F.greatest(a["t"], r["lat"])
            fits = a["open"] & (F.hypot((e - w) * kx, (t - s) * ky) <= span_m)
            return F.when(fits, F.struct(w.alias("w"), e.alias("e"), s.alias("s"), t.alias("t"), (r["n"] + 1).alias("next"), F.lit(True).alias("open"))).otherwise(F.struct(a["w"], a["e"], a["s"], a["t"], a["next"], F.lit(False).alias("open")))

        later = F.filter("rows", lambda r: (r["n"] > x["n"]) & (r["n"] < x["n"] + most))
        return F.aggregate(later, box, grow)["next"]

    mine = F.filter("rows", lambda r: r["block"] == F.col("of"))
    hop = stash.put(seen.select(F.explode(F.transform(mine, lambda x: F.struct(x["n"].alias("n"), ends(x).alias("to")))).alias("h")).select("h.n", "h.to"))
    # after k rounds the first 2**k beginnings are known, and pointers skip 2**k batches
    first = stash.put(at.where("n = 0").select("n"))
    while True:
        new = first.join(hop, "n").select(F.col("to").alias("n")).join(at.select("n"), "n", "left_semi")
        more = stash.put(first.unionByName(new).distinct())
        if more.count() == first.count():
            break
        hop = stash.put(hop.join(hop.select(F.col("n").alias("to"), F.col("to").alias("on")), "to").select("n", F.col("on").alias("to")))
        first = more
    # a batch's rows are fewer than ``most`` after its first, which is in their block or the one before
    starts = first.select(F.col("n").alias("batch")).withColumn("block", F.floor(F.col("batch") / most)).withColumn("block", F.explode(F.array(F.col("block"), F.col("block") + 1)))
    j = at.withColumn("block", F.floor(F.col("n") / most)).join(starts, "block").where("batch <= n")
    return j.groupBy("id").agg(F.max("batch").alias("batch")).withColumnRenamed("id", point_id)


def _numbered(rows: DataFrame, stash: Stash) -> DataFrame:
    """Rows with their number ``n`` in the order of key and id: the place in a range, after the rows of the ranges before it."""
    part = stash.put(rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").withColumn("m", F.monotonically_increasing_id()))
    part = part.withColumns({"range": F.shiftright("m", 33), "k": F.col("m").bitwiseAND((1 << 33) - 1)}).drop("m")
    sizes = part.groupBy("range").agg(F.count("*").alias("rows"))  # a row for each range
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.join(sizes.select("range", before.alias("before")), "range").withColumn("n", F.col("before") + F.col("k")).drop("range", "k", "before")
