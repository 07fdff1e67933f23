"""Piers: where the lines at a landing stage meet, and what is drawn there."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from linienwerk.functions.geo import haversine_km
from linienwerk.operators.spatial import grid_join
from linienwerk.shared import Stash


def pier_status(piers: DataFrame, vertices: DataFrame, others: DataFrame, pull_m: float = 75.0, converge_m: float = 20.0, collapse_m: float = 15.0, radii_m: tuple[float, ...] = (2e3, 16e3, 128e3, 1024e3)) -> DataFrame:
    """``piers (pier, lon, lat), vertices (pier, line_id, seq, lon, lat), others (lon, lat) → (pier, status, lon, lat)``.

    Each line gives its vertex nearest to the pier, or its end if that is within
    ``pull_m`` of this vertex; the place is the medoid of these. ``diverged``: one
    of them is over ``converge_m`` away; ``collapsed``: the pier is within
    ``collapse_m``; ``suppressed``: a stop of another mode is nearer to the place
    than any is to the pier; else ``split``. Stops of other modes are looked for
    in growing circles, so that only piers without one nearby go further; beyond
    the last radius there is none. Piers without lines are their own place; those
    without coordinates go; of repeated ones the smallest place counts.
    """
    stash = Stash(piers.sparkSession, "piers")
    square = lambda a, b: (a["lon"] - b["lon"]) * (a["lon"] - b["lon"]) + (a["lat"] - b["lat"]) * (a["lat"] - b["lat"])
    metres = lambda a, b: haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]) * 1000
    place = F.struct("lon", "lat")
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    p = piers.where(located & F.col("pier").isNotNull()).groupBy("pier").agg(F.min(place).alias("own"))

    v = vertices.where(located).join(p, "pier").withColumn("v", place)
    v = v.groupBy("pier", "line_id").agg(F.min_by("v", F.struct(square(F.col("v"), F.col("own")), "seq")).alias("near"), F.min_by("v", "seq").alias("first"), F.max_by("v", "seq").alias("last"))
    v = v.withColumn("end", F.when(square(F.col("last"), F.col("near")) < square(F.col("first"), F.col("near")), F.col("last")).otherwise(F.col("first")))
    v = v.withColumn("at", F.when(metres(F.col("near"), F.col("end")) <= pull_m, F.col("end")).otherwise(F.col("near")))
    # lines that end at one vertex are one member with their number
    m = v.groupBy("pier", "at").agg(F.count("*").alias("n"), F.min("line_id").alias("line_id"))
    m = m.groupBy("pier").agg(F.collect_list(F.struct("line_id", "n", "at")).alias("members"))
    total = lambda x: F.aggregate("members", F.lit(0.0), lambda s, y: s + y["n"] * metres(x["at"], y["at"]))
    m = m.withColumn("meet", F.array_min(F.transform("members", lambda x: F.struct(F.round(total(x), 6).alias("sum"), x["line_id"].alias("line_id"), x["at"].alias("at"))))["at"])
    m = m.select("pier", "meet", F.array_max(F.transform("members", lambda x: metres(x["at"], F.col("meet")))).alias("spread"))

    j = p.join(m, "pier", "left").select("pier", "own", F.coalesce("meet", "own").alias("meet"), F.coalesce("spread", F.lit(0.0)).alias("spread"))
    status = F.when(F.col("spread") > converge_m, "diverged").when(metres(F.col("own"), F.col("meet")) < collapse_m, "collapsed")
    j = stash.put(j.withColumn("status", status))

    left, found = j.where("status is null").select("pier", "own", "meet"), []
    stops = others.where(located).select("lon", "lat")
    for r in radii_m:
        ask = left.select("pier", F.explode(F.array(F.struct(F.lit(True).alias("met"), F.col("meet").alias("q")), F.struct(F.lit(False).alias("met"), F.col("own").alias("q")))).alias("x"))
        ask = ask.select("pier", "x.met", "x.q", "x.q.lon", "x.q.lat")
        d = grid_join(stops, ask, r * 1.02).withColumn("m", metres(place, F.col("q"))).where(F.col("m") <= r)
        d = d.groupBy("pier").agg(F.min(F.when(F.col("met"), F.col("m"))).alias("a"), F.min(F.when(~F.col("met"), F.col("m"))).alias("b"))
        nearer = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b")))
        found.append(stash.put(d.select("pier", F.when(nearer, "suppressed").otherwise("split").alias("by_stop"))))
        left = left.join(found[-1], "pier", "left_anti")
    by_stop = found[0]
    for f in found[1:]:
        by_stop = by_stop.union(f)
    return j.join(by_stop, "pier", "left").select("pier", F.coalesce("status", "by_stop", F.lit("split")).alias("status"), "meet.lon", "meet.lat")
