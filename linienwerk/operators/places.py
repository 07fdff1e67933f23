"""Names of places found by a search, and where the lines of a station head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.functions.geo import haversine_km
from linienwerk.operators.graph import connected_components
from linienwerk.shared import Stash

#: Kinds of features whose name is that of the place itself, not of an address (fixed values).
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "historic", "office", "craft", "healthcare", "sport", "man_made", "emergency", "aeroway", "aerialway", "railway")

#: Metres within which a feature is at a point, and within which it is if the point lies in its box (fixed values).
AT_M, IN_BOX_M = 60.0, 200.0


def _given(c: Column | str) -> Column:
    return F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(""))


def _with_city(label: Column) -> Column:
    city = F.coalesce(_given("city"), _given("county"), _given("state"))
    return F.when(city.isNull() | (city == label), label).otherwise(F.concat(label, F.lit(", "), city))


def _street() -> Column:
    return F.concat(_given("street"), F.coalesce(F.concat(F.lit(" "), _given("housenumber")), F.lit("")))


def place_label() -> Column:
    """``(name, street, housenumber, city, county, state, osm_key) → struct(label, kind)``: a place of interest by its name, else the street with its number, else the name; each with its city. Null if there is neither."""
    item = lambda label, kind: F.struct(_with_city(label).alias("label"), F.lit(kind).alias("kind"))
    name = _given("name")
    out = F.when(F.col("osm_key").isin(*POI_KEYS) & name.isNotNull(), item(name, "poi")).when(_given("street").isNotNull(), item(_street(), "address"))
    return out.when((F.col("osm_key") == "highway") & name.isNotNull(), item(name, "address")).when(name.isNotNull(), item(name, "place"))


def reverse_label(features: DataFrame, queries: DataFrame) -> DataFrame:
    """``features (q_id, ord, name, street, …, lon, lat, w, s, e, n), queries (q_id, lon, lat) → (q_id, label)``.

    The address of the first feature in order that has one and is at the point;
    else ``Nähe`` and the first name or street; else null.
    """
    q = queries.select("q_id", F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    j = features.join(q, "q_id")
    m = haversine_km(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y")) * 1000
    boxed = F.coalesce(F.col("_x").between(F.col("w"), F.col("e")) & F.col("_y").between(F.col("s"), F.col("n")), F.lit(False))
    at = (m <= AT_M) | (boxed & (m <= IN_BOX_M))
    address = F.when(_given("street").isNotNull(), _with_city(_street())).when(F.col("osm_key") == "highway", _with_city(_given("name")))
    near = F.concat(F.lit("Nähe "), _with_city(F.coalesce(_given("name"), _given("street"))))
    first = lambda label: F.min_by(label, F.when(label.isNotNull(), F.col("ord")))
    g = j.groupBy("q_id").agg(first(F.when(at, address)).alias("_at"), first(near).alias("_near"))
    return queries.select("q_id").join(g, "q_id", "left").select("q_id", F.coalesce("_at", "_near").alias("label"))


def directions_from_station(visits: DataFrame, names: DataFrame) -> DataFrame:
    """``visits (ref, mode, variant long, seq, uic), names (uic, name) → (uic, ref, mode, text)``: where the variants of a line head from each station.

    Variants whose ways on share a station head the same way; one whose end lies
    on another's way is left out; a station where the line begins or ends is a
    side of its own. Ways on are linked through the first variant of each of
    their stations, so variants aren't paired to find the sides.
    """
    by = ["uic", "ref", "mode"]
    w = Window.partitionBy("variant")
    v = visits.withColumn("_all", F.array_sort(F.collect_list(F.struct("seq", "uic")).over(w)))
    v = v.withColumn("_first", F.min("seq").over(Window.partitionBy("variant", "uic"))).where("seq = _first")
    stops = F.transform("_all", lambda x: x["uic"])
    pos = F.array_position(stops, F.col("uic"))
    v = Stash(v.sparkSession, "ways").put(v.select(*by, "variant", F.slice(stops, pos + 1, F.size("_all")).alias("tail"), ((pos == 1) | (pos == F.size("_all"))).alias("end")))
    ends = v.groupBy(*by).agg(F.bool_or("end").alias("is_end"))
    t = v.where("size(tail) > 0").withColumn("last", F.element_at("tail", -1)).withColumn("node", F.concat_ws("\u001f", *by, F.lpad(F.col("variant").cast("string"), 20, "0")))
    met = t.select(*by, "node", F.explode(F.array_distinct("tail")).alias("at"))
    edges = met.withColumn("dst", F.min("node").over(Window.partitionBy(F.xxhash64(*by, "at"), *by, "at"))).select(F.col("node").alias("src"), "dst")
    side = connected_components(edges, t.select(F.col("node").alias("id"))).withColumnRenamed("id", "node")
    t = t.join(side, "node")
    # an end that lies on the way of another variant of its side; a variant's own way counts only through others
    inner = t.select("component", F.col("variant").alias("_o"), F.explode(F.array_distinct(F.slice("tail", F.lit(1), F.size("tail") - 1))).alias("last"))
    on = inner.groupBy("component", "last").agg(F.min("_o").alias("_a"), F.max("_o").alias("_b"))
    t = t.join(on, ["component", "last"], "left").where("_a is null or (_a = variant and _b = variant)")
    n = names.select(F.col("uic").alias("last"), F.col("name").alias("_name"))
    k = t.join(n, "last").where("_name <> ''").groupBy(*by, "component", "_name").agg(F.min("node").alias("o"))
    s = k.groupBy(*by, "component").agg(F.array_sort(F.collect_list(F.struct("o", "_name"))).alias("l"))
    s = s.select(*by, "component", F.transform("l", lambda x: x["_name"]).alias("l"))
    g = s.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("component", "l"))).alias("sides"))
    g = g.join(ends, by).join(names.select("uic", "name"), "uic")
    sides = F.transform("sides", lambda x: x["l"])
    listed = F.array_contains(F.flatten(sides), F.col("name"))
    sides = F.when(F.col("is_end") & (F.col("name") != "") & ~listed, F.concat(sides, F.array(F.array("name")))).otherwise(sides)
    return g.select(*by, F.array_join(F.transform(sides, lambda x: F.array_join(x, " · ")), " ↔ ").alias("text"))
