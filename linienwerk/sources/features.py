"""Map features, access logs and shared journeys: text and JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FEATURE = "struct<type:string, id:string, geometry:struct<type:string, coordinates:string>, properties:map<string,string>>"

#: Street classes that people walk on (fixed values).
STREETS = "primary secondary tertiary unclassified residential living_street pedestrian footway path track steps cycleway service road trunk".split()


def _feature(raw: Column) -> Column:
    return F.from_json(raw, FEATURE)


def scan_geojson_seq(spark: SparkSession, path: str) -> DataFrame:
    """``(id, geom_type, coords, props)`` of a sequence of features, a record a line with or without its separator; malformed lines go."""
    t = spark.read.text(path).select(_feature(F.regexp_replace("value", "^\u001e", "")).alias("f")).where("f.type = 'Feature' and f.geometry is not null")
    return t.select("f.id", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coords"), F.col("f.properties").alias("props"))


def scan_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(id, props, line array<struct<lon, lat>>)``: line strings of two points or more, third numbers dropped, equal neighbours made one."""
    t = spark.read.option("wholetext", True).text(path)
    t = t.select(F.explode(F.from_json("value", f"struct<features:array<{FEATURE}>>")["features"]).alias("f")).where("f.geometry.type = 'LineString'")
    pts = F.transform(F.from_json("f.geometry.coordinates", "array<array<double>>"), lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return t.select("f.id", F.col("f.properties").alias("props"), line_points(pts).alias("line")).where("size(line) >= 2")


def line_points(pts: Column) -> Column:
    """Points without those equal to the one before."""
    bound = F.transform(F.array(pts), lambda a: F.filter(a, lambda p, i: (i == 0) | (p != F.get(a, i - 1))))
    return bound[0]


def scan_access_log(spark: SparkSession, glob: str) -> DataFrame:
    """``line`` of the log and its rotated siblings, compressed ones too."""
    return spark.read.text(glob).select(F.col("value").alias("line"))


def osm_tag_filter(features: DataFrame, rule: str) -> DataFrame:
    p = F.col("props")
    rules = {
        "rail": p["railway"].isin("rail", "narrow_gauge", "funicular", "light_rail"),
        "tram": p["railway"] == "tram",
        "street": p["highway"].isin(STREETS),
        "platform": (p["railway"] == "platform") | (p["public_transport"] == "platform"),
        "building": p["building"].isNotNull() & (p["building"] != "no"),
        "built_up": p["landuse"].isin("residential", "commercial", "retail", "industrial", "construction", "garages", "education", "institutional", "religious", "cemetery"),
    }
    return features.where(F.coalesce(rules[rule], F.lit(False)))


def keep_tags(props: Column, names: list[str]) -> Column:
    return F.map_filter(props, lambda k, v: k.isin(names) & v.isNotNull() & (v != ""))


def patch_foot_access(props: Column) -> Column:
    """Farm and forest ways without a rule for walkers are open to them."""
    closed = F.coalesce(props["access"].isin("agricultural", "forestry"), F.lit(False)) & props["foot"].isNull()
    return F.when(closed, F.map_concat(F.map_filter(props, lambda k, v: k != "foot"), F.create_map(F.lit("foot"), F.lit("yes")))).otherwise(props)


def sink_features(lines: DataFrame, path: str) -> None:
    """``(lon_lat array<array<double>>, min_zoom, …)`` as GeoJSON features, a record a line."""
    props = F.struct(*[c for c in lines.columns if c not in ("lon_lat", "min_zoom")])
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.col("lon_lat").alias("coordinates")).alias("geometry"), props.alias("properties"), F.struct(F.col("min_zoom").alias("minzoom")).alias("tippecanoe"))
    lines.select(F.to_json(f).alias("value")).write.mode("overwrite").text(path)


def mode_group(mode: Column) -> Column:
    return F.when(mode.isin("train", "mountain", "metro"), "rail").when(mode == "tram", "tram").when(mode == "regional_bus", "regional").otherwise("bus")


def sink_by_mode_group(stops: DataFrame, path: str) -> None:
    """Stops in a folder for each group of modes, so that a reader of one group opens its files alone."""
    stops.withColumn("grp", mode_group(F.col("mode"))).write.mode("overwrite").partitionBy("grp").parquet(path)


def sink_lookup(df: DataFrame, key: str, path: str) -> None:
    """A keyed lookup table, sorted by key within files."""
    df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def sink_lookup_json(df: DataFrame, key: str, path: str) -> None:
    """A keyed lookup as JSON, a record a line, in the order of its keys over all files."""
    df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), key).sortWithinPartitions(key).write.mode("overwrite").json(path)


SHARE = "struct<v:int, fingerprint:string, `from`:struct<type:string, uic:string, lat:double, lon:double>, `to`:struct<type:string, uic:string, lat:double, lon:double>, itinerary:struct<startTime:string, endTime:string, legs:array<struct<mode:string, startTime:string, endTime:string>>>, legColors:array<string>>"


def validate_share(raw: DataFrame) -> DataFrame:
    """``(id, json) → (id, share, valid)``: version, fingerprint, endpoints, times, 1 to 30 legs, text lengths and colours must be sound."""
    s = raw.withColumn("share", F.from_json("json", SHARE))
    iso = lambda c: c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    end = lambda e: ((e["type"] == "station") & (F.length(e["uic"]).between(1, 300))) | (e["type"].isin("point", "current") & e["lat"].between(-90, 90) & e["lon"].between(-180, 180))
    x, it = F.col("share"), F.col("share.itinerary")
    ok = (x["v"] == 1) & x["fingerprint"].rlike("^[0-9a-f]{8}$") & end(x["from"]) & end(x["to"]) & iso(it["startTime"]) & iso(it["endTime"]) & F.size(it["legs"]).between(1, 30)
    ok = ok & F.forall(it["legs"], lambda leg: (F.length(leg["mode"]) <= 300) & iso(leg["startTime"]) & iso(leg["endTime"])) & (F.size(x["legColors"]) == F.size(it["legs"])) & F.forall(x["legColors"], lambda c: c.rlike("^#[0-9a-fA-F]{6}$"))
    return s.select("id", "share", F.coalesce(ok, F.lit(False)).alias("valid"))


def strip_legs(legs: Column) -> Column:
    """Legs without geometry and intermediate stops."""
    return F.transform(legs, lambda leg: leg.dropFields("legGeometry", "intermediateStops"))


def strip_itinerary(origin: Column, target: Column, legs: Column) -> tuple[Column, Column, Column]:
    """What is shared of a journey: endpoints ``(type, uic, lat, lon)`` and bare legs ``(…, from (lat, lon), to (lat, lon))``.

    An endpoint that was the place of the user then is that of the first leg's
    start or the last one's end.
    """

    def fixed(e: Column, place: Column) -> Column:
        here = F.struct(F.lit("point").alias("type"), F.lit(None).cast("string").alias("uic"), place["lat"].alias("lat"), place["lon"].alias("lon"))
        return F.when(e["type"] == "current", here).otherwise(e)

    return fixed(origin, F.get(legs, F.lit(0))["from"]), fixed(target, F.get(legs, F.size(legs) - 1)["to"]), strip_legs(legs)


def merge_lines_json(a: Column, b: Column) -> Column:
    """The union of two JSON lists of lines by name and mode."""
    kind = "array<struct<ref:string,mode:string>>"
    return F.to_json(F.array_sort(F.array_union(F.coalesce(F.from_json(a, kind), F.array().cast(kind)), F.coalesce(F.from_json(b, kind), F.array().cast(kind)))))
