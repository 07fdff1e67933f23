"""Timetable feeds: CSV tables with explicit schemas, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from linienwerk.functions.times import parse_gtfs_time

#: Columns of the feed's tables that operators use (fixed values).
COLUMNS = {
    "agency": "agency_id agency_name",
    "routes": "route_id agency_id route_short_name route_long_name route_type",
    "trips": "trip_id route_id service_id shape_id direction_id",
    "stops": "stop_id stop_name stop_lat stop_lon location_type parent_station platform_code didok original_stop_id",
    "stop_times": "trip_id stop_id arrival_time departure_time stop_sequence pickup_type drop_off_type shape_dist_traveled",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "frequencies": "trip_id start_time end_time headway_secs",
    "transfers": "from_route_id to_route_id from_trip_id to_trip_id",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_gtfs(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the feed, all columns text: byte order mark dropped, blanks null, absent columns null, unknown ones kept.

    A missing file raises; only frequencies may be absent, and are empty then.
    """
    want = COLUMNS[table].split()
    path = f"{folder}/{table}.txt"
    if table == "frequencies" and not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in want))
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    df = df.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in df.columns])
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in want if c not in df.columns])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def scan_stop_times(spark: SparkSession, folder: str) -> DataFrame:
    """``(trip_id, seq, stop_id, arr, dep)`` in seconds; rows with malformed times go."""
    t = scan_gtfs(spark, folder, "stop_times")
    s = t.select("trip_id", F.expr("try_cast(stop_sequence as int)").alias("seq"), "stop_id", parse_gtfs_time(F.col("arrival_time")).alias("arr"), parse_gtfs_time(F.col("departure_time")).alias("dep"))
    return s.where("seq is not null and arr is not null and dep is not null")


def scan_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """``(shape_id, seq, lon, lat)``; bad numbers go."""
    t = scan_gtfs(spark, folder, "shapes")
    return t.selectExpr("shape_id", "try_cast(shape_pt_sequence as int) seq", "try_cast(shape_pt_lon as double) lon", "try_cast(shape_pt_lat as double) lat").where("seq is not null and lon is not null and lat is not null")


def scan_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    t = scan_gtfs(spark, folder, "frequencies")
    return t.select("trip_id", parse_gtfs_time(F.col("start_time")).alias("start_s"), parse_gtfs_time(F.col("end_time")).alias("end_s"), F.expr("try_cast(headway_secs as int)").alias("headway_s")).where("start_s is not null and end_s is not null and headway_s is not null")


def scan_platform_attributes(spark: SparkSession, path: str) -> DataFrame:
    """``(sloid, length, compass)`` of boarding platforms; blank or malformed numbers are null."""
    t = spark.read.option("header", True).option("sep", ";").csv(path)
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns]).where("trafficPointElementType = 'BOARDING_PLATFORM'")
    return t.selectExpr("sloid", "try_cast(length as double) length", "try_cast(compassDirection as double) compass")


def sink_feed(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as CSV folders ``<table>.txt`` with headers; every column is quoted where it must be."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.txt")


def load_overrides(spark: SparkSession, entries: list[dict], schema: str) -> DataFrame:
    """A section of hand-kept rules as a small table; entries without every column of the schema are skipped."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in entries if all(e.get(n) is not None for n in names)], schema)
