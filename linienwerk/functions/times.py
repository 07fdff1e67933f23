"""Column functions on service times and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_gtfs_time(s: Column) -> Column:
    """Seconds since the service day began; hours may pass 24; null where it is malformed."""
    p = F.split(F.trim(s), ":")
    return F.when(F.trim(s).rlike(r"^\d{1,3}:\d{2}:\d{2}$"), p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int"))


def season_of(d: Column) -> Column:
    return F.when(F.month(d).isin(1, 2, 3), "winter").when(F.month(d).isin(6, 7, 8), "summer")


def weekday_mask(counts: Column) -> Column:
    """Seven characters: a day counts as served from half of the best day."""
    return F.array_join(F.transform(counts, lambda x: F.when((x > 0) & (x * 2 >= F.array_max(counts)), "1").otherwise("0")), "")


def log_day(stamp: Column) -> Column:
    """Local day of a log's time stamp; null for an unknown month."""
    return F.try_to_timestamp(F.regexp_extract(stamp, r"^(\d{2}/[A-Za-z]{3}/\d{4}):", 1), F.lit("dd/MMM/yyyy")).cast("date")
