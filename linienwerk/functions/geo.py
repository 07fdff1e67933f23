"""Column functions on coordinates; degrees in, kilometres or metres out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Metres of a degree of latitude.
DEGREE_M = 111320.0


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lat0: Column | float, degree_m: float = DEGREE_M) -> Column:
    lat0 = F.lit(lat0) if isinstance(lat0, float) else lat0
    return F.sqrt(F.pow((lon2 - lon1) * degree_m * F.cos(F.radians(lat0)), 2) + F.pow((lat2 - lat1) * degree_m, 2))


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float] = (5.93, 45.80, 10.52, 47.83)) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def bbox_overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area, of structs (w, s, e, n)."""
    w = F.least(a["e"], b["e"]) - F.greatest(a["w"], b["w"])
    h = F.least(a["n"], b["n"]) - F.greatest(a["s"], b["s"])
    area = lambda x: (x["e"] - x["w"]) * (x["n"] - x["s"])
    least = F.least(area(a), area(b))
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least).otherwise(0.0)
