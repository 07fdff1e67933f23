"""Column functions on lines: buckets, modes, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Route type codes, operator ids, and thresholds of the published rules.
TRAIN_TYPES = ["100", "101", "102", "103", "105", "106", "107", "109"]
MOUNTAIN_TYPES = ["116", "1300", "1303", "1400"]
TWO_DIGIT_REGIONAL = ["146", "605", "859", "766", "236", "801", "7088", "812", "819"]
CITY_HUNDREDS = ["153", "792"]
BEST = {"train": 4.0, "tram": 8.6, "metro": 12.0, "bus": 10.0, "regional_bus": 2.0, "ferry": 1.33, "mountain": 1.0}
WORST = {"train": 0.25, "tram": 0.6, "metro": 0.8, "bus": 0.75, "regional_bus": 0.17, "ferry": 0.010, "mountain": 0.05}
WIDTH = {"train": (2.0, 5.0), "tram": (0.7, 3.0), "metro": (1.0, 3.0), "bus": (0.7, 2.5), "regional_bus": (1.0, 2.0), "ferry": (1.0, 2.5), "mountain": (1.5, 1.5)}
MODE_WEIGHT = {"bus": 1.0, "regional_bus": 1.0, "tram": 1.5, "metro": 2.0, "train": 3.0, "mountain": 3.0, "ferry": 3.0}
CLASS_WEIGHT = {"ic": 6.0, "ir": 5.0, "re": 4.0}
INTERCITY = ("IC", "ICE", "EC")
MODE_RANK = ("train", "metro", "tram", "bus", "mountain", "ferry", "regional_bus")
TIERS = ("major_train", "main_train", "important_train", "train_station", "small_train", "major_mountain", "ferry_stop", "mountain_stop", "major_hub", "big_station", "normal_stop", "small_bus")


def lookup(key: Column, table: dict, default=None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def route_bucket(route_type: Column) -> Column:
    t = F.trim(route_type)
    return F.when(t.isin(TRAIN_TYPES), "train").when(t.isin(MOUNTAIN_TYPES), "mountain").when(t == "401", "metro").when(t.isin("700", "702", "800"), "bus").when(t == "900", "tram").when(t == "1000", "ferry").otherwise("")


def rebucket_mountain(bucket: Column, agency: Column, ids: list[str]) -> Column:
    return F.when((bucket == "train") & agency.isin(ids), "mountain").otherwise(bucket)


def bus_mode(bucket: Column, agency: Column, ref: Column, length_km: Column, route_type: Column) -> Column:
    digits = F.regexp_replace(F.trim(ref), "[^0-9]", "")
    n = F.length(digits)
    regional = (n >= 3) | ((n == 2) & agency.isin(TWO_DIGIT_REGIONAL)) | ((n == 0) & F.coalesce(length_km >= 10.0, F.lit(False)))
    city = (route_type == "800") | ((n == 3) & agency.isin(CITY_HUNDREDS) & F.substring(digits, 1, 1).isin("1", "3"))
    return F.when(bucket != "bus", bucket).when(city | ~regional, "bus").otherwise("regional_bus")


def mountain_origin(bucket: Column, route_type: Column) -> Column:
    return F.when(bucket == "mountain", F.when(route_type == "1400", "funicular").when(route_type.isin("1300", "1303"), "aerial").when(route_type == "116", "rack").when(route_type.isin(TRAIN_TYPES), "rebucketed_rail"))


def freq_gate_exempt(bucket: Column, origin: Column) -> Column:
    return (bucket == "mountain") & F.coalesce(origin.isin("aerial", "funicular"), F.lit(False))


def gate_exempt(bucket: Column, origin: Column) -> Column:
    return (bucket == "ferry") | freq_gate_exempt(bucket, origin)


def in_service_area(uic: Column, include: list[str], exclude: list[str]) -> Column:
    return F.when(uic.isin(include), True).when(uic.isin(exclude), False).otherwise(F.startswith(uic, F.lit("85")))


def is_intercity(ref: Column, mode: Column) -> Column:
    hit = F.lit(False)
    for p in INTERCITY:
        hit = hit | F.startswith(F.upper(ref), F.lit(p))
    return (mode == "train") & hit


def line_weight(ref: Column, mode: Column) -> Column:
    """Weight of a mode; trains by the class that their name tells."""
    r = F.upper(F.coalesce(ref, F.lit("")))
    train = F.when(is_intercity(r, mode), CLASS_WEIGHT["ic"]).when(F.startswith(r, F.lit("IR")), CLASS_WEIGHT["ir"]).when(F.startswith(r, F.lit("RE")) | r.rlike(r"^R($|[^\p{L}])"), CLASS_WEIGHT["re"]).otherwise(MODE_WEIGHT["train"])
    return F.when(mode == "train", train).otherwise(lookup(mode, MODE_WEIGHT, 0.0))


def weighted_frequency(core: Column, eve: Column, we: Column) -> Column:
    return 0.6 * core + 0.2 * eve + 0.2 * we


def frequency_score(f: Column, mode: Column, power: float = 2.5) -> Column:
    best, worst = lookup(mode, BEST), lookup(mode, WORST)
    return F.when(f <= worst, 0.0).when(f >= best, 1.0).otherwise(F.round(F.pow((F.ln(f) - F.ln(worst)) / (F.ln(best) - F.ln(worst)), F.lit(power)), 4))


def line_width(score: Column, mode: Column) -> Column:
    low, high = lookup(mode, {k: v[0] for k, v in WIDTH.items()}), lookup(mode, {k: v[1] for k, v in WIDTH.items()})
    return F.round(low + (high - low) * F.coalesce(score, F.lit(0.0)), 2)


def promotion_threshold(spread_km: Column) -> Column:
    return 1 - 0.5 * F.pow(F.lit(0.5), (spread_km - 1.0) / 4.0) - 0.049


def mode_score(mode: Column) -> Column:
    return lookup(mode, {m: (6 - i) / 6 * 100 for i, m in enumerate(MODE_RANK)}, 0.0)


def tier_score(tier: Column) -> Column:
    return lookup(tier, {t: (11 - i) / 11 * 100 for i, t in enumerate(TIERS)}, 0.0)


def urbanness(inner: Column, outer: Column) -> Column:
    return F.when(outer > 600, "city").when(outer > 300, "town").when(inner > 30, "village").otherwise("rural")
