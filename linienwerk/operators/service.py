"""Service calendars, departures by window, frequencies and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: Hours of a window, by name (fixed values): core and evening on weekdays, and weekends.
HOURS = {"core": 12.0, "eve": 4.0, "we": 13.0}
SEASONS = ("annual", "winter", "summer")


def _runs_on(d: Column) -> Column:
    return F.get(F.array(*[F.col(x) for x in DAYS]), F.weekday(d)) == 1


def _exceptions(base: DataFrame, dates: DataFrame) -> DataFrame:
    """Base days and additions, without removals: a removal wins over an addition of the same day."""
    added = dates.where("exception_type = 1").select("service_id", "d")
    removed = dates.where("exception_type = 2").select("service_id", "d")
    return base.select("service_id", "d").union(added).distinct().join(removed, ["service_id", "d"], "left_anti")


def expand_calendar(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """``→ (service_id, d)``: every day of a service's weekday pattern, plus additions, minus removals."""
    days = calendar.where("start_date <= end_date").withColumn("d", F.explode(F.sequence("start_date", "end_date")))
    return _exceptions(days.where(_runs_on(F.col("d"))), dates)


def service_on_sample_dates(calendar: DataFrame, samples: DataFrame) -> DataFrame:
    """Services of the calendar that run on the sample dates; the samples are a short fixed list."""
    j = calendar.join(F.broadcast(samples.select("d")), F.col("d").between(F.col("start_date"), F.col("end_date")))
    return j.where(_runs_on(F.col("d"))).select("service_id", "d")


def expand_calendar_sampled(calendar: DataFrame, dates: DataFrame, samples: DataFrame) -> DataFrame:
    """As ``expand_calendar``, the pattern on sample dates alone; additions keep all their days."""
    return _exceptions(service_on_sample_dates(calendar, samples), dates)


def sample_hits(service_dates: DataFrame, samples: DataFrame) -> DataFrame:
    """``→ (service_id, season, wd, we)``: sample days on which a service runs, by season; days of no season count for the year alone."""
    j = service_dates.join(F.broadcast(samples.select("d")), "d")
    m = F.month("d")
    seasons = F.array_compact(F.array(F.lit("annual"), F.when(m <= 3, "winter").when(m.between(6, 8), "summer")))
    return j.withColumn("season", F.explode(seasons)).groupBy("service_id", "season").agg(F.count_if(F.weekday("d") < 5).alias("wd"), F.count_if(F.weekday("d") >= 5).alias("we"))


def trip_windows(trips: DataFrame) -> DataFrame:
    """``(trip_id, dep0, headway?) → (trip_id, core, eve, we)``: departures in 07–19, 19–23 of weekdays and 07–20 of weekends.

    A trip with a headway runs every so often in the two hours from ``dep0``:
    each window takes as many as fit in its share. Without one it departs once;
    the evening is tested only if the core isn't hit, the weekend always.
    """
    h = F.col("headway")
    fits = lambda a, b: F.floor(F.greatest(F.lit(0), F.least(F.col("dep0") + 7200, F.lit(b * 3600)) - F.greatest(F.col("dep0"), F.lit(a * 3600))) / h)
    once = lambda a, b: F.col("dep0").between(a * 3600, b * 3600 - 1).cast("long")
    pick = lambda a, b: F.when(h.isNull(), once(a, b)).when(h > 0, fits(a, b)).otherwise(0).cast("long")
    return trips.select("trip_id", pick(7, 19).alias("core"), pick(19, 23).alias("eve"), pick(7, 20).alias("we"))


def group_frequency(trips: DataFrame, windows: DataFrame, hits: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """``→ (by…, season, f_core, f_eve, f_we)``: departures an hour, over the sample days of each season."""
    m = F.month("d")
    s = samples.withColumn("season", F.explode(F.array_compact(F.array(F.lit("annual"), F.when(m <= 3, "winter").when(m.between(6, 8), "summer")))))
    n = s.groupBy("season").agg(F.greatest(F.count_if(F.weekday("d") < 5), F.lit(1)).alias("n_wd"), F.greatest(F.count_if(F.weekday("d") >= 5), F.lit(1)).alias("n_we"))
    j = trips.select("trip_id", "service_id", *by).join(windows.select("trip_id", *[F.col(c).alias(f"_{c}") for c in HOURS]), "trip_id").join(hits, "service_id").join(F.broadcast(n), "season")
    rate = lambda c, k, d: F.sum(F.col(f"_{c}") * F.col(k)) / (F.first(d) * HOURS[c])
    return j.groupBy(*by, "season").agg(rate("core", "wd", "n_wd").alias("f_core"), rate("eve", "wd", "n_wd").alias("f_eve"), rate("we", "we", "n_we").alias("f_we"))


def active_days(variant_services: DataFrame, service_dates: DataFrame, by: list[str]) -> DataFrame:
    """Days on which any service of a variant runs: distinct services first, then distinct days."""
    return variant_services.select(*by, "service_id").distinct().join(service_dates, "service_id").groupBy(*by).agg(F.count_distinct("d").alias("n"))


def variant_runs(trips: DataFrame, service_dates: DataFrame, by: list[str]) -> DataFrame:
    """Departures over the whole calendar: a trip's departures a day (a headway's in two hours, 1 at least) times its days."""
    days = service_dates.groupBy("service_id").agg(F.count("*").alias("days"))
    per = F.when(F.col("headway") > 0, F.greatest(F.floor(F.lit(7200) / F.col("headway")), F.lit(1))).otherwise(1)
    return trips.join(days, "service_id").groupBy(*by).agg(F.sum(per * F.col("days")).cast("long").alias("runs"))


def date_stats(variant_dates: DataFrame, by: list[str]) -> DataFrame:
    return variant_dates.groupBy(*by).agg(F.min("d").alias("first"), F.max("d").alias("last"), *[F.count_if(F.weekday("d") == k).alias(x) for k, x in enumerate(DAYS)])


def min_active_days_gate(variants: DataFrame, least: int = 150, mountain: int = 90, rescue: int = 90) -> DataFrame:
    """``(…, bucket, exempt, n) → + verdict``: kept, rescued (buses near the limit) or dropped."""
    limit = F.when(F.col("bucket") == "mountain", mountain).otherwise(least)
    return variants.withColumn("verdict", F.when(F.col("exempt") | (F.col("n") >= limit), "kept").when((F.col("bucket") == "bus") & (F.col("n") >= rescue), "rescued").otherwise("dropped"))


def share_filter(rows: DataFrame, weight: str, by: list[str], exempt: Column | None = None) -> DataFrame:
    """``+ kept, pct``: rows with 10 % of their group's weight; where none has, 5 %; where none has that, all. Limits are 1 at least; a row alone stays, and so do exempt ones."""
    w = Window.partitionBy(*by)
    total = F.sum(weight).over(w)
    r = rows.withColumn("_t", total).withColumn("_n", F.count("*").over(w))
    r = r.withColumn("_a", F.col(weight) >= F.greatest(F.lit(1.0), F.col("_t") * 0.10)).withColumn("_b", F.col(weight) >= F.greatest(F.lit(1.0), F.col("_t") * 0.05))
    r = r.withColumn("_any_a", F.bool_or("_a").over(w)).withColumn("_any_b", F.bool_or("_b").over(w))
    kept = F.when((F.col("_n") == 1) | (F.lit(False) if exempt is None else exempt), True).when(F.col("_any_a"), F.col("_a")).when(F.col("_any_b"), F.col("_b")).otherwise(True)
    return r.withColumn("kept", kept).withColumn("pct", F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(0.0)).drop("_t", "_n", "_a", "_b", "_any_a", "_any_b")


def seasonal_variant_filter(variants: DataFrame, by: list[str], seasons: tuple[str, ...] = SEASONS) -> DataFrame:
    """``(by…, variant, annual, winter, summer) → + kept, season``: kept with 10 % of its group in any season, the first such is named."""
    w = Window.partitionBy(*by)
    first = F.coalesce(*[F.when(F.col(s) >= F.greatest(F.lit(1.0), F.sum(s).over(w) * 0.10), F.lit(s)) for s in seasons])
    return variants.withColumn("season", first).withColumn("kept", F.col("season").isNotNull())


def frequency_gate(freq: DataFrame, groups: DataFrame, worst: Column) -> DataFrame:
    """``freq (tg, season, f_*), groups (tg, mode, rescued) → (tg, passed, season, f)``: weighted frequency above the mode's worst in the year, or, for rescued groups, in any season; that season's value counts."""
    f = freq.select("tg", "season", (0.6 * F.col("f_core") + 0.2 * F.col("f_eve") + 0.2 * F.col("f_we")).alias("f"))
    p = f.groupBy("tg").agg(*[F.max(F.when(F.col("season") == s, F.col("f"))).alias(s) for s in SEASONS])
    j = gated(groups.join(p, "tg", "left"), worst)
    return j.select("tg", F.col("season").isNotNull().alias("passed"), "season", "f")


def gated(groups: DataFrame, worst: Column) -> DataFrame:
    """Groups with their frequencies ``annual``, ``winter``, ``summer``, and ``rescued`` → and ``season``, whose value passes (null: none does), and ``f``, that value or the year's."""
    j = groups.withColumn("_w", worst)
    ok = {s: F.coalesce(F.round(s, 9) > F.col("_w"), F.lit(False)) for s in SEASONS}
    season = F.when(ok["annual"], "annual").when(F.col("rescued") & ok["winter"], "winter").when(F.col("rescued") & ok["summer"], "summer")
    j = j.withColumn("season", season).drop("_w")
    value = F.when(F.col("season") == "winter", F.col("winter")).when(F.col("season") == "summer", F.col("summer")).otherwise(F.col("annual"))
    return j.withColumn("f", value)
