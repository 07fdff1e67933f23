"""Access logs: parsed lines, daily figures, totals, most requested pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linienwerk.functions.text import place_token, place_url_token, query_param
from linienwerk.functions.times import log_day

#: Parts of user agents that tell tools from people (fixed values).
BOTS = "bot|crawl|spider|slurp|preview|scan|monitor|probe|python|curl|wget|headless|go-http|okhttp|zgrab|censys"

def is_bot(agent: Column) -> Column:
    return agent.rlike(f"(?i){BOTS}")


def parse_log(lines: DataFrame) -> DataFrame:
    """``(line, …) → (…, ip, day, request, status, bot, plan)``; malformed lines and unknown days go.

    A line of the combined format is read by its quotes: what stands before the
    request (address, two names, bracketed time), the request, status and
    bytes, the referrer, the agent.
    """
    p = lines.withColumn("_q", F.split("line", '"'))
    head, after = F.col("_q")[0], F.split(F.trim(F.get("_q", F.lit(2))), " ")
    p = p.withColumn("_time", F.substring_index(F.substring_index(head, "[", -1), "]", 1)).withColumn("status", F.try_to_number(F.get(after, F.lit(0)), F.lit("999")).cast("int"))
    p = p.where((F.size("_q") >= 7) & (F.size(F.split(head, " ")) >= 5) & head.contains("[") & head.contains("]") & (F.length(F.get(after, F.lit(0))) == 3) & F.col("status").isNotNull())
    p = p.select(*[c for c in lines.columns if c != "line"], F.substring_index(head, " ", 1).alias("ip"), log_day(F.col("_time")).alias("day"), F.col("_q")[1].alias("request"), "status", is_bot(F.col("_q")[5]).alias("bot"))
    return p.where("day is not null").withColumn("plan", F.col("request").contains("/api/v1/plan") & F.col("request").startswith("GET "))


def _measures() -> list[Column]:
    man = ~F.col("bot")
    return [F.count_if(man).alias("hits"), F.count_if(man & F.col("plan")).alias("plans"), F.count_distinct(F.when(man, F.col("ip"))).alias("unique_ips"), F.count_if(F.col("bot")).alias("bots")]


def daily_access(lines: DataFrame) -> DataFrame:
    """``line → (day, hits, plans, unique_ips, bots)``; a day with bots alone has its row."""
    return parse_log(lines).groupBy("day").agg(*_measures())


def access_totals(lines: DataFrame) -> DataFrame:
    """The measures by day and, with a null day, over all: unique addresses don't add up over days."""
    return parse_log(lines).rollup("day").agg(*_measures(), F.grouping("day").cast("int").alias("total"))


def top_route_pairs(lines: DataFrame, order: str, k: int = 30) -> DataFrame:
    """``line, order → (origin, target, n, link_from, link_to)``: the most requested pairs; links of the first request by ``order``."""
    p = parse_log(lines).where("not bot and plan").select(order, query_param(F.col("request"), "fromPlace").alias("f"), query_param(F.col("request"), "toPlace").alias("t")).where("f is not null and t is not null")
    g = p.groupBy(place_token(F.col("f")).alias("origin"), place_token(F.col("t")).alias("target")).agg(F.count("*").alias("n"), F.min_by(F.struct(place_url_token(F.col("f")).alias("f"), place_url_token(F.col("t")).alias("t")), order).alias("link"))
    return g.orderBy(F.desc("n"), "origin", "target").limit(k).select("origin", "target", "n", F.col("link.f").alias("link_from"), F.col("link.t").alias("link_to"))


def throttle(events: DataFrame, key: str, ts: str, order: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """Events with ``accepted``: at most ``most`` accepted ones of a key in any trailing span; rejected ones leave no trace.

    Whether an event passes depends on those that did before, so a key's
    events are read in order, one key after another, by ``throttle_rows``.
    """
    from linienwerk.operators.greedy import throttle_rows

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean"
    return events.repartition(F.col(key)).sortWithinPartitions(key, ts, order).mapInArrow(throttle_rows(key, ts, seconds, most), schema)


def bursts(queries: DataFrame, key: str, ts: str, order: str, gap: str = "30 minutes") -> DataFrame:
    """The last query of each burst: ``(key, n, last)``; a burst ends after a pause of ``gap``."""
    w = queries.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.max_by(order, F.struct(ts, order)).alias("last"))
    return w.select(key, F.col("session_window.start").alias("start"), "n", "last")
