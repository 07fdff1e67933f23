"""Adapter views that give the driver's tables the shape of timetable, map and log tables.

One SQL text serves both engines; tables and other views are named in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

VIEWS = {
    "fx_stops": """select cast(s_suppkey as string) stop_id, s_name stop_name, cast(s_nationkey as string) uic,
 cast(5.93 as double) + cast(s_suppkey*53 % 459 as double)/cast(100 as double) lon, cast(45.8 as double) + cast(s_suppkey*37 % 203 as double)/cast(100 as double) lat from {supplier}""",
    "fx_stations": "select uic, min(stop_name) name, avg(lon) lon, avg(lat) lat, count(*) n_stops from {fx_stops} group by uic",
    "fx_routes": """select distinct o_custkey % 97 route_id, cast((o_custkey % 97) % 40 as string) short_name, (o_custkey % 97) % 7 agency_id,
 case (o_custkey % 97) % 10 when 0 then '100' when 1 then '106' when 2 then '900' when 3 then '401' when 4 then '1000' when 5 then '1300' when 6 then '1400' when 7 then '800' else '700' end route_type from {orders}""",
    "fx_trips": """select o_orderkey trip_id, o_custkey % 97 route_id, o_custkey % 200 service_id, o_orderkey*131 % 61200 + 18000 dep0,
 case when o_orderpriority='1-URGENT' then 600 + (o_custkey % 3)*300 end headway from {orders}""",
    "fx_stop_times": """select l_orderkey trip_id, s.seq, cast(l_suppkey as string) stop_id, t.dep0 + (s.seq-1)*300 + l_partkey % 120 arr,
 t.dep0 + (s.seq-1)*300 + l_partkey % 120 + cast(l_quantity as bigint) % 3 * 60 dep
 from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) as bigint) seq from {lineitem}) s
 join {fx_trips} t on t.trip_id = s.l_orderkey""",
    "fx_calendar_dates": """select distinct o_custkey % 200 service_id, cast(o_orderdate as date) d, case when o_orderstatus='P' then 2 else 1 end exception_type from {orders}""",
    "fx_calendar": """select c_custkey % 200 service_id, min(case when c_custkey % 3 = 0 then 1 else 0 end) mon, max(case when c_custkey % 2 = 0 then 1 else 0 end) tue,
 max(case when c_custkey % 3 = 1 then 1 else 0 end) wed, max(case when c_custkey % 5 = 1 then 1 else 0 end) thu, max(case when c_custkey % 7 = 1 then 1 else 0 end) fri,
 max(case when c_custkey % 11 = 1 then 1 else 0 end) sat, max(case when c_custkey % 4 = 1 then 1 else 0 end) sun,
 cast('1997-01-06' as date) + cast(c_custkey % 200 % 30 as int) start_date, cast('1997-06-30' as date) + cast(c_custkey % 200 % 40 as int) end_date from {customer} group by c_custkey % 200""",
    "fx_samples": """select cast(x as date) d from (values ('1997-02-04'), ('1997-02-20'), ('1997-03-12'), ('1997-07-08'), ('1997-08-14'), ('1997-04-18'), ('1997-05-30'), ('1997-02-16'), ('1997-07-06'), ('1997-05-03')) t(x)""",
    "fx_buildings": """select p_partkey id, cast(5.93 as double) + cast(p_partkey*29 % 4591 as double)/cast(1000 as double) lon, cast(45.8 as double) + cast(p_partkey*41 % 2033 as double)/cast(1000 as double) lat from {part}""",
    "fx_access_log": """select event_id, concat('10.0.', cast(user_id % 7 as string), '.', cast(user_id as string), ' - - [', {fmt},
 ' +0000] "GET /routing/api/v1/plan?fromPlace=ch_Parent', cast(8500000 + user_id % 40 as string), '&toPlace=47.', cast(100 + event_id % 17 as string), ',8.2 HTTP/1.1" 200 12 "-" "',
 case when event_type='error' then 'Googlebot/2.1' else 'Mozilla/5.0' end, '"') line from {events}""",
    "fx_line_stops": """select r.route_id line_id, s.seq, s.stop_id, p.uic, p.stop_name, p.lon, p.lat, s.arr, s.dep
 from (select route_id, trip_id, row_number() over (partition by route_id order by n desc, trip_id) k from (select t.route_id, t.trip_id, count(*) n from {fx_stop_times} x join {fx_trips} t on t.trip_id = x.trip_id group by t.route_id, t.trip_id) c) r
 join {fx_stop_times} s on s.trip_id = r.trip_id join {fx_stops} p on p.stop_id = s.stop_id where r.k = 1""",
    "fx_lines": """select route_id line_id, case when route_id % 10 = 0 then 'IC' when route_id % 10 = 1 then 'R' else '' end || short_name ref, agency_id,
 case route_type when '100' then 'train' when '106' then 'train' when '900' then 'tram' when '401' then 'metro' when '1000' then 'ferry' when '1300' then 'mountain' when '1400' then 'mountain' else 'bus' end mode,
 route_type, cast(route_id * 37 % 101 as double) / cast(100 as double) score, '#' || lpad(cast(route_id * 7919 % 999983 as string), 6, '0') colour from {fx_routes}""",
    "fx_legs": """select l_orderkey itin, o.o_custkey % 300 query_id, s.seq, case when l_returnflag = 'A' then 'WALK' when l_partkey % 3 = 0 then 'RAIL' when l_partkey % 3 = 1 then 'BUS' else 'TRAM' end mode,
 o.o_orderkey % 40 * 600 + (s.seq-1)*1800 + l_partkey % 300 t0, o.o_orderkey % 40 * 600 + (s.seq-1)*1800 + l_partkey % 300 + 60 + cast(l_quantity as bigint) * 18 t1,
 cast(l_suppkey as string) from_stop, cast(l_partkey % 100 + 1 as string) to_stop, l_partkey % 97 route_id, l_orderkey * 7 + s.seq trip_id
 from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) as bigint) seq from {lineitem}) s join {orders} o on o.o_orderkey = s.l_orderkey""",
    "fx_itineraries": """select itin, query_id, case when query_id % 2 = 0 then 'leave' else 'arrive' end mode, min(t0) start_s, max(t1) end_s, max(t1) - min(t0) duration_s,
 sum(case when mode = 'WALK' then t1 - t0 else 0 end) walk_s, sum(case when mode <> 'WALK' then 1 else 0 end) boardings from {fx_legs} group by itin, query_id""",
    "fx_footpaths": """select distinct from_id, to_id, cast((cast(from_id as bigint) * 31 + cast(to_id as bigint) * 17) % 9000 as bigint) duration_s
 from (select stop_id from_id, lead(stop_id) over (partition by trip_id order by seq) to_id from {fx_stop_times}) x where to_id is not null and from_id <> to_id""",
    "fx_transfers": """select o_custkey % 97 from_route, o_custkey % 89 to_route, case when o_orderkey % 3 = 0 then o_orderkey end from_trip, case when o_orderkey % 5 = 0 then o_orderkey + 3 end to_trip from {orders} where o_orderkey % 7 = 0""",
    "fx_dots": """select p_partkey stop_id, case when p_size % 3 = 0 then 'rail' else 'other' end kind, cast(7.4 as double) + cast(p_partkey*7919 % 20011 as double)/cast(100000 as double) lon,
 cast(46.8 as double) + cast(p_partkey*104729 % 30011 as double)/cast(200000 as double) lat, p_partkey % 37 line_a, 100 + p_size % 41 line_b, p_partkey*31 % 97 score, p_size % 10 tier from {part}""",
    "fx_network": """select c_custkey line_id, c_custkey * 7 % 5 + 4 candidate, c_custkey % 5 + 1 stations, c_mktsegment = 'BUILDING' intercity, case when c_custkey % 7 > 0 then (c_custkey - c_custkey % 2) / 2 end upper from {customer}""",
    "fx_places": """select p_partkey place_id, p_name name, p_brand category, p_type kind, cast(5.5 as double) + cast(p_partkey*29 % 560 as double)/cast(100 as double) lon,
 cast(45.5 as double) + cast(p_partkey*41 % 260 as double)/cast(100 as double) lat from {part}""",
}

_FMT = {"spark": "date_format(ts,'dd/MMM/yyyy:HH:mm:ss')", "duckdb": "strftime(ts,'%d/%b/%Y:%H:%M:%S')"}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(x for x in re.findall(r"\{(\w+)\}", sql) if x != "fmt"))


#: Rows of a partition of lineitem where a view numbers an order's rows: more of them, not larger ones, as the table grows.
ORDER_ROWS = 300_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for steps over rows of lineitem; 0 where the table is small and Spark's own number will do."""
    n = view(spark, sf_dir, "lineitem").count() // ORDER_ROWS
    return n + 1 if n > 4 else 0


def dealt(df: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows dealt out by columns in as many partitions as parts() says."""
    return df.repartition(n, *by) if n else df


def _by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, dealt out by order in partitions of one size; small tables as they are.

    It meets orders by sorting: their files may look small enough to be
    broadcast, and then all orders would be in the driver and in each task.
    """
    n, t = parts(spark, sf_dir), view(spark, sf_dir, "lineitem")
    return t.repartition(n, "l_orderkey").hint("merge") if n else t


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_trips for joins by trip; large ones are joined by sorting, as lineitem is with orders."""
    t = view(spark, sf_dir, "fx_trips")
    return t.hint("merge") if parts(spark, sf_dir) else t


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view, or a table of the driver, as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql.replace("{fmt}", _FMT["spark"]), **{x: _by_order(spark, sf_dir) if x == "lineitem" else view(spark, sf_dir, x) for x in _needs(sql)})


def _ordered(names: list[str], out: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in out:
            _ordered(_needs(VIEWS[n]), out)
            out.append(n)
    return out


def sql_views(views: str, sql: str) -> str:
    """SQL with the adapter views that it needs put in front."""
    need = _ordered(views.split(), [])
    if not need:
        return sql
    ctes = ",\n".join(f"{n} as ({re.sub(r'{(?!fmt)(\w+)}', r'\1', VIEWS[n]).replace('{fmt}', _FMT['duckdb'])})" for n in need)
    if re.match(r"\s*with recursive\b", sql):
        return f"with recursive {ctes},\n{re.sub(r'^\s*with recursive', '', sql, count=1)}"
    if re.match(r"\s*with\b", sql):
        return f"with {ctes},\n{re.sub(r'^\s*with', '', sql, count=1)}"
    return f"with {ctes}\n{sql}"
