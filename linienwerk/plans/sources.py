"""Queries whose rows are checked without SQL: greedy and curve operators, and encoded lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linienwerk.operators import greedy
from linienwerk.plans.fixtures import view
from linienwerk.plans.registry import query

C = F.col


def hilbert(df, lon: str = "lon", lat: str = "lat"):
    """``+ key``: the place of a row on a Hilbert curve over the box of the data."""
    x0, x1, y0, y1 = df.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()

    @F.pandas_udf("long")
    def key(x: pd.Series, y: pd.Series) -> pd.Series:
        cell = lambda v, a, b: np.clip((v - a) / ((b - a) or 1) * 65535, 0, 65535).astype(np.int64)
        return pd.Series(greedy.hilbert_key(cell(x.to_numpy(), x0, x1), cell(y.to_numpy(), y0, y1)))

    return df.withColumn("key", key(lon, lat))


#: Places on the curve, one bit of both coordinates at a time.
HILBERT = """b as (select min(lon) x0, max(lon) x1, min(lat) y0, max(lat) y1 from fx_buildings),
h(id, x, y, k, s) as (select id, floor((lon - x0) / (x1 - x0) * 65535)::bigint, floor((lat - y0) / (y1 - y0) * 65535)::bigint, 0::bigint, 32768::bigint from fx_buildings, b
 union all select id, case when ry = 0 then case when rx = 1 then 65535 - y else y end else x end, case when ry = 0 then case when rx = 1 then 65535 - x else x end else y end, k + s * s * xor(3 * rx, ry), s // 2
 from (select *, (x & s > 0)::bigint rx, (y & s > 0)::bigint ry from h) z where s > 0),
curve as (select id, k as "key" from h where s = 0)"""


@query("fx_buildings", f"with recursive {HILBERT} select * from curve")
def hilbert_order(spark, d):
    return hilbert(view(spark, d, "fx_buildings")).select("id", "key")


@query("fx_line_stops", """with recursive s as (select distinct line_id, uic, uic::int * 7 % 11 points from fx_line_stops), p as (select s.*, lon, lat from s join (select line_id, uic, min(lon) lon, min(lat) lat from fx_line_stops group by all) using (line_id, uic)),
o as (select *, row_number() over (partition by line_id order by points desc, uic) k from p),
g(line_id, k, kept, uic) as (select line_id, 0::bigint, []::struct(x double, y double)[], null::varchar from o group by all
 union all select line_id, k, case when hit then kept else list_append(kept, {'x': lon, 'y': lat}) end, case when not hit then uic end
 from (select o.*, kept, len(list_filter(kept, lambda z: sqrt(pow((lon - z.x) * 111.32 * cos(radians(46.8)), 2) + pow((lat - z.y) * 111.32, 2)) < 30)) > 0 hit from g join o on o.line_id = g.line_id and o.k = g.k + 1) z)
select line_id, uic from g where uic is not null""")
def importance_greedy(spark, d):
    s = view(spark, d, "fx_line_stops").groupBy("line_id", "uic").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")).withColumn("points", C("uic").cast("int") * 7 % 11)
    return s.groupBy("line_id").applyInArrow(greedy.accepted_stations(30.0), "line_id long, uic string")


@query("fx_line_stops", "select line_id, count(*) n, round(sum(round(lon, 5)), 4) lon, round(sum(round(lat, 5)), 4) lat from fx_line_stops group by 1")
def decode_polyline(spark, d):
    """Lines encoded as text and read again."""

    @F.pandas_udf("string")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: greedy.encode_polyline([(p["lon"], p["lat"]) for p in x]))

    @F.pandas_udf("array<struct<lon:double,lat:double>>")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"lon": a, "lat": b} for a, b in greedy.decode_polyline(x)])

    g = view(spark, d, "fx_line_stops").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))
    g = g.select("line_id", encode(F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))).alias("text"))
    total = lambda c: F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x[c]), 4).alias(c)
    return g.select("line_id", decode("text").alias("p")).select("line_id", F.size("p").cast("long").alias("n"), total("lon"), total("lat"))


@query("", "select p_partkey k, case when p_size % 4 = 0 then 'yes' when p_size % 3 = 0 then 'no' end foot, p_size % 5 = 1 street from part")
def patch_foot_access(spark, d):
    from linienwerk.sources.features import STREETS, patch_foot_access as patch

    props = F.map_filter(F.create_map(F.lit("access"), F.when(C("p_size") % 4 == 0, "forestry"), F.lit("foot"), F.when((C("p_size") % 4 != 0) & (C("p_size") % 3 == 0), "no"), F.lit("highway"), F.when(C("p_size") % 5 == 1, "path")), lambda k, v: v.isNotNull())
    p = view(spark, d, "part").select(C("p_partkey").alias("k"), patch(props).alias("p"))
    return p.select("k", C("p")["foot"].alias("foot"), F.coalesce(C("p")["highway"].isin(STREETS), F.lit(False)).alias("street"))


@query("", "select p_partkey k, case when p_brand < p_type then '[{\"ref\":\"' || p_brand || '\",\"mode\":\"bus\"},{\"ref\":\"' || p_type || '\",\"mode\":\"bus\"}]' else '[{\"ref\":\"' || p_type || '\",\"mode\":\"bus\"},{\"ref\":\"' || p_brand || '\",\"mode\":\"bus\"}]' end j from part")
def merge_lines_json(spark, d):
    from linienwerk.sources.features import merge_lines_json as merge

    one = lambda c: F.concat(F.lit('[{"ref":"'), C(c), F.lit('","mode":"bus"}]'))
    return view(spark, d, "part").select(C("p_partkey").alias("k"), merge(one("p_brand"), one("p_type")).alias("j"))
