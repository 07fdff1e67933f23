"""Readers and writers of feeds and features, greedy helpers, and streams against their batch twins."""

import gzip
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from linienwerk.operators import greedy, usage
from linienwerk.operators.graph import connected_components
from linienwerk.sources import features, gtfs
from linienwerk.streaming import jobs


def test_scan_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('﻿stop_id,stop_name,extra,stop_lat,stop_lon\nch:1:sloid:7,"Bern, ""Hof""", x ,46.9,7.4\nParent1,, ,bad,7\n', encoding="utf-8")
    s = gtfs.scan_gtfs(spark, str(tmp_path), "stops").collect()
    assert (s[0].stop_id, s[0].stop_name, s[0].extra, s[0].platform_code) == ("ch:1:sloid:7", 'Bern, "Hof"', "x", None) and s[1].stop_name is None
    assert gtfs.scan_frequencies(spark, str(tmp_path)).count() == 0
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,arrival_time,departure_time,stop_sequence\nt,a,25:10:00,25:11:00,1\nt,b,9:59:00,10:00:00,2\nt,c,,x,3\n")
    assert [(r.seq, r.arr, r.dep) for r in gtfs.scan_stop_times(spark, str(tmp_path)).orderBy("seq").collect()] == [(1, 90600, 90660), (2, 35940, 36000)]
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns,1,2,10\ns,x,2,9\ns,3,4,2\n")
    assert [(r.seq, r.lon) for r in gtfs.scan_shapes(spark, str(tmp_path)).orderBy("seq").collect()] == [(2, 4.0), (10, 2.0)]
    (tmp_path / "p.csv").write_text("sloid;trafficPointElementType;length;compassDirection\na;BOARDING_PLATFORM;12.5;\nb;BOARDING_AREA;1;2\n")
    assert [tuple(r) for r in gtfs.scan_platform_attributes(spark, str(tmp_path / "p.csv")).collect()] == [("a", 12.5, None)]
    gtfs.sink_feed({"stops": gtfs.scan_gtfs(spark, str(tmp_path), "stops")}, str(tmp_path / "out"))
    again = gtfs.scan_gtfs(spark, str(tmp_path / "out"), "stops")
    assert {r.stop_name for r in again.collect()} == {'Bern, "Hof"', None}


def test_features(spark, tmp_path):
    one = {"type": "Feature", "id": "w1", "geometry": {"type": "LineString", "coordinates": [[7, 46, 1], [7, 46, 1], [7.5, 46.5, 2]]}, "properties": {"railway": "tram", "access": "forestry"}}
    (tmp_path / "a.geojsonl").write_text("\u001e" + json.dumps(one) + "\n{broken\n" + json.dumps(one | {"id": "w2", "properties": {"highway": "path"}}) + "\n")
    f = features.scan_geojson_seq(spark, str(tmp_path / "a.geojsonl"))
    assert {r.id for r in f.collect()} == {"w1", "w2"}
    assert [r.id for r in features.osm_tag_filter(f, "street").collect()] == ["w2"] and [r.id for r in features.osm_tag_filter(f, "tram").collect()] == ["w1"]
    assert f.where("id = 'w1'").select(features.patch_foot_access(F.col("props")).alias("p")).first().p["foot"] == "yes"
    assert f.where("id = 'w1'").select(features.keep_tags(F.col("props"), ["railway"]).alias("p")).first().p == {"railway": "tram"}
    (tmp_path / "c.json").write_text(json.dumps({"features": [one, one | {"geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    c = features.scan_feature_collection(spark, str(tmp_path / "c.json")).collect()
    assert len(c) == 1 and [(p.lon, p.lat) for p in c[0].line] == [(7.0, 46.0), (7.5, 46.5)]
    lines = spark.createDataFrame([([[7.0, 46.0], [8.0, 47.0]], 5, "IC")], "lon_lat array<array<double>>, min_zoom int, ref string")
    features.sink_features(lines, str(tmp_path / "f"))
    out = json.loads(spark.read.text(str(tmp_path / "f")).first().value)
    assert out["geometry"]["coordinates"] == [[7.0, 46.0], [8.0, 47.0]] and out["tippecanoe"] == {"minzoom": 5} and out["properties"] == {"ref": "IC"}
    stops = spark.createDataFrame([("a", "train"), ("b", "tram"), ("c", "bus"), ("d", "regional_bus")], "id string, mode string")
    features.sink_by_mode_group(stops, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).where("grp = 'rail'").count() == 1
    features.sink_lookup(stops, "id", str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 4


def test_access_log_files(spark, tmp_path):
    line = '1.2.3.4 - - [20/Aug/2026:06:40:59 +0200] "GET /routing/api/v1/plan?fromPlace=a%20b+c HTTP/1.1" 200 1 "-" "Mozilla"'
    (tmp_path / "access.log").write_text(line + "\nbroken\n" + line.replace("Aug", "Xxx") + "\n")
    (tmp_path / "access.log.2.gz").write_bytes(gzip.compress((line.replace("Mozilla", "curl/8") + "\n").encode()))
    d = usage.daily_access(features.scan_access_log(spark, str(tmp_path / "access.log*"))).collect()
    assert [(str(r.day), r.hits, r.plans, r.unique_ips, r.bots) for r in d] == [("2026-08-20", 1, 1, 1, 1)]
    from linienwerk.functions.text import query_param

    assert spark.range(1).select(query_param(F.lit("GET /x?fromPlace=a%20b+c HTTP/1.1"), "fromPlace").alias("p")).first().p == "a b c"


def test_validate_share(spark):
    good = {"v": 1, "fingerprint": "0123abcd", "from": {"type": "station", "uic": "8500"}, "to": {"type": "point", "lat": 47.0, "lon": 8.0}, "itinerary": {"startTime": "2026-01-01T10:00", "endTime": "2026-01-01T11:00", "legs": [{"mode": "WALK", "startTime": "2026-01-01T10:00", "endTime": "2026-01-01T11:00"}]}, "legColors": ["#00ff00"]}
    rows = [(1, json.dumps(good)), (2, json.dumps(good | {"v": 2})), (3, "{nope"), (4, json.dumps(good | {"legColors": []})), (5, json.dumps(good | {"to": {"type": "point", "lat": 97.0, "lon": 8.0}}))]
    got = {r.id: r.valid for r in features.validate_share(spark.createDataFrame(rows, "id int, json string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_greedy_helpers():
    pts = greedy.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@")
    assert pts == [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    n = 16
    x, y = np.meshgrid(np.arange(n), np.arange(n))
    k = greedy.hilbert_key(x.ravel(), y.ravel(), 4)
    assert sorted(k) == list(range(n * n))
    order = np.argsort(k)
    step = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert (step == 1).all()


def test_components_do_not_depend_on_order(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    want = {a: find(a) for a, b in e if a != b} | {b: find(b) for a, b in e if a != b}
    for order in (e, e[::-1]):
        got = connected_components(spark.createDataFrame(order, "src long, dst long"))
        assert {r.id: r.component for r in got.collect()} == want
    alone = connected_components(spark.createDataFrame([], "src long, dst long"), spark.range(2).select("id")).collect()
    assert {r.id: r.component for r in alone} == {0: 0, 1: 1}


def stream(spark, tmp_path, df, name):
    """The table as a stream of one file."""
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    base = spark.range(400).select((F.col("id") % 7).alias("user"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("ts"), F.col("id").alias("event"))
    batch = usage.throttle(base, "user", "ts", "event", 60, 1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = run(jobs.stream_throttle(stream(spark, tmp_path, base, "e"), "user", "ts", 60, 1, "30 seconds"), tmp_path, "throttled")
    passed = 1_700_000_000 + 399 * 7 - 30
    assert sorted((r.event, r.accepted) for r in live.collect()) == sorted((r.event, r.accepted) for r in batch.collect() if r.ts.timestamp() < passed)
    shares = base.select((F.col("event") % 30).alias("share_id"), "ts")
    once = run(jobs.stream_create_once(stream(spark, tmp_path, shares, "s")), tmp_path, "once")
    assert once.count() == 30
    last = run(jobs.stream_latest_wins(stream(spark, tmp_path, base, "l"), "user", "ts", "event", "20 seconds", "0 seconds"), tmp_path, "latest", "append")
    whole = usage.bursts(base, "user", "ts", "event", "20 seconds")
    assert {(r.user, r.last) for r in last.collect()} <= {(r.user, r.last) for r in whole.collect()} and last.count() > 0
    lines = spark.range(50).select(F.format_string('10.0.0.%d - - [%02d/Aug/2026:06:40:59 +0200] "GET /api/v1/plan HTTP/1.1" 200 1 "-" "M"', F.col("id") % 5, 1 + F.col("id") % 10).alias("line"))
    days = run(jobs.stream_daily_access(stream(spark, tmp_path, lines, "d"), "1 hour"), tmp_path, "days", "append")
    assert all((r.hits, r.plans, r.unique_ips) == (5, 5, 1) for r in days.collect())


def test_queries_have_oracles_and_load():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150
