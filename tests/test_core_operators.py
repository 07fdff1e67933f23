"""Nulls, ties, repeated rows and empty tables of operators on feeds, stations, lines and places."""

import pytest
from pyspark.sql import functions as F

from linienwerk.operators import feed, lines, network, piers, places, service, stops, trips


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_keeps_what_exists(spark):
    old = spark.createDataFrame([(1, "old")], "id long, v string")
    new = spark.createDataFrame([(1, "new"), (2, "b"), (2, "a"), (None, "n")], "id long, v string")
    assert rows(feed.upsert_shares(old, new, "id", F.col("v"))) == [(1, "old"), (2, "a"), (None, "n")]
    assert rows(feed.upsert_shares(old.limit(0), new.limit(0), "id", F.col("v"))) == []


def test_resume(spark):
    done = spark.createDataFrame([("a",), ("a",)], "from_id string")
    out = spark.createDataFrame([("a", 1), ("b", 2)], "from_id string, n long")
    kept, todo = feed.resume_matrix(done, out, spark.createDataFrame([("a",), ("b",), ("c",)], "from_id string"))
    assert rows(kept) == [("a", 1)] and rows(todo) == [("b",), ("c",)]


def test_snap_platforms(spark):
    s = spark.createDataFrame([("x", "P", 7.0, 47.0), ("y", None, 7.0, 47.0), ("z", "P", 7.0, 47.0), ("w", "P", 7.0, 47.0)], "stop_id string, parent string, lon double, lat double")
    i = spark.createDataFrame([("x", "1", "3", "AB"), ("y", "1", "3", None), ("z", "", "3", None), ("w", "1", None, "")], "stop_id string, uic string, track string, sector string")
    p = spark.createDataFrame([("1", "3", 7.0001, 47.0), ("1", "AB", 7.001, 47.0), ("1", "AB", 7.5, 47.0)], "uic string, ref string, lon double, lat double")
    a = spark.createDataFrame([("P", 7.0, 47.0)], "parent string, lon double, lat double")
    # the sector's platform is farther than the track's, but comes first
    assert rows(feed.snap_platforms(s, i, p, a)) == [("w", 7.0, 47.0, False), ("x", 7.001, 47.0, True), ("y", 7.0001, 47.0, True), ("z", 7.0, 47.0, False)]


def test_line_geometry(spark):
    v = spark.createDataFrame([(1, "700", "s"), (2, "1300", None), (3, "700", "t"), (4, "1300", None)], "variant long, route_type string, shape_id string")
    shapes = spark.createDataFrame([("s", 2, 8.0, 47.0), ("s", 1, 7.0, 47.0)], "shape_id string, seq int, lon double, lat double")
    st = spark.createDataFrame([(2, 1, 7.0, 46.0), (2, 2, 7.0, 46.0), (2, 3, None, None), (2, 4, 8.0, 46.0), (4, 1, 7.0, 46.0)], "variant long, seq int, lon double, lat double")
    got = {r.variant: (r.source, [p.lon for p in r.vertices], r.reason) for r in feed.line_geometry(v, shapes, st).collect()}
    assert got == {1: ("shape", [7.0, 8.0], None), 2: ("straight_line", [7.0, 8.0], None), 3: (None, [], "unrouted"), 4: ("straight_line", [7.0], "too_short")}


def test_terminus_pairing(spark):
    end = "struct<stop_id:string,lon:double,lat:double>"
    e = spark.createDataFrame([(1, False, ("a", 7.0, 47.0), ("b", 8.0, 47.0)), (2, False, ("b", 8.0, 47.0), ("a", 7.00005, 47.0)), (3, True, ("a", 7.0, 47.0), ("b", 8.0, 47.0)), (4, False, ("c", 7.0, 47.0), ("c", 7.0, 47.0)), (5, False, (None, 7.0, 47.0), (None, 7.0, 47.0))], f"line_id long, exempt boolean, departure {end}, arrival {end}")
    assert rows(stops.terminus_pairing(e)) == [(1, True), (2, True), (3, False), (4, False), (5, False)]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_sharing_components(spark, least):
    m = [("p", 1, "a"), ("p", 1, "b"), ("p", 1, "c"), ("p", 2, "a"), ("p", 2, "b"), ("p", 2, "b"), ("p", 3, "c"), ("q", 4, "a"), ("q", 4, "b"), ("p", 5, "z")]
    got = {r.id: r.component for r in lines.sharing_components(spark.createDataFrame(m, "part string, pattern_id long, station string"), "part", least).collect()}
    assert got == {1: 1, 2: 1 if least < 3 else 2, 3: 1 if least == 1 else 3, 4: 4, 5: 5}


def test_match_ways_longer_than_the_radius(spark):
    p = spark.createDataFrame([(1, 7.9, 46.8, 0.0)], "point_id long, lon double, lat double, bearing double")
    w = spark.createDataFrame([("long", 7.0, 46.8001, 8.0, 46.8001), ("off", 7.0, 46.9, 8.0, 46.9), ("point", 7.9, 46.8, 7.9, 46.8)], "way_id string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.way_id, round(r.dist_m)) for r in network.match_ways(p, w, 200.0, 0.5).collect()] == [("long", 11)]


def test_share_filter_spares_the_exempt(spark):
    r = spark.createDataFrame([("g", 1, 95.0, False), ("g", 2, 3.0, False), ("g", 3, 2.0, True), ("h", 4, 0.0, False)], "sg string, tg long, w double, m boolean")
    assert {x.tg: x.kept for x in service.share_filter(r, "w", ["sg"], F.col("m")).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_percentiles(spark):
    s = spark.createDataFrame([(float(k % 7),) for k in range(70)], "score double")
    want = sorted(k % 7 for k in range(70) if k % 7)
    got = {r.p: r.value for r in stops.score_percentiles(s, [0.0, 0.5, 0.99, 1.0]).collect()}
    assert got == {p: want[min(int(p * len(want)), len(want) - 1)] for p in (0.0, 0.5, 0.99, 1.0)}
    assert stops.score_percentiles(s.limit(0), [0.5]).count() == 0


def test_leg_colour(spark):
    legs = spark.createDataFrame([(1, 1, "BUS", "r1"), (1, 2, "BUS", "ch_r2"), (1, 3, "BUS", None), (1, 4, "WALK", "x")], "itin long, seq int, mode string, route_key string")
    c = spark.createDataFrame([("r1", "#1"), ("r2", "#2")], "route_key string, colour string")
    assert rows(trips.leg_colour(legs, c, {"BUS": "#b"}, "#n")) == [(1, 1, "#1"), (1, 2, "#2"), (1, 3, "#b"), (1, 4, "#n")]


def test_place_labels(spark):
    schema = "name string, street string, housenumber string, city string, county string, state string, osm_key string"
    f = [("Bar", "Gasse", "1", "Bern", None, None, "amenity"), ("Bar", "Gasse", "1", "", "Kt", None, "building"), ("Weg", None, None, None, None, None, "highway"), ("Bern", "", None, "Bern", None, None, "place"), (None, None, "3", "X", None, None, "place")]
    got = [tuple(r.p) if r.p else None for r in spark.createDataFrame(f, schema).select(places.place_label().alias("p")).collect()]
    assert got == [("Bar, Bern", "poi"), ("Gasse 1, Kt", "address"), ("Weg", "address"), ("Bern", "place"), None]
    q = spark.createDataFrame([(1, 7.0, 47.0), (2, 7.0, 47.0), (3, 7.0, 47.0)], "q_id long, lon double, lat double")
    at = [(1, 1, 7.1, 47.0, *f[1], None, None, None, None), (1, 2, 7.001, 47.0, *f[2], 6.0, 46.0, 8.0, 48.0), (2, 1, 7.1, 47.0, *f[0], None, None, None, None)]
    t = spark.createDataFrame(at, f"q_id long, ord int, lon double, lat double, {schema}, w double, s double, e double, n double")
    assert rows(places.reverse_label(t, q)) == [(1, "Weg"), (2, "Nähe Bar, Bern"), (3, None)]


def test_directions(spark):
    ways = {1: "abcd", 2: "dcba", 3: "abc", 4: "be"}
    v = spark.createDataFrame([("1", "bus", k, i, u) for k, w in ways.items() for i, u in enumerate(w)], "ref string, mode string, variant long, seq int, uic string")
    n = spark.createDataFrame([(u, u.upper()) for u in "abcde"], "uic string, name string")
    got = {r.uic: r.text for r in places.directions_from_station(v, n).collect()}
    # from b: to D (C lies on the way), to A, and to E; b is where the fourth begins
    assert got["b"] == "D ↔ A ↔ E ↔ B" and got["a"] == "D ↔ A" and got["c"] == "D ↔ A ↔ C" and "e" not in got
    assert places.directions_from_station(v.limit(0), n).count() == 0


def test_pier_status(spark):
    p = spark.createDataFrame([("a", 7.0, 47.0), ("a", 7.0, 47.0), ("n", None, 1.0), ("e", 8.0, 47.0), ("t", 9.0, 47.0)], "pier string, lon double, lat double")
    # both lines of a end at one vertex; those of t are 76 m apart
    v = [("a", 1, 1, 7.0005, 47.0), ("a", 1, 2, 7.1, 47.0), ("a", 2, 1, 7.1, 47.0), ("a", 2, 2, 7.0005, 47.0), ("a", 2, 3, None, None), ("t", 1, 1, 9.0005, 47.0), ("t", 2, 1, 8.9995, 47.0), ("t", 1, 1, 9.0005, 47.0)]
    v = spark.createDataFrame(v, "pier string, line_id long, seq int, lon double, lat double")
    for others, status in ([(7.01, 47.0)], "suppressed"), ([(6.99, 47.0)], "split"), ([(6.0, 47.0), (None, 1.0)], "split"), ([], "split"):
        o = spark.createDataFrame(others, "lon double, lat double")
        assert rows(piers.pier_status(p, v, o)) == [("a", status, 7.0005, 47.0), ("e", "collapsed", 8.0, 47.0), ("t", "diverged", 9.0005, 47.0)]
    assert rows(piers.pier_status(p.limit(0), v.limit(0), o)) == []
