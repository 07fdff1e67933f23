"""Steps whose work, memory or rounds once grew faster than their tables."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from linienwerk.operators import feed, graph, lines, network, places, rounds, spatial, stops, trips
from linienwerk.plans import fixtures, lines as plans_lines, network as plans_network
from linienwerk.shared import Stash
from linienwerk.streaming import jobs


def test_dense_stops_cluster_in_few_rounds(spark, monkeypatch):
    """Once a round settled only stops without a smaller one near them, so rounds grew with the density."""
    r = random.Random(7)
    rows = [(k, "rail", 8 + r.random() * 0.02, 46.8 + r.random() * 0.008, [r.randrange(12), 50 + r.randrange(9)]) for k in r.sample(range(9000), 1500)]
    took, seeds, kx = {}, [], 111320 * math.cos(math.radians(46.8))
    for k, _, x, y, lines in sorted(rows):
        for s in seeds:
            if math.hypot((x - s[1]) * kx, (y - s[2]) * 111320) < 40 and not s[3] & set(lines):
                s[3].update(lines)
                took[k] = s[0]
                break
        else:
            seeds.append((k, x, y, set(lines)))
            took[k] = k
    puts, put = [], Stash.put
    monkeypatch.setattr(Stash, "put", lambda self, df: puts.append(1) or put(self, df))
    monkeypatch.setattr(rounds, "HALO_R", 0.5)
    df = spark.createDataFrame(rows, "stop_id long, kind string, lon double, lat double, lines array<long>").repartition(3)
    got = {x.stop_id: x.cluster for x in rounds.cluster_stops_greedy(df, {"rail": 40.0}).collect()}
    assert got == took and 50 < len(set(took.values())) < 1200
    assert len(puts) < 15


def test_search_scores_equal_names_once(spark, tmp_path):
    """Once every query met every station that shares a letter pair; 3,000 times 20,000 rows of one name made 60 million."""
    st = spark.range(20000).select(F.col("id").alias("uic"), F.when(F.col("id") % 2 == 0, "Bern Wankdorf").otherwise("Bern").alias("name"), F.lit("train").alias("mode"), F.lit("normal_stop").alias("tier"))
    q = spark.range(3000).select(F.col("id").alias("q_id"), F.lit("bern").alias("text"))
    out = stops.search_stations(q, st, 3).cache()
    assert out.count() == 9000 and {tuple(r)[1:] for r in out.select("q_id", "uic", "rank").collect()} == {(1, 1), (3, 2), (5, 3)}
    assert most_rows(stops.search_stations(q, st, 3)) <= 20000


def most_rows(df):
    """Rows that the plan's largest join gives out."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    most, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
    return most


def test_resplit_names_may_share_their_digits(spark):
    """Once two components whose names agree in eight digits were taken for components of the same stations."""
    import hashlib
    import itertools

    seen, text = {}, None
    for k in itertools.count():
        h = hashlib.sha256(f"s{k:07d}".encode()).hexdigest()[:8]
        if h in seen:
            text = (f"s{seen[h]:07d}", f"s{k:07d}")
            break
        seen[h] = k
    v = spark.createDataFrame([(1, 1, text[0], False), (1, 2, text[1], False)], "tg long, variant_id long, station string, rescued boolean")
    f = spark.createDataFrame([(k, "annual", 100, 100, 100) for k in (1, 2)], "variant_id long, season string, f_core int, f_eve int, f_we int")
    g = spark.createDataFrame([(1, "bus", False, False)], "tg long, mode string, rescued boolean, exempt boolean")
    got = network.resplit_groups(v, f, g, F.lit(1.0))[1].collect()
    assert len(got) == 2 and {x.group for x in got} == {h} and all(x.split and x.passed for x in got)


def test_resplit_reads_variants_once(spark, monkeypatch):
    """Once variants and their frequency were made anew for the components, names, sums and groups; all components were grouped, also those of one variant."""
    import hashlib

    r = random.Random(11)
    sets = {k: (k % 4, sorted({f"s{r.randrange(9 + 30 * (k % 4))}" for _ in range(r.randrange(1, 6))})) for k in range(120)}
    for k, (t, l) in list(sets.items()):
        if any(sets[x] == (t, l) for x in sets if x < k):
            del sets[k]
    comp, todo = {}, sorted(sets)
    while todo:
        near = [todo.pop(0)]
        for a in near:
            comp[a] = near[0]
            near += [b for b in todo if sets[b][0] == sets[a][0] and len({*sets[a][1]} & {*sets[b][1]}) >= 2]
            todo = [b for b in todo if b not in near]
    want = set()
    for c in set(comp.values()):
        own, tg = [k for k in comp if comp[k] == c], sets[c][0]
        split = len({comp[k] for k in comp if sets[k][0] == tg}) > 1
        name = hashlib.sha256(",".join(sorted({x for k in own for x in sets[k][1]})).encode()).hexdigest()[:8]
        f = {s: round(sum(0.6 * (k % 5) + 0.2 * n + 0.2 * (k % 2) for k in own), 6) for n, s in enumerate(("annual", "winter", "summer"))}
        won = next((s for s in f if f[s] > 4 and (s == "annual" or tg % 2 == 0 and any(k % 3 == 0 for k in own))), None)
        season = ("annual" if tg == 3 else won) if split else None
        want.add((tg, name if split else str(tg), split, not split or tg == 3 or won is not None, season, f[won or "annual"] if split else None))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(x):
        seen.add(1)
        return x

    rows = [(t, k, x, k % 3 == 0) for k, (t, l) in sets.items() for x in l]
    v = spark.createDataFrame(rows, "tg long, variant_id long, station string, rescued boolean")
    f = spark.createDataFrame([(k, s, k % 5, n, k % 2) for k in sets for n, s in enumerate(("annual", "winter", "summer"))], "variant_id long, season string, f_core int, f_eve int, f_we int")
    g = spark.createDataFrame([(t, "bus", t % 2 == 0, t == 3) for t in range(4)], "tg long, mode string, rescued boolean, exempt boolean")
    told = lambda df: [(x.tg, x.group, x.split, x.passed, x.season, None if x.f is None else round(x.f, 6)) for x in df.collect()]
    got = told(network.resplit_groups(v.withColumn("station", tick("station")), f.withColumn("season", tick("season")), g, F.lit(4.0))[1])
    assert set(got) == want and len(got) == len(want) == len(set(comp.values())) and len({w[4] for w in want}) >= 3
    assert seen.value == len(rows) + 3 * len(sets)
    monkeypatch.setattr(network, "VARIANT_ROWS", 10)
    arrays = v.groupBy("tg", "variant_id", "rescued").agg(F.collect_list("station").alias("stations"))
    of_variant, groups = network.resplit_groups(arrays, f, g, F.lit(4.0))
    assert sorted(told(groups), key=str) == sorted(got, key=str)
    named = {x.variant_id: x.group for x in of_variant.collect()}
    assert set(named) == set(sets) and all(named[k] == named[c] for k, c in comp.items())
    # two variants of one station each hang together with nothing
    with pytest.raises(Exception, match="two components of a group have the same stations"):
        network.resplit_groups(arrays.unionByName(spark.createDataFrame([(0, k, False, ["x"]) for k in (900, 901)], arrays.schema)), f, g, F.lit(4.0))[1].collect()


def test_written_tables_leave_no_shuffle_files(spark):
    """Once shuffle files of written tables stayed until the driver collected its garbage, so that a query's steps added up on disk."""
    import glob

    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/blockmgr-*/*/shuffle_*"))
    before = files()
    sets = spark.range(2000).select((F.col("id") % 3).alias("part"), F.col("id").alias("pattern_id"), F.expr("sort_array(array(string(id % 700), string(id % 701 + 1000), string(id % 13 + 2000)))").alias("stations"))
    many = spark.range(5000).groupBy((F.col("id") % 1999).alias("k")).count()
    written = Stash(spark, "tidy", tidy=True).put(many)
    assert not files() - before and written.count() == 1999
    lines.pair_components(sets, "part")
    assert sum(os.path.getsize(x) for x in files() - before) < 20_000


def test_platforms_at_one_place_are_one(spark):
    """Once every stop met every platform of its station and code: 2,000 times 3,000 here."""
    k = spark.range(2000)
    s = k.select(F.col("id").alias("stop_id"), F.lit("1").alias("parent"), F.lit(7.0).alias("lon"), F.lit(46.0).alias("lat"))
    i = k.select(F.col("id").alias("stop_id"), F.lit("1").alias("uic"), F.lit("2").alias("track"), F.lit(None).cast("string").alias("sector"))
    p = spark.range(3000).select(F.lit("1").alias("uic"), F.lit("2").alias("ref"), (7.0 + F.col("id") % 3 * 0.001).alias("lon"), F.lit(46.0).alias("lat"))
    a = spark.createDataFrame([("1", 7.0011, 46.0)], "parent string, lon double, lat double")
    out = feed.snap_platforms(s, i, p, a)
    assert most_rows(out) <= 2000
    assert {(x.lon, x.snapped) for x in out.collect()} == {(7.001, True)}


def test_nearest_meets_a_few_targets(spark):
    """Once every point met all targets within the radius: 200 times 5,000 here."""
    r = random.Random(3)
    t = [(k, 8 + r.random() * 0.1, 46.8 + r.random() * 0.1) for k in range(5000)]
    p = [(k, 8 + r.random() * 0.1, 46.8 + r.random() * 0.1) for k in range(200)] + [(900, 8.2, 46.85), (901, 9.9, 46.8)]
    far = lambda a, b: math.hypot((a[1] - b[1]) * 111320 * math.cos(math.radians(46.8)), (a[2] - b[2]) * 111320)
    want = {(a[0], b, k + 1) for a in p for k, (m, b) in enumerate(sorted((far(a, b), b[0]) for b in t)[:3]) if m <= 15000}
    out = spatial.nearest(spark.createDataFrame(p, "id long, lon double, lat double"), spark.createDataFrame(t, "t long, lon double, lat double"), "id", "t", 15000.0, 3)
    assert {(x.id, x.t, x.rank) for x in out.collect()} == want and len(want) == 603
    assert most_rows(out) < 20000


def test_journeys_of_equal_times_meet_once(spark):
    """Once all journeys of a query were paired: 4,000 times 4,000 here. The answer is that of all pairs."""
    r = random.Random(9)
    rows = []
    for k in range(160):
        s, d = r.randrange(0, 4000), r.randrange(300, 2500)
        rows.append((k, k % 4, "arrive" if k % 4 % 2 else "leave", s, s + d, d, r.randrange(0, min(d, 2400)), r.randrange(0, 6)))
    plain = spark.createDataFrame(rows, "itin long, query_id long, mode string, start_s long, end_s long, duration_s long, walk_s long, boardings long")

    def value(x):
        t = x[6] / 60
        return 600 * x[7] + 2 * min(x[6], 1800) + 0.5 * max(x[6] - 1800, 0), x[5] * (1 + 0.1 * (t * t / (t * t + 900) + 1 - 0.7 ** x[7]))

    beats = lambda b, a: b[3] >= a[3] - 60 and b[4] <= a[4] + 60 and (b[3] > a[3] + 60 or b[4] < a[4] - 60)

    def drops(b, a):
        gaps = abs(a[3] - b[3]), abs(a[4] - b[4])
        (sa, ea), (sb, eb) = value(a), value(b)
        if beats(b, a):
            return max(gaps) > 540 or eb > 0 and ea / eb - 1 > 0.2
        first = b[3] >= a[3] - 60 if a[2] == "arrive" else b[4] <= a[4] + 60
        return not beats(a, b) and first and sa - sb > -300 + 430 * max(120, min(gaps)) ** (1 / 3)

    want = {a[0] for a in rows if not any(drops(b, a) for b in rows if b[0] != a[0] and b[1] == a[1])}
    assert {x.itin for x in trips.dominated_itineraries(plain).collect()} == want and 10 < len(want) < 120
    many = plain.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("itin", F.col("itin") * 100 + F.col("n")).drop("n")
    out = trips.dominated_itineraries(many)
    assert most_rows(out) <= 16000 and out.count() == 100 * len(want)


def test_ranking_reads_legs_once(spark):
    """Once each figure of a journey was aggregated from the legs anew, five passes and more; hashes went a character at a time."""
    from linienwerk.functions.trip import djb2

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def tick(seq):
        seen.add(1)
        return seq

    i = spark.range(400).select(F.col("id").alias("itin"), (F.col("id") % 7).alias("query_id"))
    legs = i.withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long")))).withColumn("seq", tick("seq"))
    t0 = F.col("itin") % 50 * 600 + F.col("seq") * 1000
    legs = legs.select("itin", "query_id", "seq", F.when(F.col("seq") == 2, "WALK").otherwise("BUS").alias("mode"), t0.alias("t0"), (t0 + 600 + F.col("itin") % 90).alias("t1"), F.lit(1).alias("route_id"), F.col("itin").alias("trip_id"), F.lit("1").alias("from_stop"), F.lit("2").alias("to_stop"))
    its = i.select("*", F.lit("leave").alias("mode"), (F.col("itin") % 50 * 600 + 1000).alias("start_s"), (F.col("itin") % 50 * 600 + 3600).alias("end_s"), F.lit(2600).alias("duration_s"), F.lit(600).alias("walk_s"), F.lit(2).alias("boardings"))
    out = trips.rank_itineraries(legs, its, 5)
    assert len(out.collect()) == 35 and seen.value == 1200
    texts = ["", "WALK|60", "é😀x" * 50, None]

    def plain(t):
        h = 5381
        for c in t:
            h = (h * 33 + ord(c)) % (1 << 32)
        return f"{h:08x}"

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", djb2(F.col("t")).alias("h")).collect()
    assert all(x.h == (None if x.t is None else plain(x.t)) for x in got)


def test_groups_read_stop_times_once(spark):
    """Once the station sets were made anew for the pairs, the patterns, the names and the trips. A trip of no part is a group of its own."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(uic):
        seen.add(1)
        return uic

    sets = {1: "abc", 2: "bcd", 3: "abc", 4: "cx", 5: "xy", 6: "cd", 7: "abc", 8: "abc"}
    part = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, 7: None, 8: None}
    st = spark.createDataFrame([(k, u) for k, v in sets.items() for u in v], "trip_id long, uic string").withColumn("uic", tick("uic"))
    t = spark.createDataFrame(list(part.items()), "trip_id long, part long")
    got = {x.trip_id: (x.component, x.tg_id) for x in lines.trip_groups(t, st, "part").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    import hashlib

    assert got[2][1] == hashlib.sha256(b"a,b,c,d").hexdigest()[:8] == got[1][1]
    assert seen.value == sum(map(len, sets.values()))


def test_directions_read_visits_once(spark):
    """Once the ways on were made anew for sides, ends and texts."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def tick(uic):
        seen.add(1)
        return uic

    rows = [("1", "bus", k, i, u) for k, w in enumerate(["abcd", "abce", "dcba", "fba"]) for i, u in enumerate(w)]
    v = spark.createDataFrame(rows, "ref string, mode string, variant long, seq long, uic string").withColumn("uic", tick("uic"))
    names = spark.createDataFrame([(u, u.upper()) for u in "abcdef"], "uic string, name string")
    got = {x.uic: x.text for x in places.directions_from_station(v, names).collect()}
    assert got == {"a": "D · E ↔ A", "b": "D · E ↔ A", "c": "D ↔ E ↔ A", "d": "A ↔ D", "f": "A ↔ F"}
    assert seen.value == len(rows)


def test_orders_fill_partitions_of_one_size(spark, monkeypatch):
    """Once an order's rows were numbered in a fixed number of partitions, however large the table."""
    monkeypatch.setattr(fixtures, "ORDER_ROWS", 500)
    for name in ("fx_legs", "fx_stop_times"):
        assert fixtures.view(spark, "/root/testdata/sf0.001", name).rdd.getNumPartitions() > 10


def test_large_orders_meet_lineitem_by_sorting(spark, monkeypatch):
    """Once all orders were broadcast to each task where their files looked small, up to 9 million of them."""
    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(fixtures, "ORDER_ROWS", 500)
    for df in (fixtures.view(spark, d, "fx_legs"), fixtures.view(spark, d, "fx_stop_times").join(fixtures.trips(spark, d), "trip_id")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shared_stations_fill_partitions_of_one_size(spark, monkeypatch):
    """Once stations and pairs of trips were dealt out in a fixed number of partitions, and the stations made twice."""
    d = "/root/testdata/sf0.001"
    want = {tuple(x) for x in plans_lines.shared_stations(spark, d).collect()}
    monkeypatch.setattr(fixtures, "ORDER_ROWS", 500)
    n, df = fixtures.parts(spark, d), plans_lines.shared_stations(spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert n > 10 and re.search(rf"hashpartitioning\(a#\d+L, b#\d+L, {n}\)", plan) and re.search(rf"hashpartitioning\(uic#\d+, part#\d+L, {n}\)", plan)
    assert {tuple(x) for x in df.collect()} == want and df.count() == len(want)


def test_new_stations_read_stops_twice(spark, monkeypatch):
    """Once stop times were made four times, as stations were joined with variants; the rest met kept stations in a fixed number of partitions."""
    d = "/root/testdata/sf0.001"
    want = {tuple(x) for x in plans_network.new_stations(spark, d).collect()}
    monkeypatch.setattr(fixtures, "ORDER_ROWS", 500)
    n, df = fixtures.parts(spark, d), plans_network.new_stations(spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_orderkey") == 2 and len(re.findall(rf"hashpartitioning\(uic#\d+, {n}\)", plan)) == 2
    assert {tuple(x) for x in df.collect()} == want and want


def test_pairs_fill_partitions_of_one_size(spark, monkeypatch):
    """Once pairs of stations were sorted in a fixed number of partitions, however many there were."""
    rows = [(1, k, [f"s{k // 3}", f"s{k // 3 + 100}", f"t{k}"]) for k in range(60)] + [(None, 99, ["s0", "s100"]), (1, 100, [])]
    sets = spark.createDataFrame(rows, "part long, pattern_id long, stations array<string>")
    plans, put = [], Stash.put
    monkeypatch.setattr(Stash, "put", lambda self, df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or put(self, df))
    monkeypatch.setattr(lines, "PAIR_ROWS", 20)
    got = {x.id: x.component for x in lines.pair_components(sets, "part").collect()}
    assert got == {k: k - k % 3 for k in range(60)} | {99: 99, 100: 100}
    assert any(p.count(", 10), REPARTITION_BY_NUM") == 2 for p in plans)


def test_loops_send_no_tables_to_the_driver(spark):
    """Once tables of the rounds were broadcast through the driver, as their files look small."""
    p = spark.range(300).select("id", F.col("id").alias("key"), (8 + F.col("id") * 0.001).alias("lon"), F.lit(46.8).alias("lat"))
    e = spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    for out in (rounds.ordered_batches(p, "key", "id"), graph.connected_components(e, e.select(F.col("src").alias("id")))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_throttle_keys_share_state(spark, tmp_path):
    """Once each key had a state of its own, so that calls grew with the keys."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

    s = StructType([StructField("user", StringType()), StructField("ts", TimestampType()), StructField("n", LongType())])
    rows = spark.range(400).select((F.col("id") % 40).cast("string").alias("user"), F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 40) * 20).alias("ts"), F.col("id").alias("n"))
    last = spark.range(1).select(F.lit("z").alias("user"), F.timestamp_seconds(F.lit(1_700_009_000)).alias("ts"), F.lit(None).cast("long").alias("n"))
    for part in (rows, last):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = jobs.stream_throttle(spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "user", "ts", 60, 2, "10 seconds", buckets=3)
    q = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(x.numRowsTotal for p in q.recentProgress for x in p.stateOperators) < 40
    got = spark.read.schema(live.schema).parquet(str(tmp_path / "out")).collect()
    # of ten events 20 seconds apart, two in a minute
    assert len(got) == 400 and all(x.accepted == (x.n // 40 % 3 < 2) for x in got)
