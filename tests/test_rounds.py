"""Greedy operators in rounds against loops over all rows in order; levels of lines against a search line by line."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from linienwerk.operators import gating, rounds


def haversine(x, y):
    a = math.sin(math.radians(y[1] - x[1]) / 2) ** 2 + math.cos(math.radians(x[1])) * math.cos(math.radians(y[1])) * math.sin(math.radians(y[0] - x[0]) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def planar(x, y, lat0=46.8):
    return math.hypot((x[0] - y[0]) * 111320 * math.cos(math.radians(lat0)), (x[1] - y[1]) * 111320)


def test_first_come_equals_a_loop(spark):
    r = random.Random(1)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)} | {(k, k + 1) for k in range(100, 106)}
    df = spark.createDataFrame([(a, b, a) for a, b in pairs for _ in range(2)] + [(None, 3, 0), (2, None, 0)], "a long, b long, place long").repartition(3)
    by = {}
    for k in range(110):
        if better := [a for a, b in pairs if b == k and a not in by]:
            by[k] = min(better)
    assert {x.b: x.a for x in rounds.first_come(df).collect()} == by and len(by) > 20
    assert rounds.first_come(df.limit(0)).collect() == []


# --- boxes


def test_overlapping_boxes_of_several_sizes(spark):
    r = random.Random(2)
    boxes = [(k, r.choice("pq"), x := r.uniform(-3, 3), y := r.uniform(-3, 3), x + r.choice((0.01, 0.2, 1, 4)) * r.random(), y + r.choice((0.01, 0.3, 2)) * r.random()) for k in range(120)]
    boxes += [(200, "p", 0.0, 0.0, 1.0, 1.0), (201, "p", 0.0, 0.0, 1.0, 1.0), (202, "p", 1.0, 0.0, 2.0, 1.0), (203, "q", None, 0.0, 1.0, 1.0), (204, "q", 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(boxes, "id long, ref string, w double, s double, e double, n double")
    want = {}
    for x, y in itertools.combinations([b for b in boxes if b[2] is not None and b[2] < b[4]], 2):
        w, h = min(x[4], y[4]) - max(x[2], y[2]), min(x[5], y[5]) - max(x[3], y[3])
        if x[1] == y[1] and w > 0 and h > 0:
            want[x[0], y[0]] = w * h
    got = rounds.overlapping_boxes(df, "ref", "id").collect()
    assert len(got) == len(want) > 100 and {(p.x, p.y): p.shared for p in got} == pytest.approx(want)


def test_dedup_overlapping(spark):
    r = random.Random(3)
    rows = []
    for k in range(50):
        x, y = r.uniform(0, 1), r.uniform(0, 1)
        rows.append((k, r.choice(("a", "b", "", None)), r.randint(2, 6), x, y, x + r.uniform(0.1, 0.9), y + r.uniform(0.1, 0.9), "x"))
    rows.append((99, "a", 9, None, None, None, None, "no box"))
    df = spark.createDataFrame(rows, "feature_id long, ref string, n_points int, w double, s double, e double, n double, place string")
    kept = []
    for x in sorted(rows, key=lambda x: (-x[2], x[0])):
        hit = False
        for y in kept if x[1] and x[3] is not None else ():
            if y[1] == x[1] and y[3] is not None:
                w, h = min(x[5], y[5]) - max(x[3], y[3]), min(x[6], y[6]) - max(x[4], y[4])
                hit |= w > 0 and h > 0 and w * h >= 0.65 * min((z[5] - z[3]) * (z[6] - z[4]) for z in (x, y))
        if not hit:
            kept.append(x)
    got = rounds.dedup_overlapping(df).collect()
    assert sorted(x.feature_id for x in got) == sorted(x[0] for x in kept) and len(kept) < len(rows) and got[0].place
    assert rounds.dedup_overlapping(df.limit(0)).count() == 0


# --- clusters


def test_clusters_equal_a_loop_over_stops(spark):
    r = random.Random(4)
    rows = [(k, r.choice(("rail", "other")), 8 + r.random() * 0.02, 46.8 + r.random() * 0.01, [r.randrange(9) for _ in range(r.randint(0, 2))]) for k in range(80)]
    rows += [(200, "rail", 8.0, 46.8, None), (201, "rail", 8.0, 46.8, []), (202, "rail", None, 46.8, [1]), (203, "else", 8.0, 46.8, [1]), (204, None, 8.0, 46.8, [1])]
    radius, took, seeds = {"rail": 300.0, "other": 150.0}, {}, []
    for k, kind, x, y, lines in rows:
        for s in seeds:
            if kind in radius and None not in (x, s[2]) and s[1] == kind and planar((x, y), s[2:4]) < radius[kind] and not s[4] & set(lines or []):
                s[4].update(lines or [])
                took[k] = s[0]
                break
        else:
            seeds.append((k, kind, x, y, set(lines or [])))
            took[k] = k
    df = spark.createDataFrame(rows, "stop_id long, kind string, lon double, lat double, lines array<long>").repartition(3)
    got = rounds.cluster_stops_greedy(df, radius).collect()
    assert {x.stop_id: x.cluster for x in got} == took and len(got) == len(rows) and len(set(took.values())) < 70
    assert rounds.cluster_stops_greedy(df.limit(0), radius).count() == 0


# --- absorbed stops


def loop_absorb(rows, spacing=2.0):
    """Zoom by zoom, each visible stop in order of rank, score and id takes in those it touches."""
    s = {k: {"at": (x, y), "rank": rank, "low": low, "px": (a, b), "score": [score or 0.0] * 7, "dep": [dep or 0.0] * 7, "lines": [set(lines or []) for _ in range(7)], "by": None, "z": None} for k, x, y, rank, score, low, a, b, dep, lines in rows}
    for z in range(13, 6, -1):
        unit = rounds.metres_per_px(z)
        wide = lambda v: v["px"][0] + (z - 7) / 6 * (v["px"][1] - v["px"][0])  # noqa: E731, B023
        order = sorted((k for k, v in s.items() if v["low"] <= z and v["by"] is None and v["at"][0] is not None), key=lambda k: (-s[k]["rank"], -s[k]["score"][z - 7], k))
        for i, a in enumerate(order):
            if s[a]["by"] is not None:
                continue
            for b in order[i + 1 :]:
                if s[b]["by"] is None and haversine(s[a]["at"], s[b]["at"]) * 1000 / unit <= (wide(s[a]) + wide(s[b])) / 2 + spacing:
                    s[b]["by"], s[b]["z"] = a, z
                    for k in range(s[b]["low"] - 7, z - 6):
                        s[a]["score"][k] += s[b]["score"][k]
                        s[a]["dep"][k] += s[b]["dep"][k]
                        s[a]["lines"][k] |= s[b]["lines"][k]
    return s


def test_absorbed_stops_equal_a_loop(spark):
    r = random.Random(5)
    rows = [(k, 8 + r.random() * 0.15, 46.5 + r.random() * 0.1, r.randrange(3), float(r.randrange(6)), r.randint(7, 12), r.uniform(2, 5), r.uniform(5, 14), r.random(), [r.choice("abcdefgh")]) for k in range(60)]
    rows += [(100, 8.0, 46.5, 1, None, 7, 3.0, 9.0, None, None), (101, 8.0, 46.5, 1, None, 7, 3.0, 9.0, None, []), (102, None, 46.5, 1, 1.0, 7, 3.0, 9.0, 1.0, ["a"])]
    df = spark.createDataFrame(rows, "stop_id long, lon double, lat double, rank int, score double, min_zoom int, px7 double, px13 double, dep_hr double, lines array<string>").repartition(3)
    want, got = loop_absorb(rows), rounds.absorb_stops(df).collect()
    assert len(got) == len(rows) and len({v["z"] for v in want.values()}) > 3
    for x in got:
        w = want[x.stop_id]
        assert (x.absorbed_z, x.absorber) == (w["z"], w["by"])
        assert list(x.score) == pytest.approx(w["score"]) and list(x.dep_hr) == pytest.approx(w["dep"]) and [set(v) for v in x.lines] == w["lines"]
    assert rounds.absorb_stops(df.limit(0)).count() == 0


# --- places along a line


def test_spaced_along_equals_a_loop(spark):
    r = random.Random(6)
    rows = [(k, i, r.choice((None, r.uniform(0, 20), float(r.randrange(20)))), m, r.randrange(4)) for k, m in (("x", 1.0), ("y", 3.0), ("z", 0.0)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, idx int, km double, min_km double, importance int").repartition(3)
    want = set()
    for key in "xyz":
        kept = []
        for k, i, km, m, _ in sorted((x for x in rows if x[0] == key and x[2] is not None), key=lambda x: (-x[4], x[1])):
            if all(abs(km - o) >= m for o in kept):
                kept.append(km)
                want.add((k, i))
    got = rounds.spaced_along(df, F.struct(-F.col("importance"), "idx")).select("key", "idx").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


# --- batches


def loop_batches(points, most, span):
    out, first, box, n = {}, None, None, 0
    for k, (_, i, x, y) in enumerate(sorted(points)):
        wide = (min(x, box[0]), max(x, box[1]), min(y, box[2]), max(y, box[3])) if box else (x, x, y, y)
        if first is None or n >= most or math.hypot((wide[1] - wide[0]) * 111320 * math.cos(math.radians(46.8)), (wide[3] - wide[2]) * 111320) > span:
            first, n, wide = k, 0, (x, x, y, y)
        box, n = wide, n + 1
        out[i] = first
    return out


@pytest.mark.parametrize("parts", [3, 50])
def test_batches_do_not_depend_on_partitions(spark, parts):
    r = random.Random(7)
    points = [(r.randrange(150), k, 8 + r.random() * 0.05 + k % 3 * 0.2, 46.8 + r.random() * 0.05) for k in range(300)]
    df = spark.createDataFrame(points, "key long, id long, lon double, lat double").repartition(parts)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts // 3 + 2)
    try:
        got = rounds.ordered_batches(df, "key", "id", most=7, span_m=20_000).collect()
        one = rounds.ordered_batches(df.limit(1), "key", "id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert {x.id: x.batch for x in got} == loop_batches(points, 7, 20_000) and len(got) == 300
    assert [x.batch for x in one] == [0]


# --- levels of lines


def loop_gating(lines, edges, base, first=4, last=13):
    cand = {i: last if c is None else c for i, c, _ in lines}
    weight = {i: 1 if s is None else s for i, _, s in lines}
    near = {i: set() for i in cand}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    level = {i: cand[i] for i in base}

    def component(start, inside):
        out, todo = {start}, [start]
        while todo:
            for v in near[todo.pop()] & inside - out:
                out.add(v)
                todo.append(v)
        return frozenset(out)

    for z in range(first, last + 1):
        drawn = {i for i in cand if level.get(i, cand[i]) <= z}
        comps = {component(i, drawn) for i in drawn}
        mains = [c for c in comps if c & set(base)]
        if not mains:
            continue
        main = min(mains, key=min)
        level |= {i: z for i in main if i not in level}
        of = {i: c for c in comps for i in c}
        # every line and component with its first way: breadth first, equal ways by the ids on them
        ways, front = {main: ()}, {main: ()}
        while front:
            new = {}
            for x, way in front.items():
                for v in {v for i in (x if isinstance(x, frozenset) else (x,)) for v in near[i]} - drawn:
                    if v not in ways:
                        new[v] = min(new.get(v, (*way, v)), (*way, v))
            more = {}
            for v, way in new.items():
                for c in {of[u] for u in near[v] & drawn}:
                    if c not in ways:
                        more[c] = min(more.get(c, way), way)
            front = new | more
            ways |= front
        pulled = {}
        for c in comps - {main}:
            if all(i in level for i in c) or c not in ways:
                continue
            both = [*c, *ways[c]]
            n = sum(weight[i] for i in both)
            if n and sum(weight[i] * cand[i] for i in both) <= z * n:
                pulled |= dict.fromkeys(both, z)
        level = pulled | level
    return {i: (level.get(i, cand[i]), i not in level) for i in cand}


@pytest.mark.parametrize("seed", [8, 9])
def test_zoom_gating_equals_a_search(spark, seed):
    r = random.Random(seed)
    lines = [(k, r.choice((4, 5, 6, 7, 7, 9)), r.randint(1, 4) if seed == 8 else r.randint(0, 3)) for k in range(60)] + [(70, None, None), (71, 6, 2)]
    edges = [tuple(r.sample(range(60), 2)) for _ in range(55)] + [(70, 3), (5, 5), (None, 4), (4, 999)]
    base = sorted({0, *[b for a, b in edges if a == 0]})[:3]
    schemas = ("line_id long, candidate int, stations long", "src long, dst long", "line_id long")
    last = 8 if seed == 8 else 10
    got = gating.zoom_gating(*(spark.createDataFrame(x, s) for x, s in zip((lines, edges, [(b,) for b in base]), schemas, strict=True)), last=last).collect()
    want = loop_gating(lines, [e for e in edges if None not in e], base, last=last)
    assert {x.line_id: (x.level, x.isolated) for x in got} == want and len(got) == len(lines)
    assert any(w[0] < (c or last) for (i, c, _) in lines for w in [want[i]]) or seed == 9


def test_zoom_gating_without_a_base(spark):
    lines = spark.createDataFrame([(1, 4, 1), (2, None, 1)], "line_id long, candidate int, stations long")
    none = spark.createDataFrame([], "src long, dst long")
    assert {tuple(x) for x in gating.zoom_gating(lines, none, lines.limit(0).select("line_id")).collect()} == {(1, 4, True), (2, 13, True)}


def test_walks_by_a_given_duration(spark):
    """A pandas UDF gives the seconds of a way; pairs without a way and those over the cap go."""
    import pandas as pd

    from linienwerk.operators.spatial import walk_matrix

    @F.pandas_udf("double")
    def ask(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        d = ((x1 - x0).abs() + (y1 - y0).abs()) * 100_000
        return d.where(x1 > x0)

    stops = spark.createDataFrame([("a", 8.0, 46.8), ("b", 8.01, 46.8), ("c", 8.09, 46.8)], "stop_id string, lon double, lat double")
    got = {(r.from_id, r.to_id): r.duration_s for r in walk_matrix(stops, duration_fn=ask).collect()}
    assert set(got) == {("a", "b")} and got["a", "b"] in (999, 1000)
    assert {r.from_id for r in walk_matrix(stops).collect()} == {"a", "b", "c"}
