"""From which zoom on lines and stations are drawn: levels that leave no island of lines, and stations that follow their lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from linienwerk.operators.graph import connected_components
from linienwerk.operators.rounds import spaced_along
from linienwerk.shared import Stash

# --- lines


def zoom_gating(lines: DataFrame, edges: DataFrame, base: DataFrame, first: int = 4, last: int = 13) -> DataFrame:
    """``lines (line_id, candidate, stations), edges (src, dst), base (line_id) → (line_id, level, isolated)``.

    Lines of the base have their candidate level. Then, level by level: lines
    whose level or, while they have none, whose candidate is reached are drawn,
    and those that hang together with the base get this level. Any other
    component is drawn from this level on if the mean candidate of it and of
    its bridge, weighed by stations, is no higher; a bridge is the fewest lines
    not yet drawn that join it to the base's component (ties: smaller line ids,
    seen from the base), and is drawn along with it. Others wait. Lines that no
    level reached keep their candidate and are ``isolated``.

    All components of a level are judged against the base's component as the
    level found it; what they bring counts from the next level on. So the
    result doesn't depend on an order of components. If the base is in several
    components, that with the smallest label counts. Components aren't worked
    out anew: a level joins those of the one before by the edges of new lines.

    A null candidate is ``last``, null stations are 1; edges count in both
    directions, and loops, unknown lines and nulls in them don't.
    """
    stash = Stash(lines.sparkSession, "gating", merge=True)
    info = stash.put(lines.where("line_id is not null").select("line_id", F.coalesce(F.col("candidate").cast("int"), F.lit(last)).alias("candidate"), F.coalesce(F.col("stations").cast("long"), F.lit(1)).alias("stations")))
    known = info.select("line_id")
    one = edges.select("src", "dst").where("src <> dst")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = stash.put(both.join(known.select(F.col("line_id").alias("src")), "src", "left_semi").join(known.select(F.col("line_id").alias("dst")), "dst", "left_semi"))
    in_base = base.select("line_id").distinct().withColumn("in_base", F.lit(True))
    state = stash.put(info.join(in_base, "line_id", "left").select(*info.columns, F.coalesce("in_base", F.lit(False)).alias("in_base"), F.when(F.coalesce("in_base", F.lit(False)), F.col("candidate")).alias("level"), F.lit(None).cast(info.schema["line_id"].dataType).alias("label")))
    some_without = bool(info.where("stations < 1").limit(1).count())
    for z in range(first, last + 1):
        drawn = F.coalesce("level", "candidate") <= z
        state = stash.put(_joined(state.withColumn("drawn", drawn), both, stash))
        main, rest = state.agg(F.min(F.when(F.col("drawn") & F.col("in_base"), F.col("label"))), F.max(~F.col("drawn"))).first()
        if main is None:
            continue
        state = state.withColumn("level", F.when(F.col("drawn") & (F.col("label") == F.lit(main)) & F.col("level").isNull(), z).otherwise(F.col("level")))
        waiting = state.where(F.col("drawn") & (F.col("label") != F.lit(main))).groupBy("label").agg(F.sum(F.col("stations") * F.col("candidate")).alias("weight"), F.sum("stations").alias("n"), F.max(F.col("level").isNull()).alias("open")).where("open")
        waiting = stash.put(waiting.select("label", "weight", "n"))
        # a line that isn't drawn has a candidate above this level, and so costs a waiting component one or more of what it has to give
        most = waiting.agg(F.max(z * F.col("n") - F.col("weight"))).first()[0]
        if not rest or most is None or some_without and most < 0 or not some_without and most < 1:
            if not rest:  # no line is left that a later level could bring
                break
            state = stash.put(state)
            continue
        bridges = stash.put(_bridges(state, both, main, waiting, None if some_without else most, stash))
        # a bridge of no line would have joined the two
        over = bridges.select("label", F.explode("bridge").alias("line_id")).join(info, "line_id").groupBy("label").agg(F.sum(F.col("stations") * F.col("candidate")).alias("w"), F.sum("stations").alias("m"))
        pulled = waiting.join(over, "label").where((F.col("n") + F.col("m") > 0) & (F.col("weight") + F.col("w") <= z * (F.col("n") + F.col("m")))).select("label")
        pulled = stash.put(pulled)
        lines_in = bridges.join(pulled, "label", "left_semi").select(F.explode("bridge").alias("line_id")).unionByName(state.where("drawn").join(pulled, "label", "left_semi").select("line_id")).distinct().withColumn("pulled", F.lit(True))
        state = stash.put(state.join(lines_in, "line_id", "left").withColumn("level", F.when(F.col("pulled") & F.col("level").isNull(), z).otherwise(F.col("level"))).drop("pulled"))
    return state.select("line_id", F.coalesce("level", "candidate").alias("level"), F.col("level").isNull().alias("isolated"))


def _joined(state: DataFrame, both: DataFrame, stash: Stash) -> DataFrame:
    """The labels of drawn lines, after those that are new have joined the components they touch. A label is a line of the component, the smallest when it arose."""
    own = state.withColumn("label", F.when(F.col("drawn"), F.coalesce("label", "line_id")))
    label = own.where("drawn").select("line_id", "label")
    new = state.where(F.col("drawn") & F.col("label").isNull()).select(F.col("line_id").alias("src"))
    ends = both.join(new, "src", "left_semi").join(label.select(F.col("line_id").alias("src"), F.col("label").alias("x")), "src").join(label.select(F.col("line_id").alias("dst"), F.col("label").alias("y")), "dst")
    ends = stash.put(ends.select(F.col("x").alias("src"), F.col("y").alias("dst")).where("src <> dst").distinct())
    if not ends.limit(1).count():
        return own.select(*[c for c in state.columns if c != "drawn"], "drawn")
    comp = connected_components(ends)
    return own.join(comp.select(F.col("id").alias("label"), "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component").select(*[c for c in state.columns if c != "drawn"], "drawn")


def _bridges(state: DataFrame, both: DataFrame, main, waiting: DataFrame, most: int | None, stash: Stash) -> DataFrame:
    """``(label, bridge)``: for each waiting component that the base's can reach over ``most`` lines, the lines between, from the base's end.

    A search by breadth from the base's component: drawn components cost
    nothing to cross, a line that isn't drawn costs one. Each line and
    component keeps the first way that reached it, of equal ones the smallest.
    """
    # drawn lines stand as their component, others as themselves
    node = F.when(F.col("drawn"), F.struct(F.lit(True).alias("drawn"), F.col("label").alias("id"))).otherwise(F.struct(F.lit(False).alias("drawn"), F.col("line_id").alias("id")))
    of = state.select("line_id", node.alias("node"))
    links = both.join(of.select(F.col("line_id").alias("src"), F.col("node").alias("x")), "src").join(of.select(F.col("line_id").alias("dst"), F.col("node").alias("y")), "dst").where("x <> y").select("x", "y").distinct()
    links = stash.put(links)
    line = state.schema["line_id"].dataType.simpleString()
    front = stash.put(state.where(F.col("drawn") & (F.col("label") == F.lit(main))).limit(1).select(node.alias("x"), F.array().cast(f"array<{line}>").alias("way")))
    met, found, depth = front.select("x"), None, 0
    while most is None or depth < most:
        depth += 1

        # lines next to what the last round reached, and the components next to these lines
        def step(at: DataFrame, drawn: bool) -> DataFrame:
            out = at.join(links, "x").where(F.col("y.drawn") == drawn)  # noqa: B023
            way = F.col("way") if drawn else F.concat("way", F.array("y.id"))
            return out.select(F.col("y").alias("x"), way.alias("way")).join(met, "x", "left_anti").groupBy("x").agg(F.min("way").alias("way"))  # noqa: B023

        new_lines = stash.put(step(front, False))
        if not new_lines.limit(1).count():
            break
        new_comps = stash.put(step(new_lines, True))
        hit = new_comps.select(F.col("x.id").alias("label"), F.col("way").alias("bridge")).join(waiting, "label", "left_semi")
        found = hit if found is None else found.unionByName(hit)
        front = new_lines.unionByName(new_comps)
        met = met.unionByName(front.select("x"))
    return found if found is not None else waiting.limit(0).select("label", F.array().cast(f"array<{line}>").alias("bridge"))


# --- stations


@dataclass(frozen=True)
class Rule:
    """One rule of a mode: which stations of lines drawn at ``level`` it brings to that level."""

    mode: str
    kind: str
    level: int
    min_km: float = 0.0
    #: Tiers that an intersection, or a terminus, needs; None: any, (): never.
    intersection: tuple[str, ...] | None = None
    terminus: tuple[str, ...] | None = None


_MAIN = ("major_train", "main_train")
_IMPORTANT = (*_MAIN, "important_train")
_STATION = (*_IMPORTANT, "train_station")

#: Levels, distances and tiers of the rules, in the order in which equal levels are named.
RULES = (
    Rule("train", "junction", 7, intersection=_MAIN, terminus=_STATION),
    Rule("train", "intercity", 8),
    Rule("train", "junction", 8, intersection=_IMPORTANT, terminus=()),
    Rule("train", "junction", 9),
    Rule("train", "spaced", 9, 5.0),
    Rule("train", "spaced", 10, 3.0),
    Rule("train", "all", 11),
    Rule("metro", "junction", 10),
    Rule("metro", "spaced", 11, 1.0),
    Rule("metro", "all", 12),
    Rule("ferry", "all", 10),
    Rule("mountain", "all", 10),
    Rule("regional_bus", "junction", 10),
    Rule("regional_bus", "spaced", 11, 1.0),
    Rule("regional_bus", "all", 12),
    Rule("tram", "junction", 10),
    Rule("tram", "spaced", 11, 1.0),
    Rule("tram", "all", 12),
    Rule("bus", "junction", 10),
    Rule("bus", "spaced", 11, 1.0),
    Rule("bus", "spaced", 12, 0.5),
    Rule("bus", "all", 13),
)
#: The level of what no rule reaches, and the most stations that two lines share where they cross.
NEVER, CROSSING = 14, 2


def stop_min_zoom(line_stops: DataFrame, lines: DataFrame, stations: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``→ (uic, level, candidate, label, is_intersection, is_terminus)``, a row for each station that a line serves.

    ``line_stops (line_id, idx, uic, km)``: the stops of a line in order, with
    the km along it. ``lines (line_id, line_key, mode, min_zoom, intercity)``.
    ``stations (uic, importance, tier)``.

    Each rule looks at the lines of its mode that are drawn at its level:
    ``junction`` takes stations where two line keys cross (they share at most
    ``CROSSING`` stations) or a line ends; ``intercity`` those on intercity
    lines; ``spaced`` the stops of a line by importance (ties: uic, then place),
    each unless one taken is nearer along the line than ``min_km``; ``all``
    those of the mode's lines of any level, at the rule's or the line's,
    whichever is later. The lowest level counts, of rules that give the same
    one the first; a station is never drawn before the first of its lines.

    Stops without a station are passed over, but count in the places of the
    others; null levels are never reached; stations without importance have 0.
    """
    stash = Stash(line_stops.sparkSession, "stations")
    of_line = lines.select("line_id", F.coalesce("line_key", F.col("line_id").cast("string")).alias("line_key"), "mode", F.coalesce(F.col("min_zoom").cast("int"), F.lit(NEVER)).alias("min_zoom"), F.coalesce("intercity", F.lit(False)).alias("intercity"))
    ends = line_stops.groupBy("line_id").agg(F.min("idx").alias("i0"), F.max("idx").alias("i1"))
    s = line_stops.join(of_line, "line_id").join(ends, "line_id").where("uic is not null and uic <> ''").withColumn("ends", (F.col("idx") == F.col("i0")) | (F.col("idx") == F.col("i1")))
    s = stash.put(s.join(stations.select("uic", F.coalesce("importance", F.lit(0)).alias("importance"), "tier"), "uic", "left").fillna({"importance": 0}).drop("i0", "i1"))
    place = {r: k for k, r in enumerate(rules)}
    name = lambda r: F.lit(f"{r.mode}: {r.kind}" + (f" {r.min_km:g} km" if r.min_km else ""))

    def hits(rows: DataFrame, level: Column, rule: Rule) -> DataFrame:
        return rows.select("uic", level.cast("int").alias("level"), F.lit(place[rule]).alias("place"), name(rule).alias("label"))

    def drawn(r: Rule) -> DataFrame:
        return s.where((F.col("mode") == r.mode) & (F.col("min_zoom") <= r.level))

    found = [hits(s.where(F.col("mode") == r.mode), F.greatest(F.lit(r.level), F.col("min_zoom")), r) for r in rules if r.kind == "all"]
    found += [hits(drawn(r).where("intercity"), F.lit(r.level), r) for r in rules if r.kind == "intercity"]
    # all spacings at once: a rule and a line make a key
    spaced = [r for r in rules if r.kind == "spaced"]
    if spaced:
        p = drawn(spaced[0]).limit(0).withColumn("rule", F.lit(0)).withColumn("min_km", F.lit(0.0))
        for r in spaced:
            p = p.unionByName(drawn(r).withColumn("rule", F.lit(place[r])).withColumn("min_km", F.lit(r.min_km)))
        p = p.withColumn("key", F.struct("rule", "line_id"))
        kept = stash.put(spaced_along(p, F.struct((-F.col("importance")).alias("i"), "uic", "idx")).select("uic", "rule"))
        found += [hits(kept.where(F.col("rule") == place[r]), F.lit(r.level), r) for r in spaced]
    marks = None
    for mode in dict.fromkeys(r.mode for r in rules if r.kind == "junction"):
        levels = sorted({r.level for r in rules if r.kind == "junction" and r.mode == mode})
        marked = stash.put(_junctions(s.where(F.col("mode") == mode), levels, stash))
        marks = marked if marks is None else marks.unionByName(marked)
        for r in (x for x in rules if x.kind == "junction" and x.mode == mode):
            here = marked.where(F.col("at") == r.level)
            allowed = lambda tiers: F.lit(True) if tiers is None else F.coalesce(F.col("tier").isin(list(tiers)), F.lit(False)) if tiers else F.lit(False)
            found.append(hits(here.where((F.col("crosses") & allowed(r.intersection)) | (F.col("terminus") & allowed(r.terminus))), F.lit(r.level), r))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("uic").agg(F.min(F.struct("level", "place", "label")).alias("b"))
    served = s.groupBy("uic").agg(F.min("min_zoom").alias("first"))
    out = served.join(best, "uic", "left")
    if marks is not None:
        out = out.join(marks.groupBy("uic").agg(F.max("crosses").alias("crosses"), F.max("terminus").alias("terminus")), "uic", "left")
    else:
        out = out.withColumns({"crosses": F.lit(False), "terminus": F.lit(False)})
    reached = F.coalesce("b.level", F.lit(NEVER)) < NEVER
    candidate = F.when(reached, F.col("b.level")).otherwise(NEVER)
    return out.select("uic", F.greatest(candidate, F.col("first")).alias("level"), candidate.alias("candidate"), F.when(reached, F.col("b.label")).otherwise("").alias("label"), F.coalesce("crosses", F.lit(False)).alias("is_intersection"), F.coalesce("terminus", F.lit(False)).alias("is_terminus"))


def _junctions(s: DataFrame, levels: list[int], stash: Stash) -> DataFrame:
    """``(at, uic, tier, crosses, terminus)`` of the stations of one mode's lines drawn at each level."""
    at = s.withColumn("at", F.explode(F.array(*map(F.lit, levels)))).where(F.col("min_zoom") <= F.col("at"))
    keys = stash.put(at.groupBy("at", "uic", "line_key").agg(F.max("ends").alias("ends"), F.first("tier").alias("tier")))
    every = keys.groupBy("at", "uic").agg(F.max("ends").alias("terminus"), F.first("tier").alias("tier"))
    hit = crossing_stations(keys, stash=stash).withColumn("crosses", F.lit(True))
    return every.join(hit, ["at", "uic"], "left").select("at", "uic", "tier", F.coalesce("crosses", F.lit(False)).alias("crosses"), "terminus")


def crossing_stations(keys: DataFrame, most: int = CROSSING, stash: Stash | None = None) -> DataFrame:
    """Distinct ``(at, uic, line_key) → (at, uic)``: stations where some two line keys cross, as they share at most ``most`` stations in all.

    It is first asked of a station's smallest key and each other one, a row for
    a key and not for a pair. Only where all of them share more stations with
    that key do the others meet each other.
    """
    stash = stash or Stash(keys.sparkSession, "crossings")
    first = keys.groupBy("at", "uic").agg(F.min("line_key").alias("a"), F.count("*").alias("n"))

    def crossing(pairs: DataFrame) -> DataFrame:
        """Stations of the pairs of keys that share few."""
        ab = pairs.select("at", "a", "b").distinct()
        shared = ab.join(keys.select("at", F.col("line_key").alias("a"), "uic"), ["at", "a"]).join(keys.select("at", F.col("line_key").alias("b"), "uic"), ["at", "b", "uic"])
        few = shared.groupBy("at", "a", "b").agg(F.count("*").alias("c")).where(F.col("c") <= most)
        return pairs.join(few.select("at", "a", "b"), ["at", "a", "b"], "left_semi").select("at", "uic").distinct()

    star = keys.join(first.where("n > 1").select("at", "uic", "a"), ["at", "uic"]).where("line_key <> a").select("at", "uic", "a", F.col("line_key").alias("b"))
    one = stash.put(crossing(star))
    rest = first.where("n > 2").select("at", "uic", "a").join(one, ["at", "uic"], "left_anti")
    others = stash.put(keys.join(rest, ["at", "uic"]).where("line_key <> a").select("at", "uic", F.col("line_key").alias("k")))
    two = crossing(others.select("at", "uic", F.col("k").alias("a")).join(others.select("at", "uic", F.col("k").alias("b")), ["at", "uic"]).where("a < b"))
    return one.unionByName(two).distinct()
