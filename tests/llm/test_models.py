"""The quality verdict against distances worked out one by one, and compiled rules against the trees that they come from."""

import math
import random
import re

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from linienwerk.llm import quality_rules, rule_ensemble

DOCS = "doc_id long, text string, lang string, kept int, r_n string"


def histograms(t, lang):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(t)
    ch = [sum(c.isupper() for c in t), sum(c.isdigit() for c in t), sum(c in ".,;:!?'\"()-" for c in t), sum(c in "#*$%&|<>=+/\\_~^@{}[]" for c in t), n - sum(map(len, w))]
    words = [w.count(x) for x in quality_rules.COMMON[lang]] if lang in quality_rules.COMMON else None
    share = lambda a, m: [x / max(m, 1) for x in [*a, m - sum(a)]]
    return len(w), n, share(ch, n), None if words is None else share(words, len(w))


def distance(p, q):
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q, strict=True)) / 2))


def test_verdict_equals_distances_one_by_one(spark):
    r = random.Random(2)
    rows = []
    for k in range(160):
        lang = ("en", "fr", "de", "xx", None)[k % 5]
        pool = [*quality_rules.COMMON.get(lang, ["so", "mi"]), *(f"word{i}" for i in range(20 + k))]
        t = [r.choice(pool) if r.random() > (k % 7) / 8 else r.choice(("A1!", "##", "BIG", "é,", "99")) for _ in range(r.choice((5, 30, 70, 120, 200)))]
        rows.append((k, "".join(x + r.choice((" ", " ", "\n")) for x in t), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "lone tongue " * 3 + " ".join(f"u{i}" for i in range(90)), "only one")]
    rows += [(903 + k, " ".join(f"Z{k}Q{i}!!" for i in range(90)), ("en", "fr")[k % 2]) for k in range(4)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], DOCS).repartition(3)
    got = {x.doc_id: x for x in quality_rules.quality_rules(df).collect()}
    own = {k: histograms(t or "", lang) for k, t, lang in rows}
    kinds = {}
    for k, _, lang in rows:
        if not got[k].base_failed and own[k][0] >= 60 and own[k][1] >= 200:
            kinds.setdefault(lang, []).append(own[k])
    mean = lambda hs: [sum(x) / len(hs) for x in zip(*hs, strict=True)]
    judged = rejected = 0
    for k, _, lang in rows:
        n, size, ch, words = own[k]
        same = kinds.get(lang, [])
        a = b = None
        if n >= 60 and size >= 200 and len(same) >= 5:
            a = distance(ch, mean([x[2] for x in same]))
            b = None if words is None else distance(words, mean([x[3] for x in same]))
        assert got[k].char_distance == (None if a is None else pytest.approx(a, abs=1e-9)) and got[k].word_distance == (None if b is None else pytest.approx(b, abs=1e-9))
        far = (a or 0) > 0.35 or (b or 0) > 0.45
        assert got[k].kept == (not got[k].base_failed and not far)
        judged, rejected = judged + (a is not None), rejected + far
    assert judged > 40 and 0 < rejected < judged


@pytest.mark.parametrize("kind", ["forest", "boost"])
def test_rules_hold_where_the_trees_lead(spark, kind):
    """Rows of one leaf fulfil the same rules of the tree, those of two leaves don't; the deepest of them is the leaf's path."""
    r = random.Random(3)
    names = tuple("abc")
    rows = [(float(r.random() < x * y), x, y, float(r.randrange(4))) for x, y in ((r.random(), r.random()) for _ in range(400))]
    x = VectorAssembler(inputCols=list(names), outputCol="features").transform(spark.createDataFrame(rows, "label double, a double, b double, c double")).cache()
    model = (RandomForestClassifier(numTrees=4, maxDepth=3, seed=1) if kind == "forest" else GBTClassifier(maxIter=3, maxDepth=3, seed=1)).setLeafCol("leaf").fit(x)
    leaves = model.transform(x)
    for i, tree in enumerate(model.trees):
        rules = sorted(rule_ensemble.tree_rules(tree.toDebugString))
        on = leaves.select("a", "b", "c", F.col("leaf")).select(*[rule_ensemble.rule_column(rule, names).alias(f"r{k}") for k, rule in enumerate(rules)], F.udf(lambda v, i=i: int(v[i]), "int")("leaf").alias("at")).collect()
        by_leaf = {}
        for o in on:
            by_leaf.setdefault(o["at"], set()).add(tuple(o[:-1]))
        assert all(len(v) == 1 for v in by_leaf.values()) and len({next(iter(v)) for v in by_leaf.values()}) == len(by_leaf) > 2
        assert {len({k for k, y in enumerate(next(iter(v))) if y}) for v in by_leaf.values()} <= {1, 2, 3}


def test_ensemble_score_is_the_sum_of_its_rules(spark):
    e = rule_ensemble.RuleEnsemble(-0.5, [(1.25, ((0, "<=", 0.5),)), (-2.0, ((0, ">", 0.2), (1, "<=", 3.0)))], ("p", "q"))
    rows = [(0.1, 1.0), (0.3, 2.0), (0.5, 9.0), (0.9, 3.0), (None, 1.0)]
    got = spark.createDataFrame(rows, "p double, q double").select("p", "q", e.score().alias("s")).collect()
    for x in got:
        z = -0.5 + 1.25 * (x.p is not None and x.p <= 0.5) - 2.0 * (x.p is not None and x.p > 0.2 and x.q <= 3.0)
        assert x.s == pytest.approx(1 / (1 + math.exp(-z)))
