"""Quality classifier: a sparse ensemble of rules taken from trees.

Trees over text statistics give paths; each path is a conjunction of
comparisons; lasso logistic regression weighs the rules, most of them with 0;
the rest are compiled into one Spark column expression.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from linienwerk.llm.common import SPACE, words
from linienwerk.shared import Stash

#: Function words of the corpora's languages (fixed values, common knowledge).
FUNCTION_WORDS = sorted({*"the of and to in is that for it as was with be by on".split(), *"der die und den von zu das mit des ist nicht ein eine".split(), *"de la que el en los se del las un por con una".split(), *"le et les une est pour qui dans sur au".split()})

FEATURES = ("n_words", "word_length", "upper", "digit", "symbol", "stop", "pipe", "bang", "function_words", "distinct_words", "distinct_lines", "line_words", "lead")


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; all are 0 or 1 for an empty one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    w = words(text)
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / chars
    return {
        "n_words": F.size(w).cast("double"),
        "word_length": F.length(F.array_join(w, "")) / n,
        "upper": count(r"[^\p{Lu}]+"),
        "digit": count(r"[^\p{Nd}]+"),
        "symbol": count(r"[^#*$%&<>]+"),
        "stop": count(r"[^.,;:?]+"),
        "pipe": count(r"[^|]+"),
        "bang": count(r"[^!]+"),
        "function_words": F.size(F.filter(w, lambda x: x.isin(FUNCTION_WORDS))) / n,
        "distinct_words": F.size(F.array_distinct(w)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.size(w) / F.size(lines).cast("double"),
        "lead": F.when(F.length(F.ltrim(t)) < F.length(t), 1.0).otherwise(0.0),
    }


def tree_rules(dump: str) -> set[tuple[tuple[int, str, float], ...]]:
    """All paths of the trees in a model's debug string, each as sorted ``(feature, '<=' or '>', bound)``, the tightest bound kept."""
    rules, path = set(), []
    for line in dump.splitlines():
        m = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            if "Tree" in line:
                path = []
            continue
        depth = len(line) - len(line.lstrip())
        path = [p for p in path if p[0] < depth] + [(depth, int(m[1]), m[2], float(m[3]))]
        tight: dict[tuple[int, str], float] = {}
        for _, f, op, x in path:
            old = tight.get((f, op))
            tight[f, op] = x if old is None else (min(old, x) if op == "<=" else max(old, x))
        rules.add(tuple(sorted((f, op, x) for (f, op), x in tight.items())))
    return rules


def rule_column(rule: tuple[tuple[int, str, float], ...], names: tuple[str, ...] = FEATURES) -> Column:
    out = None
    for f, op, x in rule:
        c = F.col(names[f]) <= x if op == "<=" else F.col(names[f]) > x
        out = c if out is None else out & c
    return F.coalesce(out, F.lit(False)).cast("double")


class RuleEnsemble:
    """Rules with weights; ``score`` is the column expression they compile to."""

    def __init__(self, bias: float, rules: list[tuple[float, tuple]], names: tuple[str, ...] = FEATURES):
        self.bias, self.rules, self.names = bias, rules, names

    def score(self) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.lit(weight) * rule_column(rule, self.names)
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join([f"{self.bias:+.4f}"] + [f"{w:+.4f} if " + " and ".join(f"{self.names[f]} {op} {x:.6g}" for f, op, x in r) for w, r in self.rules])


def fit_rules(labelled: DataFrame, max_rows: int = 20_000, trees: int = 12, depth: int = 3, l1: float = 0.003, seed: int = 3) -> RuleEnsemble:
    """``(label, statistics…) → RuleEnsemble``.

    At most ``max_rows`` rows are used: those with the smallest hash of the
    column ``pick``. There are at most as many rules as the trees have nodes.
    With one label only, the ensemble is a constant.
    """
    spark = labelled.sparkSession
    rows = labelled.where("label is not null").select(F.col("label").cast("double").alias("label"), *FEATURES, F.xxhash64("pick").alias("h")).orderBy("h", *FEATURES, "label").limit(max_rows)
    rows = Stash(spark, "rules").put(rows.drop("h").coalesce(4))
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        p = (float(ones or 0) + 1) / (n + 2)
        return RuleEnsemble(math.log(p / (1 - p)), [])
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features").cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(x)
    boost = GBTClassifier(maxIter=6, maxDepth=depth, seed=seed).fit(x)
    rules = sorted(tree_rules(forest.toDebugString) | tree_rules(boost.toDebugString), key=lambda r: (len(r), r))
    on = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(rows.select("label", *[rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)])).select("label", "features").cache()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=l1, maxIter=60, standardization=False).fit(on)
    x.unpersist()
    on.unpersist()
    return RuleEnsemble(float(lasso.intercept), [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w])


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, hold_out: int = 5, **fit) -> DataFrame:
    """``docs (doc_id, text), labels (doc_id, quality) → (doc_id, held_out, score, predicted)``.

    Rows with ``crc32(doc_id) % hold_out = 0`` are held out and teach nothing.
    Scores come from the statistics of the text alone. A null or empty text
    has the statistics of an empty one and gets its score; a null doc_id is in
    no fold's zero (its remainder counts as 1) and has no label; a doc_id with
    several labels teaches each; repeated rows are scored each; other columns
    are ignored; an empty table gives no rows; without labels the score is 0.5.
    """
    spark = docs.sparkSession
    s = statistics(F.col("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % hold_out == 0, F.lit(False))
    stats = Stash(spark, "quality-stats").put(docs.select("doc_id", held.alias("held_out"), *[s[k].alias(k) for k in FEATURES]))
    own = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("quality").alias("label"))
    labelled = stats.where("not held_out").join(own, F.col("doc_id") == F.col("l_id")).withColumn("pick", F.col("doc_id"))
    model = fit_rules(labelled, **fit)
    scored = stats.select("doc_id", "held_out", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
