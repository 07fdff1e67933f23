"""Quality rules: base rules, and divergence of a document's histograms from its language's.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linienwerk.llm.common import SPACE, words
from linienwerk.shared import Stash

#: Characters counted as symbols, fixed by the contract.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages of the corpora (fixed values, common knowledge).
COMMON = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par sur au avec".split(),
}

#: Classes of characters, by Java patterns of what is not in them.
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "stop": r"[^.,;:!?'\"()-]+", "sign": r"[^#*$%&|<>=+/\\_~^@{}\[\]]+"}


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words within windows of ``width`` words that occur at least twice in the text, the first included.

    Windows are compared by a 64-bit hash. A text whose windows all differ is
    told by one pass; others sort (hash, place), mark neighbours with equal
    hashes, and add up how far each marked window reaches before the next.
    """
    # each array is bound once by a lambda over a one-element array
    bind = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    h = bind(F.transform(w, lambda x: F.xxhash64(x)), lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, width)])))
    placed = lambda a: F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    marked = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    at = lambda s: F.sort_array(F.transform(marked(s), lambda x: x["i"]))
    reach = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)
    slow = lambda a: bind(placed(a), lambda s: bind(at(s), reach))
    found = bind(h, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), F.lit(0)).otherwise(slow(a)))
    return F.when(F.size(w) > width, found).otherwise(F.lit(0)).cast("long")


def document_stats(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, lang) → counts and histograms`` of each document; a null text counts as empty."""
    d = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    n_chars = F.length("t")
    word_chars = F.length(F.array_join("w", ""))
    listed = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.lit(v))])
    every = sorted({x for v in COMMON.values() for x in v})
    d = d.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        n_chars.alias("n_chars"),
        F.array(*[F.length(F.regexp_replace("t", p, "")) for p in CLASSES.values()], n_chars - word_chars).alias("classes"),
        F.filter("w", lambda x: x.isin(every)).alias("common"),
        listed[F.col("lang")].alias("listed"),
    )
    rest = lambda a, n: F.concat(a, F.array(n - F.aggregate(a, F.lit(0), lambda x, y: x + y)))
    share = lambda a, n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))
    hits = F.transform("listed", lambda c: F.size(F.filter("common", lambda x: x == c)))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", share(rest(F.col("classes"), F.col("n_chars")), F.col("n_chars")).alias("char_hist"), share(rest(hits, F.col("n_words").cast("int")), F.col("n_words")).alias("word_hist"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits, from 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_judged_words: int = 60, min_judged_chars: int = 200, min_reference_docs: int = 5, max_char_distance: float = 0.35, max_word_distance: float = 0.45) -> DataFrame:
    """``docs → (doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept)``.

    Base rules: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of the words in repeated 8-word windows. A document
    that passes is judged by the Jensen-Shannon distance of its character
    classes and of its common words from the mean histograms of its language,
    taken over all documents that pass the base rules; it is kept unless a
    distance is above its limit. Guards: a distance is null, and rejects
    nothing, for a document below ``min_judged_chars`` characters or
    ``min_judged_words`` words, in a language (null included) with under
    ``min_reference_docs`` such documents, or, for words, without a list.

    One row per input row, repeated rows and null ids included; other columns
    are ignored; an empty table gives no rows.
    """
    stats = Stash(docs.sparkSession, "quality").put(document_stats(docs))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    long_ = (F.col("n_words") >= min_judged_words) & (F.col("n_chars") >= min_judged_chars)
    n_word, n_char = max(len(v) for v in COMMON.values()) + 1, len(CLASSES) + 2
    mean = lambda c, n: F.array(*[F.coalesce(F.avg(F.get(F.col(c), F.lit(k))), F.lit(0.0)) for k in range(n)])
    # one row per language
    ref = stats.where(~failed & long_).groupBy(F.col("lang").alias("r_lang")).agg(mean("char_hist", n_char).alias("r_char"), mean("word_hist", n_word).alias("r_word"), F.count("*").alias("r_n")).where(F.col("r_n") >= min_reference_docs)
    j = stats.join(ref, stats["lang"].eqNullSafe(ref["r_lang"]), "left").withColumn("base_failed", failed)
    j = j.withColumn("char_distance", F.when(long_ & F.col("r_n").isNotNull(), jensen_shannon(F.col("char_hist"), F.col("r_char"))))
    j = j.withColumn("word_distance", F.when(long_ & F.col("r_n").isNotNull() & F.col("word_hist").isNotNull(), jensen_shannon(F.col("word_hist"), F.col("r_word"))))
    far = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance, F.lit(False))
    return j.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~far).alias("kept"))
