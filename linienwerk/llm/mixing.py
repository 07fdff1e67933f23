"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from linienwerk.llm.common import n_words, unused
from linienwerk.shared import Stash


def mix_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size) → (source, source_size, target)``.

    Sources in code point order, null last, weigh ``weights``, repeating. They
    share ``share`` times all sizes by weight; a target stops at ``most`` times
    its source's size and the excess goes to the others by weight, until none
    is above. That fixed point is a level L with target = min(cap, weight * L):
    sources with the smallest cap for their weight are full first, and L is
    what they leave divided by the weight of the others. One row per source.
    A source of size 0 has target 0.
    """
    if not 0 <= share <= most:
        raise ValueError("the share must be within what sources can give")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    s = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("weight"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("left", share * F.sum("source_size").over(Window.partitionBy()) - full).withColumn("heavy", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # the first source, in order of r, that stays below its cap sets the level; with none all are full
    s = s.withColumn("level", F.max(F.when(F.col("left") / F.col("heavy") <= F.col("r"), F.col("left") / F.col("heavy"))).over(Window.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """``docs → (doc_id, source, size, h, source_size, target, copies)``; a row per document, copies 0 and up.

    Every document of a source expects target / source_size copies. In the
    order of (size, doc_id) within the source, the expected copies are summed
    from one random offset (drawn from the seed and the source's name), and a
    document gets a copy for each integer that its sum crosses. Sorted by size
    the copies follow the sizes evenly, so the words taken stay within one
    largest document of the target.

    Rows are put in order over all partitions and written to the shared
    folder; a row's rank is its place in its partition plus the rows of its
    source in earlier ones, so no source needs a task of its own. Ties of size
    and doc_id are broken by a hash of the text; equal rows may each get their
    own number of copies; ``h`` is that hash. Null sources are one source; a
    null text has size 0, and documents of a source without words get no copy.
    Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "mix")
    key = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    key = stash.put(key)  # a range partitioning reads its input twice, and words are counted once
    placed = key.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col("source").asc_nulls_last(), "size", "doc_id", "h").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "doc_id", "h")
    placed = stash.put(placed.select("doc_id", "source", "size", "h", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("row")))
    targets = mix_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    # a row for each source in each partition: at most as many as there are partitions and sources together
    runs = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("row0"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("earlier", earlier).join(targets, runs["source"].eqNullSafe(targets["source"])).select(runs["source"].alias("s"), F.col("part").alias("p"), "row0", "earlier", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # sources and partitions both grow with the data: the hint holds for a table of some megabytes only
    runs = stash.put(runs)
    runs = F.broadcast(runs) if runs.count() <= 100_000 else runs
    ranked = placed.join(runs, placed["source"].eqNullSafe(F.col("s")) & (placed["part"] == F.col("p"))).withColumn("i", F.col("earlier") + F.col("row") - F.col("row0"))
    ranked = ranked.withColumn("u", offset).withColumn("rate", rate).withColumn("copies", F.least(F.ceil("rate"), F.floor((F.col("i") + 1) * F.col("rate") + F.col("u")) - F.floor(F.col("i") * F.col("rate") + F.col("u"))).cast("long"))
    return ranked.select("doc_id", "source", "size", "h", "source_size", "target", "copies")


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; equal rows share their copies evenly. Other columns may have any name."""
    m_id, m_h, m_copies, m_rows, m_key, m_n, m_k = (unused(docs, f"m_{c}") for c in ("id", "h", "copies", "rows", "key", "n", "k"))
    m = mixed.groupBy(F.col("doc_id").alias(m_id), F.col("h").alias(m_h)).agg(F.sum("copies").alias(m_copies), F.count("*").alias(m_rows)).where(F.col(m_copies) > 0)
    d = docs.withColumn(m_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    j = d.join(m, d["doc_id"].eqNullSafe(m[m_id]) & (d[m_key] == m[m_h]))
    k = F.row_number().over(Window.partitionBy("doc_id", m_key).orderBy(*docs.columns))
    part = lambda i: F.floor(F.col(m_copies) * i / F.col(m_rows))
    one = j.where(F.col(m_rows) == 1).select(*docs.columns, F.col(m_copies).alias(m_n))
    more = j.where(F.col(m_rows) > 1).withColumn(m_k, k).select(*docs.columns, (part(F.col(m_k)) - part(F.col(m_k) - 1)).alias(m_n))
    return one.unionByName(more).where(F.col(m_n) > 0).withColumn(m_n, F.explode(F.sequence(F.lit(1), F.col(m_n).cast("int")))).select(*docs.columns)
