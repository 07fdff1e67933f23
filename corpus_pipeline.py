"""From raw documents to packed training sequences, in stages that are each written and read again.

A stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of
``documents``; null texts and ids are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from linienwerk.llm.minhash import near_duplicates
from linienwerk.llm.mixing import mix_sources, take_copies
from linienwerk.llm.packing import pack_documents
from linienwerk.llm.quality_rules import quality_rules
from linienwerk.llm.suffix_dedup import dedup_repeats, kept_bytes
from linienwerk.shared import Stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; ids are keys, and rows without one go."""
    kept = quality_rules(docs).where("kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id; rows without an id go.

    An id comes back once: of several texts that lead a class, that with the
    smallest SHA-1, and of its rows the smallest by their other columns.
    """
    lead = near_duplicates(docs).where("doc_id = class_id").groupBy("doc_id").agg(F.min("sha").alias("lead_sha"))
    own = docs.select(*COLUMNS).join(lead, "doc_id").where(F.unhex(F.sha1("text")).eqNullSafe(F.col("lead_sha")))
    rest = F.struct(*COLUMNS[1:])
    return own.groupBy("doc_id").agg(F.min(rest).alias("row")).select("doc_id", "row.*").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus; texts of which no word is left go.

    A removed run is narrowed to whole characters, so that what is left is text.
    """
    found = dedup_repeats(docs.select(*COLUMNS))
    at = lambda i: F.conv(F.hex(F.substring("bytes", i.cast("int") + 1, 1)), 16, 10).cast("int")
    inner = lambda i: (i < F.octet_length("bytes")) & at(i).between(0x80, 0xBF)

    def whole(s):
        a, b = s["start"], s["start"] + s["length"]
        up = F.when(~inner(a), 0).when(~inner(a + 1), 1).when(~inner(a + 2), 2).otherwise(3)
        down = F.when(~inner(b), 0).when(~inner(b - 1), 1).when(~inner(b - 2), 2).otherwise(3)
        return F.struct((a + up).alias("start"), (b - down - a - up).alias("length"))

    cut = F.size("spans") > 0
    text = F.when(cut, kept_bytes(F.col("bytes"), F.transform("spans", whole)).cast("string")).otherwise(F.col("text"))
    left = found.select("doc_id", text.alias("text"), "lang", "source", F.when(~cut, F.col("n_chars")).alias("n_chars"), cut.alias("cut"))
    left = left.where(~F.col("cut") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", "text", "lang", "source", F.coalesce("n_chars", F.when(F.col("cut"), F.length("text").cast("long"))).alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return take_copies(docs.select(*COLUMNS), mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("MinHash near-dedup", minhash), ("suffix-array dedup", repeats), ("mixing sources", mix), ("packing", pack)]

#: Tokenising can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stash.put(stage(spark, docs, sf_dir))
        if k:  # what a stage has read goes once its own table is written
            stash.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
