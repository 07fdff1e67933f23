"""Keys that hold most rows, ids that stand for several texts, conversations of very many turns."""

import hashlib
import random
import time

import public_tokenizers
from pyspark.sql import functions as F

from linienwerk.llm import chat, minhash, packing, suffix_dedup

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_one_stray_member_visits_the_blocks_of_a_bucket(spark, monkeypatch):
    """A bucket of 8,000 copies and a stray one: the copies stand once, the stray once for each block."""
    n, seen = 8000, []
    members = spark.range(n).select(F.lit(1).cast("long").alias("key"), "id", F.lit(n).cast("long").alias("c"), F.lit(0).cast("long").alias("bytes"), F.when(F.col("id") == 77, 77).otherwise(0).cast("long").alias("label"))
    reps = spark.range(n).select("id", F.lit(b"x" * 512).alias("sig"))
    monkeypatch.setattr(minhash, "_by_blocks", lambda rows, run, schema: seen.append(rows) or rows)
    minhash.crossing_members(members, reps, 370)
    assert seen[0].count() == n - 1 + 8
    monkeypatch.undo()
    marked = minhash.crossing_members(members, reps, 370)
    assert marked.select("id").distinct().count() == n and marked.count() == n - 1 + 8


def test_rows_without_an_id_fill_several_groups(spark):
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 100), (F.col("id") % 7).cast("string")).alias("text"))
    pieces = packing.pack_documents(df, WORD, group_bytes=4 << 20)
    sizes = pieces.groupBy((F.col("sequence_id") / (1 << 31)).cast("int").alias("g")).agg(F.sum("length").alias("n"), F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))).alias("all")).collect()
    assert len(sizes) == 5 and max(r.n for r in sizes) < 1.1 * min(r.n for r in sizes)
    assert sum(r.n for r in sizes) == 40_000 * 102


def test_rows_without_a_text_fill_several_groups(spark):
    df = spark.range(20_000).select("id", F.lit(None).cast("string").alias("text")).withColumnRenamed("id", "doc_id")
    pieces = packing.pack_documents(df, WORD, group_bytes=1 << 15)
    assert pieces.select((F.col("sequence_id") / (1 << 31)).cast("int").alias("g")).distinct().count() == 5


def removed(texts):
    """Brute force: of each text the bytes that no 100-byte string starting earlier covers."""
    seen, out = set(), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            s = t[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def test_repeats_of_an_id_with_several_texts(spark):
    r = random.Random(1)
    passage = "".join(r.choices("abcdefgh ", k=180))
    rows = [(5, "x" + passage), (5, "y" + passage + "z"), (5, "y" + passage + "z"), (5, None), (2, passage), (None, passage), (9, "nothing"), (-1, None), (-1, "tail " + passage)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, num int, sha string").repartition(3)
    got = sorted((x.doc_id, x.text or "", bytes(x.kept), x.num, x.sha) for x in suffix_dedup.dedup_repeats(df).where("doc_id is not null").collect())
    order = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda x: (x[0], hashlib.sha1(x[1].encode()).hexdigest()))
    kept = dict(zip(order, removed([t.encode() for _, t in order]), strict=True))
    assert got == sorted((i, t or "", kept[i, t or ""], 1, "s") for i, t in rows if i is not None)
    assert [bytes(x.kept) for x in suffix_dedup.dedup_repeats(df).where("doc_id is null").collect()] == [passage.encode()]


def chat_of(spark, n):
    return spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é \\ said ### "), F.col("id").cast("string")).alias("text"))


def test_a_conversation_of_very_many_turns(spark):
    def took(n):
        t = time.time()
        r = chat.format_chat(chat_of(spark, n)).select(chat.masked_text(F.col("formatted"), F.col("spans")).alias("said"), F.size(chat.parse_chat(F.col("formatted"))).alias("n"), "n_turns").first()
        assert (r.n_turns, r.n) == (n, n) and r.said == "".join(f"é \\ said ### {k}" for k in range(1, n, 2))
        return time.time() - t

    took(8000)
    assert took(32_000) < 6 * max(1.0, took(8000))
