"""Edge cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import json
import random
import subprocess
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linienwerk.llm import chat, embed_dedup, minhash, mixing, packing, quality_rules, rule_ensemble, suffix_dedup, token_records, warc
from linienwerk.llm.tokens import PieceEncoder
from linienwerk.shared import drop_dir, fresh_dir, open_fs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string, kept string, target double"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), 1, "x", "y", 0.5) for r in rows], DOCS)


# --- 1: embeddings


def brute_links(vs, t=0.9):
    ids = [i for i, v in vs if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in vs if i in ids}
    return {i: {j for j in ids if j != i and len(m[i]) == len(m[j]) and m[i] @ m[j] >= t} if i in m else set() for i, _ in vs}


def test_embeddings(spark):
    r = np.random.default_rng(0)
    centre = r.standard_normal((6, 16))
    vs = [(k, [float(x) for x in centre[k % 6] + r.standard_normal(16) * (0.12 if k % 3 else 0.9)]) for k in range(300)]
    vs += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in vs], "vec_id long, embedding array<double>, n_links int, component_id string")
    got = {x.vec_id: x for x in embed_dedup.embedding_duplicates(df, block=40).collect()}
    want = brute_links([v for v in vs if v[0] < 905])
    assert len(got) == len(vs)
    found = sum(x.n_links for x in got.values())
    assert 0.9 * sum(map(len, want.values())) <= found <= sum(map(len, want.values()))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert all(got[i].n_links <= len(want[i]) for i, _ in vs if i < 900)
    assert all(got[i].component_id <= i and (got[i].kept == (got[i].component_id == i)) for i in got)


def around_mean(n, dim, norm, seed=3):
    """n unit vectors with a mean of the given norm, and a partner at cosine 0.9 of each with the same share of the mean."""
    r = np.random.default_rng(seed)
    g, h = r.standard_normal((2, n, dim - 1))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    h -= (h * g).sum(1, keepdims=True) * g
    h /= np.linalg.norm(h, axis=1, keepdims=True)
    rest = 1 - norm**2
    c = (0.9001 - norm**2) / rest
    with_mean = lambda v: np.concatenate((np.full((n, 1), norm), v * rest**0.5), 1)
    return with_mean(g), with_mean(c * g + (1 - c * c) ** 0.5 * h)


def test_embeddings_with_a_strong_mean(spark):
    x, y = around_mean(1500, 64, 0.85)
    v = np.concatenate((x, y))
    df = spark.createDataFrame([(k, e) for k, e in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    found = embed_dedup.embedding_duplicates(df).agg(F.sum("n_links")).first()[0]
    want = int((v @ v.T >= 0.9).sum()) - len(v)
    assert want >= 3000 and 0.9 * want <= found <= want


def test_tables_of_a_million_vectors():
    """17 bits, as for 1M rows, and a mean of norm 0.7: pairs that the tables weren't set by."""
    x, y = around_mean(3000, 64, 0.7)
    rotations, tables = embed_dedup.learn_tables(x, 17, 0.9, 0.97)
    u, v = around_mean(2000, 64, 0.7, seed=4)
    code = lambda z: np.concatenate([((z - mean) @ r >= 0)[:, : 64 // 17 * 17] for mean, r in rotations], 1)
    same = (code(u) == code(v)).reshape(len(u), -1, 17).all(2)[:, :tables]
    assert same.any(1).mean() >= 0.9 > same[:, : embed_dedup.n_tables(17, 0.9, 0.97)].any(1).mean()


def test_embeddings_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert embed_dedup.embedding_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [2.0, 0.001]), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    got = sorted(((x.vec_id, x.n_links, x.component_id) for x in embed_dedup.embedding_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (7, 0, 7), (None, 0, None)], key=str)


def test_embeddings_of_all_lengths_and_copies(spark):
    """Vectors of each length are compared, copies count as many, and scaled copies are found."""
    r = np.random.default_rng(4)
    vs = [(k, r.standard_normal(8).tolist()) for k in range(60)] + [(100 + k, r.standard_normal(3).tolist()) for k in range(40)] + [(200 + k, [1.0, 0.0]) for k in range(30)]
    vs += [(300, [2.0, 0.0]), (301, [1.0, 0.01]), (302, [5.0]), (303, [3.0]), (304, [-3.0])] + [(400 + k, vs[0][1]) for k in range(50)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").repartition(5)
    want = brute_links(vs)
    for block in (7, 20, 1024):
        got = {x.vec_id: x for x in embed_dedup.embedding_duplicates(df, block=block).collect()}
        if block == 1024:  # then all of a length are compared
            assert {i: x.n_links for i, x in got.items()} == {i: len(w) for i, w in want.items()}
        assert all(got[i].component_id == 200 and got[i].n_links == 31 for i in (200, 229, 300, 301)) and got[303].component_id == 302 and got[304].n_links == 0
        assert all(got[400 + k].component_id == 0 and got[400 + k].n_links >= 50 for k in range(50))


def test_embeddings_recall(spark):
    """Pairs planted at cosines from 0.90 to 0.93 among unrelated vectors, by brute force."""
    r = np.random.default_rng(6)
    x = r.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.standard_normal((2000, 64))
    side -= (side * x[:2000]).sum(1, keepdims=True) * x[:2000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(0.9001, 0.93, (2000, 1))
    v = np.concatenate((x, c * x[:2000] + np.sqrt(1 - c * c) * side))
    df = spark.createDataFrame([(k, e) for k, e in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    began = time.time()
    found = embed_dedup.embedding_duplicates(df).agg(F.sum("n_links")).first()[0]
    want = int((v @ v.T >= 0.9).sum()) - len(v)
    print("recall", found / want, "seconds", time.time() - began)
    assert want >= 4000 and 0.95 * want <= found <= want


# --- 2: WARC

PAGES = "page_id long, url string, html string, first long, kind int"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\n%x", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (1, "u", "é" * 40), (None, "n", "same"), (7, "u", sentence(1, 20000)), (7, "u", "other")]
    df = spark.createDataFrame([(*r, 99, 9) for r in rows], PAGES)
    out = fresh_dir(spark, "w")
    m = warc.write_warc(df, out, shard_bytes=200, roll_bytes=300)
    got = warc.read_warc(m, out).collect()
    assert sorted((x.page_id is None, x.page_id or 0, x.payload_bytes) for x in got) == sorted((i is None, i or 0, len((h or "").encode())) for i, _, h in rows)
    by = {(x.page_id, x.payload_bytes): x for x in got}
    assert by[3, 4].record_type == "response" and by[5, 4].record_type == "revisit" and by[5, 4].refers_to == 3 and by[5, 4].url == "http://a/\r\n%x"
    assert by[8, 0].record_type == "response" and by[9, 0].refers_to == 8 and by[None, 4].record_type == "response"
    assert by[1, 80].html == "é" * 40 and by[7, 5].html == "other"
    assert m.agg(F.sum("n_records")).first()[0] == len(rows) and m.count() > 2


def test_warc_repeated_id(spark):
    """Of the rows of an id only those whose payload stood before are revisits; each refers to its own payload's page."""
    rows = [(1, "a", "one"), (2, "b", "two"), (5, "c", "one"), (5, "d", "unique"), (5, "e", "two"), (6, "f", "alone")]
    out = fresh_dir(spark, "w")
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), out), out).collect()
    want = {("a", "response", None, "one"), ("b", "response", None, "two"), ("c", "revisit", 1, None), ("d", "response", None, "unique"), ("e", "revisit", 2, None), ("f", "response", None, "alone")}
    assert {(x.url, x.record_type, x.refers_to, x.html) for x in got} == want and len(got) == len(rows)


def test_warc_is_deterministic(spark):
    rows = [(k, f"u{k}", sentence(k % 7, 60)) for k in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for n in (1, 5):
        out = fresh_dir(spark, "w")
        m = warc.write_warc(df.repartition(n), out, shard_bytes=4000, roll_bytes=1500)
        system, root = open_fs(out)
        seen.append({x.name: system.open_input_file(f"{root}/{x.name}").read() for x in m.collect()})
        for data in seen[-1].values():
            assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert seen[0] == seen[1] and len(seen[0]) > 3


def test_warc_empty(spark):
    out = fresh_dir(spark, "w")
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES), out), out).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100])
def test_shard_of(spark, n):
    bounds = sorted(random.Random(n).sample(range(1000), n))
    df = spark.range(0, 1001, 7).select("id", warc.shard_of(F.col("id"), bounds).alias("s"))
    assert all(r.s == sum(b <= r.id for b in bounds) for r in df.collect())


# --- 3: mixing


def test_mix_targets(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}
    got = {r.source: r.target for r in mixing.mix_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    full, left = {}, 1.5 * sum(sizes.values())
    while True:
        level = left / sum(w for s, w in weight.items() if s not in full)
        over = [s for s in weight if s not in full and weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(full.values())
    assert got == pytest.approx({s: full.get(s, weight[s] * level) for s in weight})


def test_mix_sources(spark):
    rows = [(k, sentence(k, 5 + k % 90), "en", "s%d" % (k % 3 if k % 5 else 0)) for k in range(400)] + [(500, None, "en", None), (501, "", "en", "s0"), (None, "x y", "en", "s1"), (3, sentence(3, 8), "en", "s0"), (3, sentence(3, 8), "en", "s0")]
    df = docs(spark, rows)
    m = mixing.mix_sources(df)
    got = m.collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= max(r.size for r in mine)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mixing.take_copies(df, m)
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in got)
    clash = df.withColumns({c: F.lit(1) for c in ("m_id", "M_H", "m_n", "m_k", "m_key", "m_rows", "m_copies")})
    assert mixing.take_copies(clash, mixing.mix_sources(clash)).count() == sum(r.copies for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


# --- 4 and 7: tokens

TEXTS = ["a  b", "a\n\n b", " x", "x ", "foo\n bar", "foo \nbar", "I'm 'll it's<|endoftext|> ok", "a\t b", "", " ", "é ́x Ω٣", "Ünï cödé.\nNext|x", "1234 x9", " a  b", "a\x1c b", "a \x00 b", sentence(4, 3000), None]


@pytest.mark.parametrize(("path", "cut"), [(BYTE, "byte"), (WORD, "word"), (WORD, "none")])
def test_pieces_equal_whole_texts(path, cut):
    e = PieceEncoder(path, cut)
    for got in (e.many(TEXTS), e.many(TEXTS)):
        for t, g in zip(TEXTS, got, strict=True):
            assert np.frombuffer(g, e.dtype).tolist() == (e.tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("path", "cut"), [(BYTE, "byte"), (WORD, "word"), (WORD, "none")])
def test_pieces_equal_the_library(path, cut):
    """Against a tokenizer as the library loads it, also where a text holds an added token's string."""
    fresh = Tokenizer.from_file(path)
    texts = [*TEXTS, "<|endoftext|>", "a<|endoftext|>b", "a <|EndOfText|> b", "x <|startoftext|> y <|endoftext|>"]
    e = PieceEncoder(path, cut)
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    for got in (e.many(texts), e.many(texts)):
        assert [np.frombuffer(g, e.dtype).tolist() for g in got] == want


def whole_ids(path, text, end):
    t = PieceEncoder(path, "none").tokenizer
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_records(spark):
    rows = [(k * 3 % 50, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (7, "again"), (7, "again")]
    out = fresh_dir(spark, "t")
    m = token_records.write_token_records(docs(spark, rows), out, BYTE, roll_bytes=2000, part_bytes=8000)
    got = token_records.read_token_records(m, out).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, g in zip(order, sorted(got, key=lambda g: g.start), strict=True):
        ids = whole_ids(BYTE, r[1], 0)
        assert (g.doc_id, g.start, g.n_tokens) == (r[0], at, len(ids)) and np.frombuffer(g.ids, "<u4").tolist() == ids
        at += len(ids)
    first = m.where("extra <> 'index'").first()
    assert token_records.fetch_record(out, first.name, first.n_records - 1)[1] > 0
    system, root = open_fs(out)
    data = bytearray(system.open_input_file(f"{root}/{first.name}").read())
    data[15] ^= 1
    with system.open_output_stream(f"{root}/{first.name}") as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        token_records.read_token_records(m, out).collect()
    drop_dir(out)
    out = fresh_dir(spark, "t")
    assert token_records.read_token_records(token_records.write_token_records(docs(spark, []), out, BYTE), out).count() == 0


def test_masked_checksum():
    c = zlib.crc32(b"abc")
    assert token_records.masked(b"abc") == (((c >> 15) | (c << 17 & 0xFFFFFFFF)) + 0xA282EAD8) % 2**32


def test_packing(spark):
    rows = [(k, sentence(k, 1 + k * 37 % 900)) for k in range(60)] + [(100, None), (101, ""), (None, "null id"), (5, "twice"), (5, "twice"), (102, sentence(9, 4000))]
    got = packing.pack_documents(docs(spark, rows), WORD, limit=512, group_bytes=60000).collect()
    seq, doc = {}, {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 512 or at & (at - 1) == 0
    want = {}
    for i, t in rows:
        ids = whole_ids(WORD, t, 2)
        want.setdefault((i, len(ids)), []).extend(ids)
    for key, ids in want.items():
        assert sorted(x for s, p in sorted(doc[key]) for x in p) == sorted(ids)
    assert packing.padding(spark.createDataFrame(got), 512).first().n_padding == 0
    assert packing.pack_documents(docs(spark, []), WORD).count() == 0


def test_packing_balances_cost():
    r = random.Random(1)
    lengths = [r.randint(1, 500) for _ in range(300)]
    out = packing.assign(lengths, 512, 1.0, 0.01)
    cost = {}
    for _, _, n, k, _ in out:
        cost[k] = cost.get(k, 0) + n + 0.01 * n * n
    full = [cost[k] for k in range(sum(lengths) // 512)]
    first_fit = sorted(lengths, reverse=True)
    assert max(full) <= first_fit[0] + 0.01 * first_fit[0] ** 2 + 512 + 0.01 * 512**2
    assert sum(n for *_, n, _, _ in out) == sum(lengths)


# --- 5: MinHash


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    e = r.integers(0, 2**63, 400).astype(np.uint64)
    w1, w2 = r.uniform(0.2, 3, 400), r.uniform(0.2, 3, 400)
    w2[:200] = w1[:200]
    a, b = minhash.dart_signature(e, w1, 2048), minhash.dart_signature(e, w2, 2048)
    assert abs((a == b).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05


def test_near_duplicates(spark):
    words = sentence(1, 300).split()
    rows = [(10, " ".join(words)), (4, " ".join(words)), (40, " ".join(words[:150] + ["zz"] + words[151:])), (41, " ".join(words[:100]) + "\n" + " ".join(words[100:])), (50, sentence(77, 300)), (60, None), (61, ""), (62, ""), (63, "one two"), (64, "one two"), (65, " \n")]
    # near copies of one text: each close to it, not to each other
    base = sentence(5, 400).split()
    for k in range(60):
        w = list(base)
        for i in range(6):
            w[(k * 61 + i * 67) % 400] = f"q{k}x{i}"
        rows.append((200 + k, " ".join(w)))
    rows += [(999, " ".join(base)), (None, "x"), (50, sentence(77, 300))]
    got = {}
    for r in minhash.near_duplicates(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[10] == got[4] == got[40] == got[41] == {4} and got[50] == {50}
    assert got[60] == {60} and got[61] == {61} and got[62] == {62} and got[65] == {65} and got[63] == got[64] == {63} and got[None] == {None}
    assert all(got[200 + k] == {200} for k in range(60)) and got[999] == {200}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_of_an_id_with_two_texts(spark):
    one, two = sentence(1, 60), sentence(2, 60)
    got = minhash.near_duplicates(docs(spark, [(1, one), (1, two), (0, two), (7, one + " x"), (8, two + " y")])).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 0), (1, 1), (7, 1), (8, 0)]


@pytest.mark.parametrize("block", [8, 1024])
def test_crossing_links_join_what_brute_force_joins(spark, block):
    """A group around the threshold: classes are those of all pairs, and no more links come than members of two blocks."""
    r = random.Random(3)
    base = sentence(5, 200).split()
    rows = []
    for k in range(50):
        w = list(base)
        for i in r.sample(range(200), r.randint(1, 7)):
            w[i] = f"q{k}x{i}"
        rows.append((k, " ".join(w)))
    signed = minhash.sign(docs(spark, rows))
    reps = signed.withColumn("id", F.col("doc_id")).cache()
    members = minhash.buckets(reps).withColumn("label", F.col("id"))
    texts = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    marked = minhash.crossing_members(members, reps, 370, block=block).cache()
    links = [tuple(x) for x in minhash.crossing_links(marked, texts, 0.8, 5).collect()]
    sets = {k: minhash.shingles(t.encode(), 5) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and minhash.similarity(sets[a], sets[b]) >= 0.8]

    def classes(edges):
        up = {k: k for k in sets}
        for _ in sets:
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert set(links) <= set(pairs) and classes(links) == classes(pairs) and len(set(classes(pairs).values())) > 1
    assert len(links) <= marked.count()


# --- 6: quality rules


def brute_repeat(text, width=8):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    seen, hit = {}, [False] * len(w)
    for i in range(len(w) - width + 1):
        seen.setdefault(tuple(w[i : i + width]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                hit[p : p + width] = [True] * width
    return len(w), sum(hit)


def test_quality_counts(spark):
    texts = [None, "", " \n\t ", "a", "a b c d e f g h", " ".join(["x"] * 9), "a b c d e f g h\n" * 3, sentence(1, 40) + " " + sentence(1, 40), sentence(2, 3000) + "\n" + sentence(2, 10) + " " + sentence(2, 20), "#* $%\n&|<>\n#* $%", "ü\x0bv\x1cw x"]
    got = {r.doc_id: r for r in quality_rules.document_stats(docs(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        n, rep = brute_repeat(t)
        g = got[k]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (g.n_words, g.n_repeat_words, g.n_dup_lines) == (n, rep, len(lines) - len(set(lines))), t
        assert g.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert g.word_chars == sum(c not in " \t\n\x0b\x0c\r" for c in t or "")


def test_quality_verdict(spark):
    good = "the cat of the house is on it and he was with a dog by the sea for that is as it was in this"
    rows = [(k, " ".join(random.Random(k).sample((good + " ").split() * 6, 110)), "en") for k in range(30)]
    rows += [(100, " ".join(["XQZ!!"] * 20 + [f"ZZ{k}!!" for k in range(90)]), "en"), (101, "short text", "en"), (102, None, None), (103, "a b c d e f g h i j " * 30, "en"), (104, rows[0][1], None), (104, rows[0][1], None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert all(got[k].kept for k in range(30)) and got[104].kept and got[104].char_distance is None
    assert not got[100].kept and not got[100].base_failed and got[101].base_failed and got[102].base_failed and got[103].base_failed
    assert quality_rules.quality_rules(docs(spark, [])).count() == 0
    same = spark.range(1).select(quality_rules.jensen_shannon(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))).alias("z"), quality_rules.jensen_shannon(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("o")).first()
    assert same.z == 0 and same.o == pytest.approx(1)


# --- 8: chat

SAYS = [r"\### Assistant: </turn> ok", "plain", "", None, "### User: hi", "</turn>\n### assistant: no", "\\", "a\\#b", "#\\##", "<\\/turn>", "</turn", " </turn>\n", "####", "é\n\n"]


def test_chat_round_trip(spark):
    roles = ["user", "assistant", "a: b", None, "x:", "### s", "</turn>"]
    rows = [(k % 4, k, roles[k % len(roles)], SAYS[k % len(SAYS)], "f") for k in range(56)] + [(None, 1, "user", "n", "f"), (9, None, "assistant", "later", "f"), (9, None, "assistant", "later", "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    f = chat.format_chat(df)
    got = {r.conv_id: r for r in f.select("conv_id", "n_turns", "formatted", chat.parse_chat(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("spans")).alias("m")).collect()}
    assert len(got) == 6
    for c, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0))]
        assert [(t.role, t.text) for t in r.t] == want and r.n_turns == len(want)
        assert r.m == "".join(t for role, t in want if role == "assistant")
    assert "### user: plain </turn>\n" in "".join(r.formatted for r in got.values()) or "plain" in "".join(r.formatted for r in got.values())
    assert chat.format_chat(df.limit(0)).count() == 0


# --- 9: classifier


def test_rules_from_trees():
    dump = "Tree 0:\n  If (feature 1 <= 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.0\n   Else (feature 0 > 2.0)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0\n"
    assert rule_ensemble.tree_rules(dump) == {((1, "<=", 0.5),), ((0, "<=", 2.0), (1, "<=", 0.5)), ((0, ">", 2.0), (1, "<=", 0.5)), ((1, ">", 0.5),)}


def test_classifier(spark):
    rows = [(k, sentence(k, 60) if k % 3 else sentence(k, 60).upper().replace(" ", "!! ")) for k in range(240)] + [(900, None), (901, ""), (None, "x"), (5, sentence(5, 60))]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.classify_quality(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held if r.doc_id < 240) >= 0.95 * len([r for r in held if r.doc_id < 240])
    none = rule_ensemble.classify_quality(docs(spark, rows[:3]), labels.limit(0)).collect()
    assert all(r.score == 0.5 for r in none)
    assert rule_ensemble.classify_quality(docs(spark, []), labels).count() == 0


# --- 10: repeats


def brute_repeats(rows, w):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cov = np.zeros(len(b), bool)
        for k in range(len(b) - w + 1):
            if b[k : k + w] in seen:
                cov[k : k + w] = True
            seen.add(b[k : k + w])
        out[i] = cov
    return out


@pytest.mark.parametrize("width", [24, 100])
def test_repeats(spark, width):
    r = random.Random(width)
    shared = [sentence(k, 40) for k in range(4)] + ["é" * 60, "a" * 150]
    rows = [(k, " ".join(r.choice(shared) if r.random() < 0.4 else sentence(100 + k * 10 + j, r.randint(1, 20)) for j in range(r.randint(0, 9)))) for k in range(40)]
    rows += [(90, None), (91, ""), (92, rows[3][1]), (93, "b" * 5000), (94, rows[5][1] + rows[5][1])]
    got = {x.doc_id: x for x in suffix_dedup.dedup_repeats(docs(spark, [*rows, rows[7], (None, shared[0])]), width).collect()}
    assert got[None].kept.decode() == shared[0]
    for i, cov in brute_repeats(rows, width).items():
        text = (dict(rows)[i] or "").encode()
        mask = np.zeros(len(text), bool)
        for s in got[i].spans:
            mask[s.start : s.start + s.length] = True
        assert (mask == cov).all() and got[i].kept == bytes(np.frombuffer(text, np.uint8)[~cov])
        assert all(a.start + a.length < b.start for a, b in zip(got[i].spans, got[i].spans[1:], strict=False))


def test_repeats_edge(spark):
    assert suffix_dedup.dedup_repeats(docs(spark, [])).count() == 0
    # nothing repeats, neither within a part nor across parts
    alone = suffix_dedup.dedup_repeats(docs(spark, [(k, sentence(k, 50)) for k in range(6)]).repartition(3)).collect()
    assert all(not r.spans and r.kept == r.bytes for r in alone) and len(alone) == 6
    # an id that stands for two texts: both come back, see test_hot_keys
    assert sorted(x.kept for x in suffix_dedup.dedup_repeats(docs(spark, [(1, "a"), (1, "b")])).collect()) == [b"a", b"b"]


@pytest.mark.parametrize("hot_kinds", [2, 1 << 14])
def test_repeats_of_hot_passages(spark, hot_kinds):
    """A passage in surroundings that all differ, and a text with many copies: the same spans whether the pieces are dealt out by window or not."""
    hot, whole = sentence(7, 30), sentence(8, 60)
    rows = [(k, f"{sentence(100 + k, 9)} {hot} {sentence(300 + k, 9)}") for k in range(60)] + [(100 + k, whole) for k in range(60)]
    df = docs(spark, rows).repartition(8)
    covered = {k: np.zeros(len(t.encode()), bool) for k, t in rows}
    for x in suffix_dedup.covered_spans(df, bucket_bytes=1 << 10, hot_kinds=hot_kinds).collect():
        covered[x.doc_id][x.start : x.start + x.length] = True
    for k, cov in brute_repeats(rows, 100).items():
        assert (cov == covered[k]).all(), k


def test_repeats_in_slices(spark, monkeypatch):
    """Texts longer than a chunk are cut in slices, and no window is lost between them."""
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 300)
    p = sentence(1, 200)
    rows = [(1, p), (2, sentence(2, 100) + p + p[:500]), (3, "ab" * 700)]
    slices = [x for b in [pa.RecordBatch.from_pylist([{"doc": k, "text": t} for k, t in rows])] for s, _ in suffix_dedup._chunks(iter([b]), 100) for x in s]
    assert max(len(x[2]) for x in slices) == 399 and sum(len(x[2]) - 99 for x in slices) == sum(len(t) - 99 for _, t in rows)
    got = {x.doc_id: sum(s.length for s in x.spans) for x in suffix_dedup.dedup_repeats(docs(spark, rows)).collect()}
    assert got == {k: int(c.sum()) for k, c in brute_repeats(rows, 100).items()}


def test_repetitive_text_in_little_memory():
    """8 MB of one letter: the peak of a worker that asks and answers is below 1 GB."""
    code = """
import resource, pyarrow as pa
from linienwerk.llm import suffix_dedup as s
class Frame:
    def mapInArrow(self, f, schema):
        b = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a" * (8 << 20)}])
        self.rows = [r for out in f(iter([b])) for r in out.to_pylist()]
        return self
    def groupBy(self, c):
        return self
    def applyInArrow(self, f, schema):
        return f((0,), pa.Table.from_pylist(self.rows, schema=s._BLOB)).to_pylist()
got = s._asked(Frame(), 100, 1, 1 << 14, False)
print(len(got), max(x["start"] + x["length"] for x in got), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    rows, end, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout.split())
    assert end == 8 << 20 and rows < 20 and mb < 1000, (rows, mb)


def test_repeats_clashing_columns(spark):
    df = docs(spark, [(1, sentence(1, 50)), (2, sentence(1, 50))]).withColumns({"of_doc": F.lit(5), "S_ID": F.lit("x"), "isle": F.lit(1), "start": F.lit(2), "spans": F.lit(0)})
    got = {r.doc_id: r for r in suffix_dedup.dedup_repeats(df).collect()}
    assert not got[1].spans and got[2].kept == b"" and got[1].of_doc == 5 and got[2].S_ID == "x" and got[1].start == 2


def test_repeat_groups(spark):
    p = sentence(3, 60)
    whole = sentence(9, 40)
    rows = [(1, sentence(1, 5) + p), (2, p + sentence(2, 5)), (3, "x" + p + "y"), *((10 + k, whole) for k in range(4))]
    found = suffix_dedup.repeat_groups(docs(spark, rows)).collect()
    up = {g.group_id: g.parent_id for g in found}
    groups = {}
    for g in found:
        name = g.group_id
        groups.setdefault(name, (g.length, []))[1].append((g.doc_id, g.start))
        while up.get(name) is not None:  # an occurrence counts for the groups above, too
            name = up[name]
            if name in up:
                groups.setdefault(name, (next(x.length for x in found if x.group_id == name), []))[1].append((g.doc_id, g.start))
    text = {d: t.encode() for d, t in rows}
    for n, places in groups.values():
        assert len(places) == len(set(places)) > 1 and len({text[d][s : s + n] for d, s in places}) == 1
        # with all occurrences
        want = {(d, s) for d, t in text.items() for s in range(len(t) - n + 1) if t[s : s + n] == text[places[0][0]][places[0][1] : places[0][1] + n]}
        assert set(places) == want
    covered = {d: set() for d, _ in rows}
    for n, places in groups.values():
        for d, s in places:
            covered[d].update(range(s, s + n))
    assert all(len(c) == (len(whole.encode()) if d >= 10 else len(p.encode())) for d, c in covered.items())


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    r = random.Random(0)
    common = "the of and to in a is that for it as was with be by on not he this are".split()
    text = lambda k, n: " ".join(x if r.random() < 0.6 else r.choice(common) for x in sentence(k, n).split())
    rows = [(k, text(k, 150), "en", f"s{k % 3}", 0) for k in range(40)]
    passage = sentence(1234, 60)
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1].replace(" ", "\n", 1), "en", "s1", 0), (102, text(5, 100) + " é" + passage, "en", "s0", 0), (103, text(6, 100) + " ü" + passage, "en", "s1", 0), (104, "too short", "en", "s0", 0), (105, None, None, None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    d = spark.read.parquet(path)
    kept = c.quality(spark, d, "")
    assert {x.doc_id for x in kept.select("doc_id").collect()} == {x[0] for x in rows} - {104, 105}
    near = c.minhash(spark, kept, "")
    assert {x.doc_id for x in near.select("doc_id").collect()} == {x[0] for x in rows} - {100, 101, 104, 105}
    cut = {x.doc_id: x for x in c.repeats(spark, near, "").collect()}
    assert len(cut) == 42 and passage[1:] not in cut[103].text and passage in cut[102].text and cut[103].n_chars == len(cut[103].text)
    assert list(c.mix(spark, near, "").columns) == list(c.COLUMNS)
    out = c.run(spark, str(tmp_path))
    assert out.count() > 0
    json.dumps(out.schema.jsonValue())


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long, of_doc int, m_id string"
    for name, rows in (("none", []), ("odd", [(None, "a", None, None, None, 1, "x"), (1, None, None, None, None, 1, "x"), (2, "", "en", None, 0, 1, "x"), (2, "", "en", None, 0, 1, "x"), (3, "a " * 40000, "en", "s", 1, 1, "x")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert c.run(spark, str(tmp_path / name)).count() == 0
    # one id with two texts, the second of them a copy of an earlier document
    one, two = sentence(1, 60), sentence(2, 60)
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (0, two, "en", "s", 1), (1, one, "de", "s", 1)]
    got = c.minhash(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in got) == [(0, two, "en"), (1, one, "de")]
