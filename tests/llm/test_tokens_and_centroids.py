"""Operators 11 to 13 against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from linienwerk.llm import centroids, token_counts, token_links

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Ends of words, white space of all kinds, marks, characters of several scripts and Unicode versions, and strings that mean something to a tokenizer.
ODD = [*"abcXYZ019  \n\n\t\r.,!?'sé 　\x1c\x85\x1fßфあ漢字😀́​\x00²Ⅷ▁", "<|endoftext|>", "<s>", "<0x41>", "'re", "'ll", "  ", " the", " and", chr(0x1C89), chr(0x16D40), chr(0x2EBF0), chr(0x1E5D0)]


def odd_texts(n, seed=1, longest=90):
    r = random.Random(seed)
    out = ["".join(r.choices(ODD, k=r.randint(0, longest))) for _ in range(n)]
    anything = lambda: chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x110000)]))
    return [t + "".join(anything() for _ in range(8)) if k % 3 == 0 else t for k, t in enumerate(out)]


def prose(n, seed=2):
    r = random.Random(seed)
    words = ["the", "and", "station", "Zürich", "naïve", "lines", "of", "x1", "quay,", "stop.", "\n"]
    return [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(n)]


# --- 11: links of tokens


def brute_links(texts):
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    vocab = {k: t for t, k in a.get_vocab().items()}
    byte = {c: k for k, c in enumerate(token_counts.byte_letters())}
    of_a = lambda k: bytes(byte[c] for c in vocab[k])
    of_b = lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    rows, docs_with = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(map(of_a, x)) != raw or b"".join(map(of_b, y)) != raw:
            rows.append(([], Counter(), ""))
            continue
        ends_a, ends_b = np.cumsum([len(of_a(k)) for k in x]), np.cumsum([len(of_b(k)) for k in y])
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            n, m = int(np.searchsorted(ends_a, e)) + 1, int(np.searchsorted(ends_b, e)) + 1
            groups.append((x[i:n], y[j:m]))
            i, j = n, m
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        docs_with.update(links.keys())
        said = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        rows.append((groups, links, hashlib.sha256(said.encode()).hexdigest()))
    most = Counter()
    for (p, _), n in docs_with.items():
        most[p] = max(most[p], n)
    return [
        (sum(len(g) for g, _ in gs), sum(len(h) for _, h in gs), len(gs), sum(ls.values()), sum(m for (p, q), m in ls.items() if docs_with[p, q] == most[p]), sum(m * docs_with[l] for l, m in ls.items()), s) for gs, ls, s in rows
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("block", "unit"), [(1 << 22, 1 << 19), (400, 60)])
def test_links_equal_brute_force(spark, block, unit):
    texts = [None, "", " ", "  ", "\n", "a", "same text", "same text", *odd_texts(150), *prose(60), " ".join(prose(40, 5))]
    df = spark.createDataFrame([(k, t, 1, "b") for k, t in enumerate(texts)], "doc_id long, text string, block int, link string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in token_links.link_tokens(df, BYTE, PIECE, block=block, unit=unit).collect()}
    assert [got[k] for k in range(len(texts))] == brute_links(texts)


def test_links_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "one two"), (4, "one two"), (4, "one two"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in token_links.link_tokens(df, BYTE, PIECE).collect())
    assert got == [(-1, 2, 6), (4, 0, 0), (4, 2, 6), (4, 2, 6)]
    assert token_links.link_tokens(df.limit(0), BYTE, PIECE).count() == 0


def test_long_words_of_the_second_vocabulary():
    """A word beyond the length at which it is cut is encoded as the library does."""
    r = random.Random(4)
    word = "".join(r.choice("漢字あé😀\nabc,") for _ in range(90_000))
    m = token_links.PieceModel.of(PIECE)
    assert m.many([" " + word])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECE).encode(word)


def test_parts_join_to_the_text():
    t = " ".join(prose(400, 6))
    cut = token_links.parts(t, 500)
    assert len(cut) > 10 and "".join(cut) == " " + t


def test_a_group_of_many_tokens_gives_no_pairs():
    """Two thousand equal tokens on each side without a common end are one link, two thousand times two thousand times."""
    import pyarrow as pa

    n = 2000
    a, b = pa.table({"id": pa.array([7] * n)}), pa.table({"id": pa.array([9] * n)})
    t = token_links._links(a, b, np.zeros(n, np.int64), np.zeros(n, np.int64), np.array([n]), np.array([n]), np.zeros(1, np.int32))
    assert t.to_pylist() == [{"part": 0, "pair": 7 << 32 | 9, "m": n * n}]


# --- 12: token counts


def test_counts_equal_the_library(spark):
    texts = [None, "", *odd_texts(3000, 7), *prose(100), "ab " * 200_000, " " * 100_001 + "x", "a" * 100_000]
    df = spark.createDataFrame([(k % 3000 if k % 5 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    t = Tokenizer.from_file(BYTE)
    got = token_counts.count_tokens(df.withColumnRenamed("n_tokens", "k"), BYTE, 1024, keep=("doc_id", "k")).collect()
    assert {r.k: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {k: (len((x or "").encode()), n, n > 1024) for k, x in enumerate(texts) for n in [len(t.encode(x or "", add_special_tokens=False).ids)]}
    assert token_counts.count_tokens(df, BYTE, 1024).count() == len(texts)
    assert token_counts.count_tokens(df.limit(0), BYTE, 1024).count() == 0


def test_windows_give_the_same_pieces():
    shortcut, t = token_counts.prove(BYTE), Tokenizer.from_file(BYTE)
    small = token_counts.Counter(BYTE, shortcut, max_rest=50, window=11)
    assert all(small(x) == len(t.encode(x, add_special_tokens=False).ids) for x in odd_texts(1500, 8))


def test_proof_is_of_whole_pre_tokens():
    shortcut, t = token_counts.prove(BYTE), Tokenizer.from_file(BYTE)
    assert len(shortcut.whole) > 40_000 and shortcut.added == ("<|endoftext|>",)
    assert all(len(e.ids) == 1 for e in t.encode_batch(sorted(shortcut.whole), add_special_tokens=False))
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.prove(public_tokenizers.path("word_bpe_49k.json"))


# --- 13: centroids


def brute_clusters(rows, k, rounds, dims, scale):
    vs = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(vs, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = {}
        for _, v in vs:
            of.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if j in of else m for j, m in enumerate(c)]
    last = [(i, *near(v)) for i, v in vs]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i is None, i or 0, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in last))


@pytest.mark.parametrize(("n", "k", "dims"), [(400, 12, 8), (5, 12, 8), (300, 7, 2)])
def test_clusters_equal_brute_force(spark, n, k, dims):
    r = np.random.default_rng(n)
    centre = r.standard_normal((9, dims)) * 0.02
    rows = [(i, [float(x) for x in centre[i % 9] + r.standard_normal(dims) * (0.01 if dims > 2 else 0.004)]) for i in range(n)]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(900, None), (901, []), (902, [float("nan")] * dims), (903, [None] * dims), (904, [float("inf")] * dims), (905, [0.1] * (dims + 1)), (906, [0.0] * dims)]
    df = spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string").repartition(3)
    got = centroids.cluster_vectors(df, dims=dims, k=k).collect()
    assert sorted((g.vec_id is None, g.vec_id or 0, g.cluster, g.distance, g.cluster_inertia, g.inertia, g.centroid_sha256) for g in got) == brute_clusters(rows, k, 5, dims, 256)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(df).collect() == [] and centroids.cluster_vectors(df.limit(0)).collect() == []


def test_bounds_save_work_and_lose_nothing():
    """A bound by total displacement is never looser than one by the sum of the steps, and rules most centroids out."""
    r = np.random.default_rng(5)
    x = (np.repeat(r.standard_normal((10, 16)) * 400, 200, 0) + r.standard_normal((2000, 16)) * 40).astype(np.int64)
    history, near, when, own, done = [x[:: 100][:20].copy()], np.zeros((2000, 20)), np.full((2000, 20), -1, np.int8), np.zeros(2000, np.int64), []
    for _ in range(6):
        own, d, n = centroids.assign(x, near, when, own, history)
        full = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (d == full.min(1)).all()
        done.append(n)
        history.append(np.array([x[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else history[-1][j] for j in range(20)]))
        steps = sum(np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(history[:-1], history[1:], strict=True))
        assert (centroids.moved(history)[0] <= steps * (1 + 1e-9)).all()
    assert done[0] == 2000 * 20 and done[-1] < 2000 * 6


