"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its word shingles, a shingle's weight being
how often it occurs. Darts are thrown at the plane of weight and time above
each element, by hashes of the element alone: about one to each unit cell. A
dart belongs to one coordinate; those within the element's weight count, and
the earliest of each coordinate makes the signature. For each unit of weight
one cell is looked at, or as many as it takes to throw k ln k darts altogether.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linienwerk.llm.common import whole_groups
from linienwerk.operators.graph import connected_components
from linienwerk.shared import Stash

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Cumulative probabilities of 0, 1, 2… darts in a cell of area 1, from the Poisson law.
_DARTS = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16.0)))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _D
    x = (x ^ x >> np.uint64(29)) * _A
    return x ^ x >> np.uint64(32)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, by the sums of its bytes times powers of an odd number."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if inside.max() >= len(_POWERS.held):
        _POWERS.grow(int(inside.max()) + 1)
    return _mix(np.add.reduceat(_mix(data + np.uint64(1)) * _POWERS.held[inside], np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))


class _POWERS:
    held = np.multiply.accumulate(np.full(256, _B))

    @classmethod
    def grow(cls, n: int) -> None:
        cls.held = np.multiply.accumulate(np.full(2 * n, _B))


def shingles(raw: bytes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, ascending, and how often each occurs; a text of fewer words is one shingle."""
    words = raw.split()  # at ASCII white space
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = _word_hashes(words)
    n = max(1, len(h) - size + 1)
    out = np.full(n, np.uint64(min(size, len(h))))
    for k in range(min(size, len(h))):
        out = _mix(out * _C + h[k : k + n])
    return np.unique(out, return_counts=True)


def dart_signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the earliest dart of each of ``k`` coordinates; two agree with the sets' weighted Jaccard similarity."""
    slabs = np.ceil(weights).astype(np.int64)
    which = np.repeat(np.arange(len(elements)), slabs)
    slab = np.arange(len(which)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    base = _mix(elements[which] * _A + slab.astype(np.uint64) * _B)
    limit = k * (np.log(k) + 2.5) / float(weights.sum())
    while True:
        cells = int(np.ceil(limit))
        cell = np.tile(np.arange(cells, dtype=np.uint64), len(base))
        g = _mix(np.repeat(base, cells) + cell * _C)
        n = np.searchsorted(_DARTS, (g >> np.uint64(11)).astype(np.float64) / 2.0**53)
        q = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        dart = _mix(np.repeat(g, n) * _D + (q + 1).astype(np.uint64) * _A)
        time = np.repeat(cell, n).astype(np.float64) + (dart >> np.uint64(11)).astype(np.float64) / 2.0**53
        more = _mix(dart + _B)
        coordinate = ((more >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
        height = np.repeat(np.repeat(slab, cells), n) + (more & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
        hit = (time <= limit) & (height < np.repeat(np.repeat(weights[which], cells), n))
        order = np.argsort(-time[hit], kind="stable")
        out, seen = np.zeros(k, np.uint64), np.zeros(k, bool)
        out[coordinate[hit][order]] = _mix(dart[hit][order] ^ _C)
        seen[coordinate[hit]] = True
        if seen.all():
            return out
        limit *= 2


_SIGNED = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("size", pa.int64()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _sha(text) -> Column:
    return F.unhex(F.sha1(text.cast("string")))


def sign(docs: DataFrame, k: int = 512, bands: int = 32, rows: int = 6, shingle: int = 5) -> DataFrame:
    """``(doc_id, text) → (doc_id, sha, size, sig, keys)``: SHA-1 and bytes of the text, a byte of each coordinate, the bands' keys; none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(1, bands + 1, dtype=np.uint64) * _C
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part, out = b.slice(at, 2000), [[], [], [], [], []]
                for doc, sha, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    e, w = shingles(raw, shingle)
                    if not len(e):
                        continue
                    s = dart_signature(e, w, k)
                    key = number.copy()
                    for r in range(rows):
                        key = _mix(key * _A + s[r : bands * rows : rows])
                    for c, v in zip(out, (doc, sha, len(raw), s.astype(np.uint8).tobytes(), key.view(np.int64)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SIGNED, strict=True)], schema=_SIGNED)

    rows_ = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id long, sha binary, size long, sig binary, keys array<long>")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def buckets(reps: DataFrame) -> DataFrame:
    """``(id, size, keys) → (key, id, c, bytes)``: members of the bands' buckets of two or more, with the bucket's members and bytes."""
    keys = reps.select("id", "size", F.explode("keys").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("c"), F.sum("size").alias("bytes")).where("c > 1")
    return keys.join(sizes, "key").select("key", "id", "c", "bytes")


def agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs whose signatures agree in ``least`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.stack([np.frombuffer(v, np.uint8) for v in b.column(c).to_pylist()]) for c in ("sig", "sig_b"))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], schema=_PAIR)

    sig = reps.select("id", "sig")
    j = pairs.join(sig.withColumnRenamed("id", "a"), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return j.select("a", "b", "sig", "sig_b").mapInArrow(run, "a long, b long")


def hub_pairs(members: DataFrame) -> DataFrame:
    """``(key, id, c) → distinct pairs (a < b)``: each bucket's members with its hub, the one that stands in the fullest buckets altogether.

    The original of many copies is the hub of most of their buckets, so one
    link for each copy tells the class, and the copies' own pairs aren't made.
    """
    score = members.groupBy("id").agg(F.sum("c").alias("score"))
    hubs = members.join(score, "id").groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
    j = members.join(hubs, "key").where("id <> hub")
    return j.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The members of each block, with those that visit it."""
    for t, cuts in whole_groups(batches, ("key", "block")):
        for a, e in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
            yield t.slice(a, e - a)


def _sides(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For a block: each visitor, and the residents of another label. Two that both visit blocks are seen once, by the one with the smaller id."""
    role, label, ids = t.column("role").to_numpy(), t.column("label").to_numpy(), t.column("id").to_numpy()
    here = np.flatnonzero(role != _VISITOR)
    for at in np.flatnonzero(role != _RESIDENT):
        some = here[(label[here] != label[at]) & ((role[here] == _RESIDENT) | (ids[here] > ids[at]))]
        if len(some):
            yield int(at), some


def _by_blocks(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Runs a function over the rows, those of a block of a bucket together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "block").sortWithinPartitions("key", "block").mapInArrow(run, schema)


#: What a row stands for in a block: a member of the bucket's commonest label, which stays in its own block; another
#: member in a foreign block; such a member in its own block, which also stays there for the others to meet.
_RESIDENT, _VISITOR, _BOTH = 0, 1, 2
_MARKED = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("role", pa.int32()), ("id", pa.int64()), ("label", pa.int64())])


def crossing_members(members: DataFrame, reps: DataFrame, least: int, block: int = 1024, block_bytes: int = 8 << 20) -> DataFrame:
    """``(key, id, c, bytes, label) → (key, block, role, id, label)``: members of a bucket that agree in ``least`` coordinates with one of another label.

    Buckets of one label alone have nothing to tell. A bucket of more than
    ``block`` members or ``block_bytes`` bytes of text is cut into blocks.
    Members of its commonest label stay in their own; only the others, as a
    rule few, are sent to all blocks and meet who stays there. Pairs aren't made.
    """
    labels = members.groupBy("key", "label").agg(F.count("*").alias("of"))
    mixed = labels.groupBy("key").agg(F.max_by("label", F.struct("of", -F.col("label"))).alias("common"), F.count("*").alias("labels")).where("labels > 1").select("key", "common")
    n = F.ceil(F.greatest(F.col("c") / block, F.col("bytes") / block_bytes)).cast("int")
    placed = members.join(mixed, "key").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    stays = F.col("label") == F.col("common")
    blocks = F.when(stays, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
    role = F.when(stays, _RESIDENT).when(F.col("block") == F.col("own"), _BOTH).otherwise(_VISITOR)
    spread = placed.withColumn("block", F.explode(blocks)).select("key", "block", role.alias("role"), "id", "label").join(reps.select("id", "sig"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(t), -1)
            near = np.zeros(len(t), bool)
            for at, some in _sides(t):
                hit = some[(sigs[some] == sigs[at]).sum(1) >= least]
                near[hit] = True
                near[at] |= len(hit) > 0
            if near.any():
                yield from t.filter(pa.array(near)).select(_MARKED.names).combine_chunks().cast(_MARKED).to_batches()

    return _by_blocks(spread, run, "key long, block int, role int, id long, label long")


def crossing_links(marked: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``crossing_members`` and texts ``(id, text) → links (a < b)`` that join their labels as far as similar texts do.

    The similarity of a visitor with all residents of a block is worked out at
    once, from an index of their shingles. Of the links found only those are
    given that join labels which earlier ones didn't: fewer than members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sets = [shingles(x.as_buffer().to_pybytes(), shingle) for x in t.column("text")]
            which = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
            element = np.concatenate([e for e, _ in sets])
            weight = np.concatenate([w for _, w in sets])
            total = np.bincount(which, weight, len(sets))
            names, element = np.unique(element, return_inverse=True)
            by = np.argsort(element, kind="stable")
            holders, held = which[by], weight[by]
            first = np.searchsorted(element[by], np.arange(len(names) + 1))
            start = np.cumsum([0, *(len(e) for e, _ in sets)])
            ids, up = t.column("id").to_numpy(), {x: x for x in t.column("label").to_pylist()}
            label = t.column("label").to_pylist()

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            out = []
            for at, some in _sides(t):
                mine = slice(start[at], start[at + 1])
                n = first[element[mine] + 1] - first[element[mine]]
                place = np.repeat(first[element[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shared = np.bincount(holders[place], np.minimum(held[place], np.repeat(weight[mine], n)), len(sets))[some]
                for x in some[shared / (total[some] + total[at] - shared) >= threshold].tolist():
                    a, b = root(label[at]), root(label[x])
                    if a != b:
                        up[a] = b
                        out.append(sorted((int(ids[at]), int(ids[x]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PAIR)

    return _by_blocks(marked.join(texts.select("id", "text"), "id"), run, "a long, b long").distinct()


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(x[1][i], y[1][j]).sum())
    total = int(x[1].sum() + y[1].sum()) - shared
    return shared / total if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """The pairs whose texts ``(id, text)`` have the least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for b in batches:
            out = []
            for p, q, x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
                if held != p:
                    held, own = p, shingles(x.as_buffer().to_pybytes(), shingle)
                if similarity(own, shingles(y.as_buffer().to_pybytes(), shingle)) >= threshold:
                    out.append((p, q))
            a = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=_PAIR)

    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, k: int = 512, bands: int = 32, rows: int = 6, slack: float = 0.055) -> DataFrame:
    """``docs → (doc_id, sha, class_id)``: SHA-1 of the text; the smallest doc_id of its class.

    Documents are linked whose weighted Jaccard similarity of word shingles
    (5 words, weighed by count) is ``threshold`` or more; classes are the
    components of links, copies of a text included. Every link is verified on
    the texts. A pair at 0.8 shares one of 32 bands of 6 coordinates but for 6
    in 100,000; pairs whose 512 coordinates agree in less than ``threshold -
    slack`` (three standard deviations) aren't verified.

    Buckets are linked by their hubs first. Members that this leaves in
    different classes, though they agree enough, are then compared in blocks,
    which give no more links than members. So no pass makes the pairs of a
    group, and no link that could join two classes is left out.

    Equal texts are one while signatures are compared. A null text, and one
    without words, is a class of its own; so is a null doc_id, whose class_id
    is null. Repeated rows come back as often as they occur; rows of one doc_id
    with different texts are told apart by them, and each has the class of its
    own text. Other columns are ignored; an empty table gives no rows.
    """
    stash = Stash(docs.sparkSession, "near")
    least = int(np.ceil((threshold - slack) * k))
    signed = stash.put(sign(docs, k, bands, rows, shingle))
    reps = signed.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    split = signed.groupBy("doc_id").agg((F.min("sha") != F.max("sha")).alias("x")).where("x").limit(1).count()
    if split:  # a doc_id with several texts: the first keeps the id while links are found, the others take a hash
        first = signed.groupBy("doc_id").agg(F.min("sha").alias("first"))
        reps = reps.join(first, "doc_id").withColumn("id", F.when(F.col("sha") == F.col("first"), F.col("doc_id")).otherwise(F.xxhash64("sha"))).drop("first")
    else:
        reps = reps.withColumn("id", F.col("doc_id"))
    reps = stash.put(reps)
    stash.drop(signed)
    members = stash.put(buckets(reps))
    # the texts of documents that share a bucket; a merge at any size, as their number follows the corpus
    shas = members.select("id").distinct().join(reps.select("id", "sha", "doc_id"), "id").hint("merge")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha"), F.col("text").cast("string").alias("text"))
    texts = stash.put(texts.join(shas, ["doc_id", "sha"]).select("id", "text").dropDuplicates(["id"]))
    links = stash.put(verified(agreeing(hub_pairs(members), reps, least), texts, threshold, shingle))
    comp = _components(links)
    labelled = members.join(comp.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    marked = stash.put(crossing_members(labelled, reps, least))
    found = stash.put(crossing_links(marked, texts, threshold, shingle))
    if found.limit(1).count():
        stash.drop(comp)
        comp = _components(links.unionByName(found))
    rep = reps.select("sha", "doc_id", "id").join(comp, "id", "left").select("sha", "doc_id", F.coalesce("component", "id").alias("class_id"))
    if split:
        named = rep.groupBy("class_id").agg(F.min("doc_id").alias("least"))
        rep = rep.join(named, "class_id").select("sha", F.col("least").alias("class_id"))
    rep = stash.put(rep.select("sha", "class_id"))
    for t in (reps, members, texts, links, marked, found, comp):
        stash.drop(t)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sha(F.col("text")).alias("sha")).join(rep, "sha", "left")
    return out.select("doc_id", "sha", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
