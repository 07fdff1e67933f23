"""Near-duplicate embeddings: learned binary codes, multi-index Hamming tables, exact reranking.

Iterative quantisation learns, on a bounded sample, rotations that turn signs
into balanced bits. A code is cut into substrings, each the key of a table;
vectors that share a key in any table are compared by their originals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linienwerk.llm.common import whole_groups
from linienwerk.operators.graph import connected_components
from linienwerk.shared import Stash


def learn_rotations(sample: np.ndarray, rounds: int = 30, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Mean and one rotation after another of unit vectors: principal axes, then turned until signs lose least."""
    mean = sample.mean(0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    rng = np.random.default_rng(seed)
    while True:
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        yield mean, axes @ r


def n_tables(bits: int, cosine: float, recall: float) -> int:
    """Tables that find a pair at the least cosine with the wanted chance, each bit differing with chance angle / pi."""
    p = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def pairs_at(sample: np.ndarray, cosine: float, n: int = 2000, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at the least cosine by kind: vectors turned any way, turned towards others, and neighbours within the sample where it has 200."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(len(sample), size=n)]
    out = []
    for to in (rng.standard_normal(x.shape), sample[rng.integers(len(sample), size=n)]):
        side = to - (to * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(side, axis=1)
        ok = size > 1e-6
        if ok.any():
            out.append((x[ok], cosine * x[ok] + math.sqrt(1 - cosine**2) * side[ok] / size[ok, None]))
    near: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(sample), 1024):
        c = sample[a : a + 1024] @ sample.T
        i, j = np.nonzero((c >= cosine) & (c < cosine + (1 - cosine) / 5))
        i, j = i[j > i + a], j[j > i + a]
        some = rng.permutation(len(i))[:n]
        near.append((i[some] + a, j[some]))
    i, j = (np.concatenate(z) for z in zip(*near, strict=True))
    if len(i) >= 200:
        some = rng.permutation(len(i))[:n]
        out.append((sample[i[some]], sample[j[some]]))
    return out


def learn_tables(sample: np.ndarray, bits: int, cosine: float, recall: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Rotations with what is taken off before each, and the number of tables in them.

    Taking off the mean widens the angle of a pair, so tables are added until
    the wanted share of every kind of ``pairs_at`` meets. Where the learned
    ones don't bring that about, rotations at random follow that leave the mean
    on, under which the angle is the pair's own.
    """
    dim, least = sample.shape[1], n_tables(bits, cosine, recall)
    kinds = pairs_at(sample, cosine)
    met = [np.zeros(len(x), bool) for x, _ in kinds]
    learned, rng, out, tables = learn_rotations(sample), np.random.default_rng(11), [], 0
    while True:
        mean, r = next(learned) if tables < 8 * least else (np.zeros(dim), np.linalg.qr(rng.standard_normal((dim, dim)))[0])
        out.append((mean, r))
        same = [((x - mean) @ r >= 0) == ((y - mean) @ r >= 0) for x, y in kinds]
        for k in range(dim // bits):
            for m, z in zip(met, same, strict=True):
                m |= z[:, k * bits : k * bits + bits].all(1)
            tables += 1
            if tables >= least and all(m.mean() >= recall for m in met):
                return out, tables


def _links(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each of the given links' ends reaches through them, for all places."""
    label = ids.copy()
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        if (low == label).all():
            return label
        label = low


def _pairs(x: np.ndarray, cuts: np.ndarray, threshold: float, few: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Places ``a < b`` of one group with at least the threshold's product. Small groups are compared all at once, by how far apart their members stand."""
    size = np.diff(np.append(cuts, len(x)))
    group = np.repeat(np.arange(len(cuts)), size)
    out = [(np.empty(0, np.int64),) * 2]
    small = np.repeat(size <= few, size)
    for s in range(1, int(size[size <= few].max(initial=0))):
        a = np.flatnonzero((group[:-s] == group[s:]) & small[:-s])
        a = a[np.einsum("ij,ij->i", x[a], x[a + s]) >= threshold]
        out.append((a, a + s))
    for g in np.flatnonzero(size > few):
        part = x[cuts[g] : cuts[g] + size[g]]
        a, b = np.nonzero(part @ part.T >= threshold)
        out.append((a[a < b] + cuts[g], b[a < b] + cuts[g]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class _Tables:
    """The tables of the vectors of one length: rotations, and which bits of their signs make the key of each."""

    def __init__(self, rotations: list[tuple[np.ndarray, np.ndarray]], tables: int, bits: int):
        self.rotations, self.tables, self.bits = rotations, tables, bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The signs that tables use, a row of ``tables * bits`` for each vector."""
        used = x.shape[1] // self.bits * self.bits
        return np.concatenate([((x - mean) @ r >= 0)[:, :used] for mean, r in self.rotations], 1)[:, : self.tables * self.bits]

    def keys(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), self.tables), np.int64)
        for c in range(self.bits):
            out = out << 1 | code[:, c :: self.bits]
        return out

    def met_before(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether packed codes share a key of a table before ``t``."""
        n = self.tables * self.bits
        same = np.unpackbits(a ^ b, axis=1, count=n).reshape(len(a), self.tables, self.bits).any(2)
        return ((~same) & (np.arange(self.tables) < t[:, None])).any(1)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, sample_rows: int = 10_000, block: int = 1024) -> DataFrame:
    """``(vec_id, embedding) → (vec_id, n_links, component_id, kept)``, a row per vec_id.

    Links are pairs with cosine >= ``threshold`` in double precision that share
    a key in one of the tables; a pair right at the threshold does with chance
    ``recall``, as measured on pairs made from the sample (see ``learn_tables``),
    closer ones more often. Tables have log2(rows / 8) bits, so
    buckets of unrelated vectors stay small at any size; larger buckets are
    cut into blocks, each two of which are compared for themselves.
    A pair counts in the first table in which it meets. Comparisons return sums
    and a spanning forest, never pairs. Equal vectors are compared once and
    count as many. Rotations are fitted on the ``sample_rows`` vectors with the
    smallest hash of vec_id.

    Vectors of one length are compared with each other, whatever lengths there
    are, each length with tables of its own. Vectors that are null, empty, zero,
    or hold null or non-finite components link with nothing. Of repeated rows of a vec_id the smallest vector counts. A null
    vec_id comes back with 0 links and no component. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    stash = Stash(spark, "vectors")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    every = stash.put(v.groupBy("vec_id").agg(F.min("e").alias("e")))
    sound = F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    named = stash.put(every.where(sound).select("vec_id", F.size("e").alias("d"), F.xxhash64("e").alias("h1"), F.xxhash64(F.lit(1), "e").alias("h2")))
    equal = stash.put(named.groupBy("d", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt")))
    reps = stash.put(equal.select("rep", "cnt", "d").join(every.select(F.col("vec_id").alias("rep"), "e"), "rep"))

    def unit(x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    tables: dict[int, _Tables] = {}
    for dim, count in equal.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").collect():
        bits = min(dim, max(4, math.ceil(math.log2(count / 8))))
        sample = np.array([r[0] for r in reps.where(F.col("d") == dim).orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("e").collect()])
        tables[dim] = _Tables(*learn_tables(unit(sample), bits, threshold, recall), bits)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("d").to_numpy()
            for dim in np.unique(d).tolist():
                some = b.filter(pa.array(d == dim))
                x = unit(some.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                code = tables[dim].codes(x) if dim in tables else np.zeros((len(x), 8), bool)
                keys = tables[dim].keys(code) if dim in tables else np.zeros((len(x), 1), np.int64)
                rows = [some.column("rep"), some.column("cnt"), some.column("d"), *(pa.array([z.tobytes() for z in y], pa.binary()) for y in (x, np.packbits(code, axis=1))), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, ["rep", "cnt", "d", "x", "code", "keys"])

    coded = stash.put(reps.mapInArrow(encode, "rep long, cnt long, d int, x binary, code binary, keys array<long>"))
    # a table's number holds the length, so that vectors of different lengths don't meet
    placed = coded.select("rep", "d", F.posexplode("keys").alias("k", "key")).select("rep", (F.col("d").cast("long") * (1 << 20) + F.col("k")).alias("t"), "key")
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1").withColumn("n", F.ceil(F.col("c") / block))
    own = placed.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).join(coded.select("rep", "cnt", "x", "code"), "rep")
    spread = spread.select("t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "cnt", "x", "code")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, ("t", "key", "i", "j")):
            t = table.column("t").to_numpy()
            lengths = t[cuts] >> 20
            for dim in np.unique(lengths).tolist():  # tables are in order, so a length's groups stand together
                mine = np.flatnonzero(lengths == dim)
                a0, a1 = cuts[mine[0]], np.append(cuts, len(t))[mine[-1] + 1]
                part = table.slice(a0, a1 - a0)
                ids, cnt, i, j, own_ = (part.column(c).to_numpy() for c in ("rep", "cnt", "i", "j", "own"))
                x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float64).reshape(-1, dim)
                a, b = _pairs(x, cuts[mine] - a0, threshold)
                ok = (i[a] == j[a]) | (own_[a] != own_[b])
                a, b = a[ok], b[ok]
                if dim in tables and len(a):
                    code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(part), -1)
                    new = np.concatenate([~tables[dim].met_before(code[a[k : k + 4096]], code[b[k : k + 4096]], t[a0 + a[k : k + 4096]] & (1 << 20) - 1) for k in range(0, len(a), 4096)])
                    a, b = a[new], b[new]
                if len(a):
                    names, place = np.unique(ids, return_inverse=True)
                    n = np.bincount(place[a], cnt[b], len(names)) + np.bincount(place[b], cnt[a], len(names))
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(n[some].astype(np.int64)), pa.array(_links(names, place[a], place[b])[some])], ["rep", "n", "root"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(n_parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    found = stash.put(spread.mapInArrow(compare, "rep long, n long, root long"))
    comp = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    degree = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = equal.join(degree, "rep", "left").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    of = of.select("d", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("cnt") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    mine = stash.put(named.join(of, ["d", "h1", "h2"]).select("vec_id", "n_links", "component"))
    for t in (named, equal, reps, coded, found, comp):
        stash.drop(t)
    out = every.select("vec_id").join(mine, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept"))
