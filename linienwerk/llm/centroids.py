"""Exact k-means of integer vectors with bounds from the centroids' history.

Every vector keeps, for each centroid, the distance found when it was last
evaluated, and the round of that. As all earlier centroids are kept, a bound is
loosened by how far the centroid is now from where it was then — one
displacement — and not by the sum of its steps since, which is never less. A
centroid whose bound can't rule it out is evaluated again, in whole numbers, so
the clusters are those of a search of all centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linienwerk.shared import Stash

#: Components are below this in size, so that squared distances of up to 1,024 of them are longs.
MOST = 1 << 25
#: By so much are bounds loosened for rounding: some thousand times the error of double arithmetic on such numbers.
_SLACK = 1e-10


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``(vec_id, x)``: floor(scale * component) of vectors with exactly ``dims`` finite components, as an array of long."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * scale))
    small = F.forall(x, lambda v: F.abs(v * scale) < MOST)
    error = F.raise_error(F.lit(f"a component times {scale} is {MOST} or more in size"))
    return vectors.where(good).select(F.col(vec_id).alias("vec_id"), F.when(small, scaled).otherwise(error.cast("array<bigint>")).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:vec_id``, at most ``k``; equal ids by components, null ids last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.withColumn("h", h).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in top], np.int64)


def moved(history: list[np.ndarray]) -> np.ndarray:
    """``[s, j]``: how far centroid j is now from where it was in round s, never too small."""
    now = history[-1]
    return np.stack([np.sqrt(((now - then) ** 2).sum(1).astype(np.float64)) for then in history]) * (1 + _SLACK)


def assign(x: np.ndarray, near: np.ndarray, when: np.ndarray, own: np.ndarray, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector and the exact squared distance to it; ties go to the smaller number.

    ``near`` (lower bounds at the evaluation) and ``when`` (its round; -1: none
    yet) are brought up to date in place for those evaluated. Also returns the
    number of distances computed.
    """
    now, t = history[-1], len(history) - 1
    low = np.where(when < 0, 0.0, near - moved(history)[np.maximum(when, 0), np.arange(len(now))])
    rows = np.arange(len(x))
    # the vector's own centroid first: it is the one that others must beat
    best = np.maximum(own, 0).astype(np.int64)
    d = ((x - now[best]) ** 2).sum(1)
    near[rows, best], when[rows, best] = np.sqrt(d.astype(np.float64)) * (1 - _SLACK), t
    # a centroid as near as the own one may win a tie, so only those certainly farther are ruled out
    doubt = low <= (np.sqrt(d.astype(np.float64)) * (1 + _SLACK))[:, None]
    doubt[rows, best] = False
    n = len(x) + int(doubt.sum())
    for j in np.flatnonzero(doubt.any(0)):
        some = np.flatnonzero(doubt[:, j])
        e = ((x[some] - now[j]) ** 2).sum(1)
        near[some, j], when[some, j] = np.sqrt(e.astype(np.float64)) * (1 - _SLACK), t
        win = (e < d[some]) | ((e == d[some]) & (j < best[some]))
        d[some[win]], best[some[win]] = e[win], j
    return best, d, n


def _round(history: list[np.ndarray]):
    """Arrow batches of vectors with their bounds → the same after a round of assigning."""
    k = len(history[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _lists(b.column("x"), n).astype(np.int64)
            first = len(history) == 1
            near = np.zeros((n, k)) if first else np.frombuffer(b"".join(b.column("near").to_pylist()), "<f4").reshape(n, k).astype(np.float64)
            when = np.full((n, k), -1, np.int8) if first else np.frombuffer(b"".join(b.column("when").to_pylist()), np.int8).reshape(n, k).copy()
            own = np.zeros(n, np.int64) if first else b.column("cluster").to_numpy()
            best, d, _ = assign(x, near, when, own, history)
            short = near.astype("<f4")
            short = np.where(short > near, np.nextafter(short, np.float32(-1)), short).astype("<f4")
            pack = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(best.astype(np.int32)), pa.array(d), pack(short), pack(when)], ["vec_id", "x", "cluster", "distance", "near", "when"])

    return run


def _lists(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _sums(k: int):
    """Arrow batches of assigned vectors → for each cluster and component the task's sum; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, c = _lists(b.column("x"), b.num_rows).astype(np.int64), b.column("cluster").to_numpy()
            total = np.zeros((k, x.shape[1]), np.int64) if total is None else total
            np.add.at(total, c, x)
            count += np.bincount(c, minlength=k)
        if total is not None:
            all_ = np.concatenate([count[:, None], total], 1)
            j, i = np.nonzero(np.broadcast_to(count[:, None] > 0, all_.shape))
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array((i - 1).astype(np.int32)), pa.array(all_[j, i])], ["cluster", "dim", "total"])

    return run


def next_centroids(rows: DataFrame, last: np.ndarray) -> np.ndarray:
    """Floors of the means of each cluster; that of an empty cluster stays. A row for each cluster and component comes to the driver."""
    parts = rows.select("x", "cluster").mapInArrow(_sums(len(last)), "cluster int, dim int, total long")
    sums = {(r["cluster"], r["dim"]): int(r["total"]) for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return np.array([[sums[j, i] // sums[j, -1] for i in range(last.shape[1])] if (j, -1) in sums else list(last[j]) for j in range(len(last))], np.int64)


def cluster_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` after ``rounds`` of Lloyd's method and a last assigning.

    Vectors of other lengths, null ones and those with null or non-finite
    components are left out; other columns are ignored. Repeated rows count as
    often as they occur. With fewer than ``k`` vectors there are as many
    centroids as vectors; an empty table gives no rows. A component that times
    ``scale`` is 2**25 or more in size is an error, as distances would be no longs.

    A round reads and writes one table of the shared folder without a shuffle;
    its sums are added up in the tasks first, ``k * (dims + 1)`` rows each. The
    driver holds the centroids of all rounds.
    """
    stash = Stash(vectors.sparkSession, "centroids")
    rows = stash.put(whole_vectors(vectors, vec_id, vector, dims, scale))
    history = [first_centroids(rows, k, seed)]
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<bigint>, cluster int, distance long, near binary, when binary"
    if not len(history[0]):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for t in range(rounds + 1):
        new = stash.put(rows.mapInArrow(_round(list(history)), kind))
        stash.drop(rows)
        rows = new
        if t < rounds:
            history.append(next_centroids(rows, history[-1]))
    inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    each = of([inertia.get(j, 0) for j in range(len(sha))]).cast("long")
    return rows.select("vec_id", "cluster", "distance", each.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(sha).alias("centroid_sha256"))
