"""Cost-balanced packing of token sequences.

A document costs ``linear * n + quadratic * n**2`` (attention within itself).
Documents, dearest first, go to the cheapest sequence that still has room.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from linienwerk.llm.common import total_bytes
from linienwerk.llm.tokens import PieceEncoder

_PART = "doc_id long, start long, doc_tokens long, pack_group int, ids binary"
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def capacities(total: int, limit: int) -> list[int]:
    """Full sequences and, for what is left over, powers of two: all are filled to the last token."""
    return [limit] * (total // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if total % limit >> k & 1]


def assign(lengths: list[int], limit: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` for the lengths of one group.

    A document goes whole to the cheapest sequence with room for it; where none
    has, the cheapest one with any room takes what fits, and the rest of the
    document stands in line again by its own cost.
    """
    caps = np.array(capacities(sum(lengths), limit), np.int64)
    room, cost = caps.copy(), np.zeros(len(caps))
    line = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(line)
    out = []
    while line:
        n, i, start = heapq.heappop(line)
        n = -n
        fits = room >= n
        k = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
        take = min(n, int(room[k]))
        out.append((i, start, take, k, int(caps[k] - room[k])))
        room[k] -= take
        cost[k] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(line, (take - n, i, start + take))
    return out


def _mixed(*numbers: int) -> int:
    """A hash of whole numbers whose upper bits are well spread."""
    h = 0
    for n in numbers:
        h = (h ^ n & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h >> 20


def pack_documents(docs: DataFrame, tokenizer: str, cut: str = "word", end_id: int = 2, limit: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, group_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, text) → pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids)``.

    ``ids`` are little-endian unsigned 32-bit integers. Each document is its ids
    and ``end_id``. What a document has beyond a multiple of ``limit`` is packed
    among others of its group; its full parts are sequences of their own. Parts
    are dealt by a hash of id, place and ids to groups of about ``group_bytes``
    of text, so that a group fits in a task at any size of the table, also where
    many rows are equal or have no id; groups are packed for
    themselves and leave no padding, as their last tokens fill sequences whose
    length is a power of two. ``limit`` is a power of two.

    A null or empty text is its end id alone; a null doc_id stays null; equal
    rows are packed as often as they occur; other columns are ignored; an empty
    table gives no rows.
    """
    # a row without a text still has its end id
    n_groups = max(1, -(-(total_bytes(docs, "text") + 8 * docs.count()) // group_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(tokenizer, cut)
        end, width = np.asarray([end_id], enc.dtype).tobytes(), enc.dtype.itemsize * limit
        # equal rows, and rows without an id, are told apart by where they stand
        rows, size, seen = [], 0, TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            c = list(zip(*rows, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.binary())], ["doc_id", "start", "doc_tokens", "pack_group", "ids"])

        for b in batches:
            for doc, ids in enc.batch(b):
                ids += end
                n = len(ids) // enc.dtype.itemsize
                for at in range(0, len(ids), width):
                    start = at // enc.dtype.itemsize
                    rows.append((doc, start, n, _mixed(doc or 0, start, n, zlib.crc32(ids[at : at + width]), seen) % n_groups, ids[at : at + width]))
                    seen += 1
                size += len(ids)
                if size > 4 << 20:
                    yield flush()
                    rows.clear()
                    size = 0
        if rows:
            yield flush()

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dtype = PieceEncoder.of(tokenizer, cut).dtype
        docs_, starts, totals, ids = (t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), docs_[i] is None, docs_[i] or 0, starts[i], ids[i]))
        full = [i for i in order if len(ids[i]) == limit * dtype.itemsize]
        rest = order[len(full) :]
        base = key[0].as_py() << 31
        out = [(i, 0, limit, base + k, 0) for k, i in enumerate(full)]
        out += [(rest[i], s, n, base + len(full) + k, at) for i, s, n, k, at in assign([len(ids[i]) // dtype.itemsize for i in rest], limit, linear, quadratic)]
        wide = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in ids]
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in (([docs_[i] for i, *_ in out], pa.int64()), ([starts[i] + s for i, s, *_ in out], pa.int64()), ([n for _, _, n, _, _ in out], pa.int64()), ([totals[i] for i, *_ in out], pa.int64()), ([q for *_, q, _ in out], pa.int64()), ([at for *_, at in out], pa.int64()), ([wide[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in out], pa.binary()))],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _PART)
    return parts.groupBy("pack_group").applyInArrow(pack, _PIECE)


def padding(pieces: DataFrame, limit: int = 4096) -> DataFrame:
    """``pieces → (n_sequences, n_tokens, n_padding)``: a sequence is padded to ``limit`` unless its length is a power of two."""
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    pad = F.when(F.bit_count("used") == 1, 0).otherwise(limit - F.col("used"))
    return used.agg(F.count("*").alias("n_sequences"), F.sum("used").alias("n_tokens"), F.sum(pad).alias("n_padding"))
