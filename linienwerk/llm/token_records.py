"""Token ids as length-delimited binary records with an offset index.

A data file is a row of records. A record is::

    length   8 bytes, little-endian unsigned: bytes of the body
    check    4 bytes: masked CRC-32 of the length field
    body     1 byte 0, or 1 for a null doc_id; 8 bytes doc_id; the ids
    check    4 bytes: masked CRC-32 of the body

The CRC is the one of zlib; masking turns it right by 15 bits and adds
0xA282EAD8, so that a checksum of data holding checksums stays a good one. Ids
are little-endian unsigned integers of 2 or 4 bytes as the manifest says. The
index beside a file holds for each record its offset in the file and its number
of ids (8 bytes each), so that a reader can fetch records in any order.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from linienwerk.llm.common import total_bytes
from linienwerk.llm.shards import MANIFEST, AttemptFile, commit, spread
from linienwerk.llm.tokens import PieceEncoder
from linienwerk.shared import open_fs


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    n = struct.pack("<Q", len(body))
    return b"".join((n, struct.pack("<I", masked(n)), body, struct.pack("<I", masked(body))))


def unframe(stream) -> Iterator[bytes]:
    """The bodies of a stream of records; raises ValueError where a checksum or the end is wrong."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError("damaged length")
        n = struct.unpack("<Q", head[:8])[0]
        body, check = stream.read(n), stream.read(4)
        if len(body) < n or len(check) < 4 or struct.unpack("<I", check)[0] != masked(body):
            raise ValueError("damaged record")
        yield body


def _body(doc_id: int | None, ids: bytes) -> bytes:
    return struct.pack("<Bq", doc_id is None, doc_id or 0) + ids


def _parsed(body: bytes) -> tuple[int | None, bytes]:
    null, doc_id = struct.unpack("<Bq", body[:9])
    return None if null else doc_id, body[9:]


def write_token_records(docs: DataFrame, out_dir: str, tokenizer: str, cut: str = "byte", end_id: int = 0, roll_bytes: int = 64 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """Encodes ``(doc_id, text)`` and writes files in ascending doc_id order; returns the committed manifest.

    File ``tokens-<shard>-<roll>.bin`` goes before another if its (shard, roll)
    does. Shards are ranges of doc_id of about ``part_bytes`` of text, each
    sorted (nulls first, equal ids by text) and written by one task as a
    stream. A null text is its end id alone; equal rows are written as often as
    they occur; other columns are ignored; an empty table gives no files.
    """
    n_parts = max(1, -(-total_bytes(docs, "text") // part_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = PieceEncoder.of(tokenizer, cut)
        end, shard, roll, data, index, done = np.asarray([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId(), 0, None, None, []
        for b in batches:
            for doc, ids in enc.batch(b):
                ids += end
                if data is None:
                    name = f"tokens-{shard:06d}-{roll:04d}"
                    data, index = AttemptFile(out_dir, shard, roll, f"{name}.bin", enc.dtype.str), AttemptFile(out_dir, shard, roll, f"{name}.idx", "index")
                n = len(ids) // enc.dtype.itemsize
                index.write(struct.pack("<QQ", data.write(frame(_body(doc, ids)), 1, n), n), 1)
                if data.row["n_bytes"] >= roll_bytes:
                    done += [data.close(), index.close()]
                    data, roll = None, roll + 1
        if data is not None:
            done += [data.close(), index.close()]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n_parts, F.col("doc_id").asc_nulls_first())
    return commit(rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, MANIFEST), out_dir)


_SCHEMA = pa.schema([("shard", pa.int64()), ("roll", pa.int64()), ("tmp", pa.string()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int64()), ("extra", pa.string())])


def read_token_records(manifest: DataFrame, out_dir: str) -> DataFrame:
    """``manifest → (doc_id, start, n_tokens, ids)`` with every checksum verified.

    ``start`` counts the ids before a record over all files in order: the
    manifest's totals of earlier files, and a running sum within the file.
    ``ids`` are little-endian unsigned 32-bit integers.
    """
    before = Window.orderBy("shard", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.where("extra <> 'index'").withColumn("before", F.coalesce(F.sum("n_items").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(out_dir)
        for b in batches:
            for f in b.to_pylist():
                at, rows, size = f["before"], [], 0
                with system.open_input_stream(posixpath.join(root, f["name"]), compression=None, buffer_size=1 << 20) as stream:
                    for body in unframe(stream):
                        doc, raw = _parsed(body)
                        ids = np.frombuffer(raw, f["extra"]).astype("<u4").tobytes()
                        rows.append({"doc_id": doc, "start": at, "n_tokens": len(ids) // 4, "ids": ids})
                        at += len(ids) // 4
                        size += len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return spread(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def fetch_record(out_dir: str, name: str, k: int) -> tuple[int | None, int]:
    """Record ``k`` of a data file through its index: its doc_id and its number of ids."""
    system, root = open_fs(out_dir)
    with system.open_input_file(posixpath.join(root, name.replace(".bin", ".idx"))) as index:
        index.seek(16 * k)
        at, n = struct.unpack("<QQ", index.read(16))
    with system.open_input_file(posixpath.join(root, name)) as data:
        data.seek(at)
        doc, _ = _parsed(next(unframe(data)))
    return doc, n
