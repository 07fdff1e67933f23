"""Deterministic sharded WARC writer and reader.

Records are sorted by key into shards whose bounds depend on the data alone,
files roll by compressed size, headers and digests are made anew, and files
are committed through temporary names and a manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.llm.shards import MANIFEST, AttemptFile, commit, spread
from linienwerk.shared import Stash, open_fs

_SCHEMA = pa.schema([("shard", pa.int64()), ("roll", pa.int64()), ("tmp", pa.string()), ("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int64()), ("extra", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("html", pa.string()), ("name", pa.string())])


def shard_bounds(sizes: DataFrame, shard_bytes: int, max_shards: int = 1 << 16) -> list[int]:
    """First page_id of each shard but the first: a shard is closed once it holds ``shard_bytes``.

    Sorted by page_id over all partitions; the bytes before a row are its
    partition's offset and a sum within it, so the bounds are the same however
    the rows are dealt out. The list is bounded: beyond 4 TB its ``max_shards``
    shards are larger, and their tasks still stream and spill.
    """
    stash = Stash(sizes.sparkSession, "warc-bounds")
    ids = stash.put(sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("n").alias("n")))
    total = int(ids.agg(F.sum("n")).first()[0] or 0)
    step = max(shard_bytes, -(-total // max_shards))
    n = max(1, min(max_shards, total // step))
    placed = stash.put(ids.repartitionByRange(n, "page_id").withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    at = placed.withColumn("run", run).join(F.broadcast(before), "part").select("page_id", ((F.col("base") + F.col("run")) / step).cast("long").alias("shard"))
    bounds = sorted(r[0] for r in at.groupBy("shard").agg(F.min("page_id")).select("min(page_id)").collect())
    for t in (ids, placed):
        stash.drop(t)
    return bounds[1:]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds up to a key, by binary search; 0 for null. Only keys go through Python."""
    table = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, keys.to_numpy(), side="right"))

    return place(F.coalesce(key, F.lit(-(1 << 63)))) if bounds else F.lit(0).cast("long")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member whose header holds no time, so that equal records give equal bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean(value: str | None) -> str:
    """A header's value on one line: what would break it is percent-encoded."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _dirty(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _page(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}:{url}")
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Page-ID", "" if page_id is None else str(page_id))]
    headers += [("WARC-Target-URI", _clean(url))] * (url is not None)
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, block)


def write_warc(pages: DataFrame, out_dir: str, shard_bytes: int = 64 << 20, roll_bytes: int = 16 << 20, min_revisit_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html) → gzip WARC files``; returns the committed manifest.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest page_id is a response, others are revisits without
    payload. A null html is an empty payload; a null url leaves its header out;
    a page with a null page_id goes first, is a response and is never referred
    to; rows with the same page_id and payload are all responses. Other columns
    are ignored; an empty table gives no files. The same table gives the same
    files, however it is partitioned.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    narrow = p.select("page_id", F.octet_length("html").cast("long").alias("n"), F.sha1(F.col("html").cast("binary")).alias("sha"))
    bounds = shard_bounds(narrow.select("page_id", "n"), shard_bytes)
    able = narrow.where(F.col("page_id").isNotNull() & (F.col("n") >= min_revisit_bytes))
    first = able.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    notes = able.join(first, "sha").where("page_id > first").select("page_id", "sha", "first").distinct()
    # a page and its note meet in its shard: the payloads are shuffled once
    both = p.select("page_id", "url", "html", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")).unionByName(notes.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "first", F.lit(0).alias("kind")))
    # a task for each shard
    rows = both.withColumn("shard", shard_of(F.col("page_id"), bounds)).repartitionById(len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "html").select("shard", "page_id", "url", "html", "sha", "first", "kind")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, roll, done, noted, notes = None, None, 0, [], None, {}
        for b in batches:
            for s, page_id, url, html, sha, first_, kind in zip(*(b.column(k) for k in range(7)), strict=True):
                s, page_id = s.as_py(), page_id.as_py()
                if kind.as_py() == 0:
                    if page_id != noted:
                        noted, notes = page_id, {}
                    notes[sha.as_py()] = first_.as_py()
                    continue
                if s != shard or out is not None and out.row["n_bytes"] >= roll_bytes:
                    if out is not None:
                        done.append(out.close())
                    shard, roll = s, roll + 1 if s == shard else 0
                    name = f"pages-{shard:06d}-{roll:04d}.warc.gz"
                    out = AttemptFile(out_dir, shard, roll, name)
                    out.write(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")), 0)
                payload = html.as_py().encode("utf-8", "surrogatepass")
                digest = hashlib.sha1(payload)
                refers_to = notes.get(digest.hexdigest()) if page_id is not None and noted == page_id else None
                out.write(_member(_page(page_id, url.as_py(), b"" if refers_to is not None else payload, _b32(digest.digest()), len(payload), refers_to)), 1, len(payload))
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_SCHEMA)

    return commit(rows.mapInArrow(write, MANIFEST), out_dir)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of uncompressed WARC bytes."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            headers[k] = v
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record ends early")
        yield headers, block


def read_warc(manifest: DataFrame, out_dir: str) -> DataFrame:
    """``manifest → (page_id, url, record_type, payload_digest, payload_bytes, refers_to, html, name)``.

    Every block's digest is verified, and that of every payload that is there.
    A revisit has no html; its payload_bytes are those its HTTP header states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        system, root = open_fs(out_dir)
        for b in batches:
            for name in b.column("name").to_pylist():
                rows, size = [], 0
                with system.open_input_stream(posixpath.join(root, name), compression=None, buffer_size=1 << 20) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                    for h, block in records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if h["WARC-Block-Digest"] != f"sha1:{_b32(hashlib.sha1(block).digest())}":
                            raise ValueError(f"{name}: a block's digest is wrong")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, visit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
                        if not visit and (len(payload) != stated or _b32(hashlib.sha1(payload).digest()) != digest):
                            raise ValueError(f"{name}: a payload's digest or length is wrong")
                        rows.append({"page_id": int(h["WARC-Page-ID"]) if h["WARC-Page-ID"] else None, "url": _dirty(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None, "record_type": h["WARC-Type"], "payload_digest": digest, "payload_bytes": stated, "refers_to": int(h["WARC-Refers-To-Page-ID"]) if visit else None, "html": None if visit else payload.decode("utf-8", "surrogatepass"), "name": name})
                        size += len(payload) + 400
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return spread(manifest).mapInArrow(read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string, name string")
