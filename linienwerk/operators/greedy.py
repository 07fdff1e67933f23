"""Operators whose answer depends on earlier answers: small per-row helpers for Arrow batches and bounded groups."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa


def throttle_rows(key: str, ts: str, seconds: int, most: int) -> Callable:
    """Reads rows sorted by key and time; keeps at most ``most`` accepted stamps of the key at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stamps = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b.column(key).to_pylist(), b.column(ts).cast(pa.int64()).to_pylist(), strict=True):
                if k != now:
                    now, stamps = k, deque()
                while stamps and stamps[0] <= t - seconds * 1_000_000:
                    stamps.popleft()
                ok = len(stamps) < most
                if ok:
                    stamps.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "accepted"])

    return run


def decode_polyline(text: str, precision: int = 5) -> list[tuple[float, float]]:
    """Places (lon, lat) of an encoded line: zigzag numbers in base 32, each a step from the one before."""
    steps, value, shift = [], 0, 0
    for c in text:
        b = ord(c) - 63
        value |= (b & 31) << shift
        shift += 5
        if b < 32:
            steps.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    lat = lon = 0
    out = []
    for a, o in zip(steps[::2], steps[1::2], strict=False):
        lat, lon = lat + a, lon + o
        out.append((lon / 10**precision, lat / 10**precision))
    return out


def encode_polyline(points: list[tuple[float, float]], precision: int = 5) -> str:
    """The inverse of ``decode_polyline``, places rounded half up."""
    out, last = [], (0, 0)
    for lon, lat in points:
        now = (int(lat * 10**precision + 0.5), int(lon * 10**precision + 0.5))
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1 if a >= b else ~((a - b) << 1)
            while v >= 32:
                out.append(chr((v & 31 | 32) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def hilbert_key(x, y, order: int = 16):
    """Place of cells on a Hilbert curve, for arrays of whole numbers below ``2 ** order``."""
    import numpy as np

    x, y = np.asarray(x, np.int64).copy(), np.asarray(y, np.int64).copy()
    d, s = np.zeros_like(x), 1 << (order - 1)
    while s:
        rx, ry = (x & s > 0).astype(np.int64), (y & s > 0).astype(np.int64)
        d += s * s * (3 * rx ^ ry)
        flip = (ry == 0) & (rx == 1)
        x, y = np.where(flip, (1 << order) - 1 - x, x), np.where(flip, (1 << order) - 1 - y, y)
        x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        s >>= 1
    return d


def accepted_stations(min_km: float) -> Callable:
    """Stations of one line by importance, each unless an accepted one is nearer than ``min_km``."""
    import math

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("points", "uic", "lon", "lat")), strict=True), key=lambda r: (-r[0], r[1]))
        kept: list[tuple] = []
        for r in rows:
            if all(math.hypot((r[2] - k[2]) * 111.32 * math.cos(math.radians(46.8)), (r[3] - k[3]) * 111.32) >= min_km for k in kept):
                kept.append(r)
        return pa.table({"line_id": [key[0].as_py()] * len(kept), "uic": [k[1] for k in kept]})

    return run
