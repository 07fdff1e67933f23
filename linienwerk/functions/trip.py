"""Column functions on journeys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType


def walk_cost(walk_s: Column) -> Column:
    return 2.0 * F.least(walk_s, F.lit(1800)) + 0.5 * F.greatest(walk_s - 1800, F.lit(0))


def itinerary_score(walk_s: Column, boardings: Column) -> Column:
    return 600.0 * boardings + walk_cost(walk_s)


def comfort_factor(walk_s: Column, boardings: Column) -> Column:
    t = walk_s / 60.0
    return 1 + 0.1 * (t * t / (t * t + 900.0) + 1 - F.pow(F.lit(0.7), boardings))


def distance_decay(km: Column) -> Column:
    return 100.0 * F.exp(-km / 30.0)


@F.pandas_udf(LongType())
def _djb2(texts: pd.Series) -> pd.Series:
    """All texts of a batch at once: each code point times a power of 33 by its place from the end, summed modulo 2^32."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    powers = np.cumprod(np.append(np.uint32(1), np.full(n.max(initial=0), 33, np.uint32)), dtype=np.uint32)
    ends = np.cumsum(n)
    terms = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) * powers[np.repeat(ends, n) - 1 - np.arange(n.sum())]
    sums = np.append(np.uint32(0), np.cumsum(terms, dtype=np.uint32))
    return pd.Series((np.uint32(5381) * powers[n] + sums[ends] - sums[ends - n]).astype(np.int64))


def djb2(payload: Column) -> Column:
    """32-bit hash of a text, by its code points, as 8 hex digits."""
    h = F.when(payload.isNotNull(), _djb2(F.coalesce(payload, F.lit(""))))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def content_id(members: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.sort_array(members), ",").cast("binary"), 256), 1, 8)


def shard_of(route_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(route_id.cast("string").cast("binary")), F.lit(n)).cast("long")


#: Digits of base 62 (fixed values).
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def share_id(fingerprint: Column, origin: Column, target: Column) -> Column:
    """Eight characters of base 62 from a hash of journey and endpoints."""
    h = F.sha2(F.concat_ws("|", fingerprint, origin, target).cast("binary"), 256)
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.substr(F.lit(BASE62), byte(k) % 62 + 1, F.lit(1)) for k in range(8)])
