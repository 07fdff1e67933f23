"""Exact repeats of at least ``width`` bytes: maximal repeat groups from enhanced suffix arrays over buckets.

Every window of ``width`` bytes has a minimizer, its smallest hashed k-gram,
and the windows in a row that share it make one piece. Equal windows have equal
minimizers, so a repeat shows only among pieces of one key, the minimizer's
hash. It is found in three steps.

1. Of each piece its key and a fingerprint are sent, no text. Equal pieces are
   a repeat group as they stand: all but the earliest are repeats. Keys with
   one kind of piece need no more.
2. The other keys' pieces, one of each kind, are sent with their bytes. Keys
   with very many kinds are dealt out by window instead, so that no task holds
   all surroundings of a hot passage.
3. A bucket of keys is a part of the whole suffix array that can be built for
   itself: windows that occur once are dropped, the suffixes are sorted, and a
   stack scan over the common-prefix lengths builds the tree of intervals.
   Those whose occurrences differ in the byte before are the maximal repeat
   groups, with all their occurrences; what they cover follows from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from linienwerk.llm.common import total_bytes, unused
from linienwerk.shared import Stash

#: Bytes of text that are cut at once; longer texts are cut in slices.
_CHUNK = 1 << 20
#: What is said of a piece: an equal one is earlier, or it must be sent as bytes or as windows.
_COVERED, _BYTES, _WINDOWS = 0, 1, 2
_M1, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _M3
    return h ^ h >> np.uint64(29)


class _Rolling:
    """Fingerprints of slices from prefix sums of mixed bytes times powers of an odd base, modulo 2**64."""

    def __init__(self, seed: int):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 1) % (1 << 64)
        # a polynomial modulo 2**64 alone is weak on structured text
        self.table = np.array([(x * 0xD6E8FEB86659FD93 + seed) * (2 * x + 1) % (1 << 64) | 1 for x in range(256)], np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(max(len(data), 1 << 12), np.uint64(b))))) for b in (self.base, pow(self.base, -1, 1 << 64)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=total[1:])
        return total

    def of(self, total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((total[end] - total[begin]) * self.down[begin])

    def windows(self, total: np.ndarray, width: int) -> np.ndarray:
        n = max(0, len(total) - width)
        return _mix((total[width:] - total[:n]) * self.down[:n])


_ONE, _TWO = _Rolling(0x2545F4914F6CDD1D), _Rolling(0x3C6EF372FE94F82B)


def gram_of(width: int) -> int:
    """Longer grams mean fewer chance meetings, shorter ones fewer pieces."""
    return max(4, width * 8 // 25)


def minimizers(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` hashes the place of the smallest, the leftmost of equal ones."""
    key, step = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * step <= span:  # smallest over a power of two, then two of these overlap
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if span > step:
        key = np.minimum(key[: len(key) - (span - step)], key[span - step :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class _Chunk:
    """The pieces of some slices of texts: ``doc``, ``start`` in it, ``size``, ``begin`` in ``data``, ``key`` and fingerprint ``fp``."""

    def __init__(self, slices: list[tuple[int, int, bytes]], width: int):
        """A slice: doc_id, where it starts in its text, its bytes."""
        sizes = np.array([len(s[2]) for s in slices], np.int64)
        first = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(s[2] for s in slices), np.uint8)
        self.total, gram = _ONE.sums(self.data), gram_of(width)
        h = _ONE.windows(self.total, gram)
        at = minimizers(h, width - gram + 1)
        which = np.repeat(np.arange(len(slices), dtype=np.int32), sizes)
        ok = np.flatnonzero(which[: len(at)] == which[width - 1 :])  # windows that lie within one slice
        new = np.ones(len(ok), bool)
        new[1:] = (at[ok[1:]] != at[ok[:-1]]) | (which[ok[1:]] != which[ok[:-1]])
        self.begin = ok[new]
        end = ok[np.append(np.flatnonzero(new)[1:], len(ok)) - 1] + width if len(ok) else ok
        self.size = end - self.begin
        of = which[self.begin]
        self.doc = np.array([s[0] for s in slices], np.int64)[of]
        self.start = self.begin - first[of] + np.array([s[1] for s in slices], np.int64)[of]
        self.key = h[at[self.begin]]
        self.end = end

    def any_bucket(self, n: int) -> int:
        """Where to send what any bucket may pass on: the first piece picks one, so that chunks which hold the same hot text part."""
        return zlib.crc32(np.array([self.doc[0], self.start[0]]).tobytes()) % n

    def prints_of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of slices of ``data``."""
        return _ONE.of(self.total, begin, end), _TWO.of(_TWO.sums(self.data), begin, end)

    def prints(self) -> np.ndarray:
        return _TWO.of(_TWO.sums(self.data), self.begin, self.end) ^ self.size.astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[tuple[int, int, bytes]], list]]:
    """Slices of about a chunk, and the rows they come from. Slices overlap so that each window lies in one of them."""
    slices, rows, room = [], [], 0
    for b in batches:
        for r in range(b.num_rows):
            doc, text = b.column(0)[r].as_py(), b.column(1)[r]
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for a in range(0, len(raw) - width + 1, _CHUNK):
                part = raw[a : a + _CHUNK + width - 1] if len(raw) > _CHUNK else raw
                if room + len(part) > _CHUNK and slices:
                    yield slices, rows
                    slices, rows, room = [], [], 0
                slices.append((doc, a, part))
                rows.append((b, r))
                room += len(part)
    if slices:
        yield slices, rows


def _pack(*columns: np.ndarray, tail: bytes = b"") -> bytes:
    """Columns of 64-bit numbers, byte plane by byte plane, and bytes after them."""
    planes = np.ascontiguousarray(np.stack([c.astype(np.int64, copy=False) if c.dtype != np.uint64 else c.view(np.int64) for c in columns])).view(np.uint8)
    return zstandard.compress(np.array([len(columns[0])], "<i8").tobytes() + planes.reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes() + tail, 1)


def _unpack(blob: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    cols = np.ascontiguousarray(np.frombuffer(raw, np.uint8, columns * 8 * n, 8).reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)
    return cols, np.frombuffer(raw, np.uint8, offset=8 + 8 * columns * n)


def _joined(t: pa.Table, kind: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and tails of all blobs of a kind."""
    got = [_unpack(b.as_py(), columns) for k, b in zip(t.column("kind").to_pylist(), t.column("blob"), strict=True) if k == kind]
    if not got:
        return np.empty((columns, 0), np.int64), np.empty(0, np.uint8)
    return np.concatenate([g[0] for g in got], axis=1), np.concatenate([g[1] for g in got])


_BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOB, strict=True)], schema=_BLOB)


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    """By the lower bits, as the upper ones of a smallest hash are small."""
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parts(bucket: np.ndarray, some: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The chosen places by their bucket."""
    by = some[np.argsort(bucket[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    for a, b in zip(cuts, np.append(cuts, len(by))[1:], strict=True):
        yield int(bucket[by[a]]), by[a:b]


def _first(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, the first of them last in weight but two, and which places of it begin a new value of all but the last two keys' (doc, start)."""
    by = np.lexsort(keys[::-1])
    new = np.ones(len(by), bool)
    new[1:] = np.logical_or.reduce([k[by[1:]] != k[by[:-1]] for k in keys[:-2]])
    return by, new


def _runs(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> bytes:
    """The bytes of many slices, one after another."""
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()


_ANSWER = "doc_id long, start long, length long, mode int, of_doc long, of_start long"


def _asked(rows: DataFrame, width: int, n_buckets: int, hot_kinds: int, named: bool) -> DataFrame:
    """``(doc_id, text) → _ANSWER``: what is known of the pieces that others equal, or may overlap.

    A covered piece names the earliest one that it equals. If they needn't be
    ``named``, covered pieces of a text and chunk are merged where they touch.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices, _ in _chunks(batches, width):
            c = _Chunk(slices, width)
            fp = c.prints()
            by, new = _first(c.key, fp, c.doc, c.start)
            out, again = [], by[~new]
            if len(again):
                # of equal pieces the earliest is asked for; the others' answer is known, and passes through any bucket
                of = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))][~new]
                spans = c.doc[again], c.start[again], c.size[again]
                spans = (*spans, c.doc[of], c.start[of]) if named else (*(m := _merged(*spans)), *(np.full(len(m[0]), -1),) * 2)
                out.append((c.any_bucket(n_buckets), 1, _pack(*spans)))
            bucket = _buckets(c.key, n_buckets)
            out += [(k, 0, _pack(c.key[p], fp[p], c.doc[p], c.start[p], c.size[p])) for k, p in _parts(bucket, by[new])]
            yield _blobs(out)

    def answer(_: tuple, t: pa.Table) -> pa.Table:
        (key, fp, doc, start, size), _ = _joined(t, 0, 5)
        told, _ = _joined(t, 1, 5)
        by, new = _first(key, fp, doc, start)
        key, doc, start, size = key[by], doc[by], start[by], size[by]
        of = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) if len(by) else by
        cut = np.flatnonzero(np.diff(key, prepend=key[:1] ^ 1))
        kinds = np.repeat(np.add.reduceat(new.astype(np.int64), cut), np.diff(np.append(cut, len(key)))) if len(by) else by
        say = np.flatnonzero(~new | (kinds > 1))
        mode = np.where(new[say], np.where(kinds[say] > hot_kinds, _WINDOWS, _BYTES), _COVERED)
        rows = np.concatenate((told, (doc[say], start[say], size[say], doc[of[say]], start[of[say]])), axis=1)
        mode = np.append(np.full(told.shape[1], _COVERED), mode)
        return pa.table([*(pa.array(x, pa.int64()) for x in rows[:3]), pa.array(mode, pa.int32()), *(pa.array(x, pa.int64()) for x in rows[3:])], names=["doc_id", "start", "length", "mode", "of_doc", "of_start"])

    return rows.mapInArrow(ask, "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(answer, _ANSWER)


def _sent(rows: DataFrame, answers: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """Texts and answers → blobs of spans that are known (kind 0), pieces (1) and windows (2) by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices, rows in _chunks(batches, width):
            c = _Chunk(slices, width)
            docs, of = np.unique(c.doc, return_inverse=True)
            asked = {s[0]: b.column(2)[r].values.to_numpy(zero_copy_only=False) for s, (b, r) in zip(slices, rows, strict=True)}
            asked = np.sort(np.concatenate([(k << 44) + asked[d] for k, d in enumerate(docs.tolist())]))
            place = (of << 43) + c.start
            at = np.minimum(np.searchsorted(asked >> 1, place), len(asked) - 1)
            mode = np.where(asked[at] >> 1 == place, asked[at] & 1, -1)
            out, hot = [], np.flatnonzero(mode == 1)
            if len(hot):
                n = c.size[hot] - width + 1
                which = np.repeat(hot, n)
                inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                begin, doc, start = c.begin[which] + inner, c.doc[which], c.start[which] + inner
                one, two = c.prints_of(begin, begin + width)
                by, new = _first(one, two, doc, start)
                late = by[~new]
                if len(late):
                    out.append((c.any_bucket(n_buckets), 0, _pack(*_merged(doc[late], start[late], np.full(len(late), width)))))
                out += [(k, 2, _pack(one[p], two[p], doc[p], start[p])) for k, p in _parts(_buckets(one, n_buckets), by[new])]
            for k, p in _parts(_buckets(c.key, n_buckets), np.flatnonzero(mode == 0)):
                out.append((k, 1, _pack(c.doc[p], c.start[p], c.size[p], tail=_runs(c.data, c.begin[p], c.size[p]))))
            if out:
                yield _blobs(out)

    # a piece's start, and whether it is sent as windows
    asked = answers.where(F.col("mode") != _COVERED).groupBy("doc_id").agg(F.collect_list(F.col("start") * 2 + (F.col("mode") == _WINDOWS).cast("long")).alias("asked"))
    return rows.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(send, "bucket int, kind int, blob binary")


class RepeatTree:
    """Maximal repeat groups of some pieces: intervals of the common-prefix tree of their suffixes.

    ``string`` and ``start`` are suffixes, ``group`` the smallest group that
    each belongs to; ``depth`` is a group's length and ``parent`` the group
    that holds all its occurrences and more, or -1. ``rank`` orders the pieces
    by (text, start).
    """

    def __init__(self, buffer: np.ndarray, offset: np.ndarray, length: np.ndarray, rank: np.ndarray, width: int):
        self.rank = rank
        self.string = self.start = self.group = self.depth = self.parent = np.empty(0, np.int64)
        picked = self._picked(buffer, offset, length, width)
        if picked is not None:
            self._build(buffer, offset, length, *picked, width)

    @staticmethod
    def _picked(buffer: np.ndarray, offset: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Suffixes that may begin a maximal repeat: their window occurs again, after another byte. A byte of -1 marks a piece's start."""
        n = length - width + 1
        which = np.repeat(np.arange(len(length)), n)
        if not len(which):
            return None
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = offset[which] + inner
        h = _ONE.windows(_ONE.sums(buffer), width)[at]
        by = np.argsort(h, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = h[by[1:]] != h[by[:-1]]
        cut = np.flatnonzero(new)
        count = np.diff(np.append(cut, len(by)))
        before = np.where(inner > 0, buffer[np.maximum(at - 1, 0)].astype(np.int64), -1)[by]
        diverse = (np.minimum.reduceat(before, cut) != np.maximum.reduceat(before, cut)) | (np.minimum.reduceat(before, cut) < 0)
        keep = np.repeat(diverse & (count > 1), count)
        pick = by[keep]
        return (which[pick], inner[pick], before[keep]) if len(pick) else None

    def _build(self, buffer: np.ndarray, offset: np.ndarray, length: np.ndarray, string: np.ndarray, start: np.ndarray, before: np.ndarray, width: int) -> None:
        sa, lcp = suffix_array(buffer, offset, length, string, start)
        self.string, self.start = string[sa], start[sa]
        before, m = before[sa].tolist(), len(sa)
        lcps = [*lcp.tolist(), 0]
        own = [-1] * m
        depth, parent, low, high, stack = [], [], [], [], []

        def widen(v: int, a: int, b: int) -> None:
            low[v], high[v] = min(low[v], a), max(high[v], b)

        for i in range(m + 1):
            d, inside = lcps[i], -1
            while stack and depth[stack[-1]] > d:
                v = stack.pop()
                if stack and depth[stack[-1]] >= d:
                    parent[v] = stack[-1]
                    widen(stack[-1], low[v], high[v])
                else:
                    inside = v
            if d >= width and (not stack or depth[stack[-1]] < d):
                v = len(depth)
                depth.append(d)
                parent.append(-1)
                low.append(1 << 30)
                high.append(-2)
                if inside >= 0:
                    parent[inside] = v
                    widen(v, low[inside], high[inside])
                else:
                    own[i - 1] = v
                    widen(v, before[i - 1], before[i - 1])
                stack.append(v)
            if i < m and stack and lcps[i + 1] <= d:
                own[i] = stack[-1]
                widen(stack[-1], before[i], before[i])
        # intervals that go on to the left alike are no groups; what they hold belongs to the next one above
        up = list(range(len(depth)))
        for v in sorted(range(len(depth)), key=depth.__getitem__):
            if low[v] == high[v] and low[v] >= 0:
                up[v] = up[parent[v]] if parent[v] >= 0 else -1
        self.depth = np.array(depth, np.int64)
        self.parent = np.array([up[p] if p >= 0 else -1 for p in parent], np.int64)
        self.group = np.array([up[v] if v >= 0 else -1 for v in own], np.int64)
        some = self.group >= 0
        self.string, self.start, self.group = self.string[some], self.start[some], self.group[some]

    def covers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(string, start, length)`` of every occurrence but the earliest, in the longest group where it isn't."""
        by = np.lexsort((self.start, self.rank[self.string], self.group))
        g = self.group[by]
        new = np.ones(len(by), bool)
        new[1:] = g[1:] != g[:-1]
        late, length = [by[~new]], [self.depth[g[~new]]]
        earliest = dict(zip(g[new].tolist(), by[new].tolist(), strict=True))
        order = lambda k: (self.rank[self.string[k]], self.start[k])
        up_late, up_length = [], []
        used = np.unique(np.concatenate((g, self.parent[self.parent >= 0]))) if len(g) else g
        for v in used[np.argsort(-self.depth[used], kind="stable")].tolist():
            k, p = earliest.get(v), int(self.parent[v])
            if k is None or p < 0:
                continue
            other = earliest.get(p)
            if other is not None:
                k, out = (k, other) if order(k) < order(other) else (other, k)
                up_late.append(out)
                up_length.append(int(self.depth[p]))
            earliest[p] = k
        late = np.concatenate((*late, np.array(up_late, np.int64)))
        return self.string[late], self.start[late], np.concatenate((*length, np.array(up_length, np.int64)))


def suffix_array(buffer: np.ndarray, offset: np.ndarray, length: np.ndarray, string: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their bytes up to their string's end, and the bytes that each shares with the one before."""
    size = length[string] - start
    n_words = int(-(-size.max() // 8))
    padded = np.concatenate((buffer, np.zeros(8 * n_words + 8, np.uint8)))
    # 8 bytes a column, read where the suffix still has them
    cols = np.empty((n_words, len(string)), np.uint64)
    at = offset[string] + start
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(n_words):
        word = view[at + 8 * k].copy().view(">u8").ravel().astype(np.uint64)
        have = np.clip(size - 8 * k, 0, 8)
        cols[k] = np.where(have >= 8, word, np.where(have <= 0, np.uint64(0), word >> ((8 - have) * 8 % 64).astype(np.uint64) << ((8 - have) * 8 % 64).astype(np.uint64)))
    sa = np.lexsort(cols[::-1])
    cols, size, m = cols[:, sa], size[sa], len(sa)
    lcp = np.zeros(m, np.int64)
    diff = cols[:, 1:] ^ cols[:, :-1]
    some = diff != 0
    word = np.where(some.any(0), some.argmax(0), n_words)
    x = np.where(word < n_words, diff[np.minimum(word, n_words - 1), np.arange(m - 1)], np.uint64(0))
    lead = np.zeros(m - 1, np.int64)
    for b in (32, 16, 8):  # leading zero bytes of x
        zero = x >> np.uint64(64 - b) == 0
        lead += np.where(zero, b // 8, 0)
        x = np.where(zero, x << np.uint64(b), x)
    lcp[1:] = np.minimum(np.minimum(np.where(word < n_words, 8 * word + lead, 8 * n_words), size[1:]), size[:-1])
    return sa, lcp


def _merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each text, those that touch made one."""
    if not len(doc):
        return doc, start, length
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], (start + length)[by]
    far = doc.copy() - doc.min()
    _, text = np.unique(far, return_inverse=True)
    step = int(end.max()) + 2
    reach = np.maximum.accumulate(end + text * step)
    new = np.concatenate(([True], start[1:] + text[1:] * step > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - text[first] * step - start[first]


def _tree(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, RepeatTree]:
    """The tree of a bucket's pieces, with their doc_ids and starts."""
    (doc, start, size), data = _joined(t, 1, 3)
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((start, doc))] = np.arange(len(doc))
    return doc, start, RepeatTree(data, np.cumsum(size) - size, size, rank, width)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _stages(docs: DataFrame, stash: Stash, width: int, bucket_bytes: int, hot_kinds: int, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """The answers about pieces, and the blobs that go to buckets."""
    rows, conf = _texts(docs), docs.sparkSession.conf
    least = int(conf.get("spark.sql.shuffle.partitions"))
    # a piece's key, fingerprint and place are about a fifth of its text
    answers = stash.put(_asked(rows, width, max(least, total_bytes(rows, "text") // (32 * bucket_bytes)), hot_kinds, named))
    modes = {r.mode: r.n for r in answers.groupBy("mode").agg(F.count("*").alias("n")).collect()}
    sent = modes.get(_BYTES, 0) * 3 * width // 2 + modes.get(_WINDOWS, 0) * 12 * width
    return answers, _sent(rows, answers, width, max(least, sent // bucket_bytes))


def covered_spans(docs: DataFrame, width: int = 100, bucket_bytes: int = 1 << 20, hot_kinds: int = 1 << 14) -> DataFrame:
    """``(doc_id, text) → (doc_id, start, length)``: byte spans that repeat an earlier string of at least ``width`` bytes.

    Spans may overlap. Rows with a null doc_id or text are left out. Doc_ids
    must be distinct; see ``dedup_repeats`` for equal rows. Pieces of a key
    with over ``hot_kinds`` kinds are dealt out by window. Pieces are taken as
    equal if their lengths and 128 bits of fingerprints are.
    """
    stash = Stash(docs.sparkSession, "repeats")
    answers, sent = _stages(docs, stash, width, bucket_bytes, hot_kinds)

    def scan(_: tuple, t: pa.Table) -> pa.Table:
        known, _ = _joined(t, 0, 3)
        doc, start, tree = _tree(t, width)
        string, inner, cover = tree.covers()
        (one, two, w_doc, w_start), _ = _joined(t, 2, 4)
        by, new = _first(one, two, w_doc, w_start)
        late = by[~new]
        spans = [np.concatenate(x) for x in ((known[0], doc[string], w_doc[late]), (known[1], start[string] + inner, w_start[late]), (known[2], cover, np.full(len(late), width)))]
        return pa.table([pa.array(x, pa.int64()) for x in _merged(*spans)], names=["doc_id", "start", "length"])

    spans = stash.put(sent.groupBy("bucket").applyInArrow(scan, "doc_id long, start long, length long"))
    return answers.where(F.col("mode") == _COVERED).select("doc_id", "start", "length").unionByName(spans)


def repeat_groups(docs: DataFrame, width: int = 100, bucket_bytes: int = 1 << 20) -> DataFrame:
    """``(doc_id, text) → (group_id, parent_id, length, doc_id, start)``: maximal repeats with all their occurrences.

    An occurrence is a row of its longest group; it also belongs to the groups
    above, as a parent holds all occurrences of its children and more. Repeats
    longer than a piece come as groups of overlapping parts, and a piece that
    has copies is a group of its own. Rows that repeat a doc_id count once;
    null doc_ids and texts have no occurrences.
    """
    stash = Stash(docs.sparkSession, "groups")
    answers, sent = _stages(_texts(docs).dropDuplicates(["doc_id"]), stash, width, bucket_bytes, 1 << 62, named=True)

    def scan(key: tuple, t: pa.Table) -> pa.Table:
        doc, start, tree = _tree(t, width)
        name = lambda g: [f"{key[0].as_py()}:{x}" if x >= 0 else None for x in g.tolist()]
        cols = [pa.array(name(tree.group), pa.string()), pa.array(name(tree.parent[tree.group]), pa.string())]
        cols += [pa.array(x, pa.int64()) for x in (tree.depth[tree.group], doc[tree.string], start[tree.string], tree.start)]
        return pa.table(cols, names=["group_id", "parent_id", "length", "of_doc", "of_start", "inner"])

    tree = stash.put(sent.groupBy("bucket").applyInArrow(scan, "group_id string, parent_id string, length long, of_doc long, of_start long, inner long"))
    # the first of a chunk, which its copies there name, may be a copy itself
    named = answers.where(F.col("mode") == _COVERED)
    root = named.select(F.col("doc_id").alias("of_doc"), F.col("start").alias("of_start"), F.col("of_doc").alias("root_doc"), F.col("of_start").alias("root_start"))
    copies = named.join(root, ["of_doc", "of_start"], "left").select("doc_id", "start", "length", F.coalesce("root_doc", "of_doc").alias("of_doc"), F.coalesce("root_start", "of_start").alias("of_start"))
    copies = stash.put(copies.unionByName(copies.select(F.col("of_doc").alias("doc_id"), F.col("of_start").alias("start"), "length", "of_doc", "of_start").distinct()))
    first = tree.join(copies.select("of_doc", "of_start").distinct(), ["of_doc", "of_start"], "left_anti").select("group_id", "parent_id", "length", F.col("of_doc").alias("doc_id"), (F.col("of_start") + F.col("inner")).alias("start"))
    more = tree.join(copies.drop("length"), ["of_doc", "of_start"]).select("group_id", "parent_id", "length", "doc_id", (F.col("start") + F.col("inner")).alias("start"))
    whole = copies.select(F.concat_ws("-", "of_doc", "of_start").alias("group_id"), F.lit(None).cast("string").alias("parent_id"), "length", "doc_id", "start")
    return first.unionByName(more).unionByName(whole)


def _numbered(docs: DataFrame, name: str, stash: Stash) -> DataFrame:
    """``docs + name``: whole numbers in the order of doc_id and the text's SHA-1, alike for equal rows; null for a null doc_id."""
    sha = unused(docs, "sha")
    rows = docs.withColumn(sha, F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    # ranges, each sorted, and written: numbers that rise with the partition and the place in it follow the order
    keys = rows.where("doc_id is not null").select("doc_id", sha).distinct().repartitionByRange("doc_id", sha).sortWithinPartitions("doc_id", sha)
    keys = stash.put(keys.withColumn(name, F.monotonically_increasing_id()))
    return rows.join(keys, ["doc_id", sha], "left").drop(sha)


def dedup_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs → docs' columns + (bytes, spans, kept)``: texts without their later repeats.

    ``spans`` are the maximal removed runs (start, length in bytes), ``kept``
    is what is left as binary. A byte goes if a string of ``width`` bytes over
    it also starts earlier: in a smaller doc_id, or earlier in the same text.
    Strings are judged on the input.

    A null text is empty; a text shorter than ``width`` is kept; null doc_ids
    take no part and are kept; rows that repeat a doc_id and its text count
    once and come back alike; different texts of one doc_id are documents of
    their own, in the order of their SHA-1; an empty table gives no rows.
    Columns named bytes, spans or kept are replaced.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "repeats")
    own = [c for c in docs.columns if c not in ("bytes", "spans", "kept")]
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("n > 1")
    # texts that are null and others count as different
    clash, any_twice = twice.agg(F.max(~F.col("a").eqNullSafe(F.col("b"))), F.count("*")).first()
    num = unused(docs, "num")
    rows = _numbered(docs, num, stash) if clash else docs.withColumn(num, F.col("doc_id"))
    texts = rows.select(F.col(num).alias("doc_id"), "text")
    spans = covered_spans(texts.dropDuplicates(["doc_id"]) if any_twice else texts, width)
    by = Window.partitionBy("doc_id").orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(by)
    merged = spans.withColumn("reach", reach).withColumn("isle", isle).groupBy("doc_id", "isle").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    key = unused(docs, "of_doc")
    merged = merged.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length")))).alias("spans"))
    merged = stash.put(merged)
    stash.drop(spans)
    d = rows.select(*own, num, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    out = d.join(merged, d[num] == merged[key], "left").drop(key, num)
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>")))
    return out.withColumn("kept", kept_bytes(F.col("bytes"), F.col("spans")))


def kept_bytes(data: Column, spans: Column) -> Column:
    """The bytes outside the spans, one after another. Text and spans are worked out once and then bound by a lambda."""

    def cut(x: Column) -> Column:
        d, s = x["d"], x["s"]
        end = lambda i: F.coalesce(F.get(s, i)["start"] + F.get(s, i)["length"], F.lit(0)).cast("int")
        part = lambda i: F.hex(F.substring(d, end(i - 1) + 1, F.coalesce(F.get(s, i)["start"].cast("int"), F.octet_length(d)) - end(i - 1)))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), part), ""))

    bound = F.transform(F.array(F.struct(data.alias("d"), spans.alias("s"))), cut)
    return F.when(F.size(spans) == 0, data).otherwise(bound[0])
