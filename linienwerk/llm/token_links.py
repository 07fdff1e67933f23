"""Which tokens of two vocabularies stand for the same bytes, document by document, and how common each link is.

Byte offsets where tokens of both vocabularies end cut a document into groups;
a token of one is linked with each token of the other in its group. The work
is done on Arrow columns of many documents at once: token lists are flattened
with their parents, byte ends are cumulative sums within a parent, common ends
come from a hash join, and equal links are counted by grouping. Counts of a
block of documents are merged by Spark.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from linienwerk.llm.common import unused
from linienwerk.llm.token_counts import byte_letters
from linienwerk.llm.tokens import PieceEncoder
from linienwerk.shared import Stash

#: Characters of texts that are aligned at a time, and those of a block, whose links are counted together.
UNIT, BLOCK = 1 << 19, 1 << 22
#: Between two letters and a space both vocabularies certainly cut.
_CUT = re.compile(r"[A-Za-z](?= [A-Za-z])")


def parts(text: str, size: int = UNIT) -> list[str]:
    """A text with a space before it, cut where no token of either vocabulary can stand across, a part for about ``size`` characters."""
    text, out, at = " " + text, [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return out


class PieceModel:
    """Encodes parts of texts with a ``sentencepiece`` file of the BPE kind whose pieces have spaces in front only.

    A space after something else then begins a piece, so that words are encoded
    for themselves and looked up in a bounded cache. ValueError for other files.
    """

    _loaded: dict[str, "PieceModel"] = {}

    def __init__(self, path: str, max_words: int = 300_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache: dict[str, bytes] = {}
        self.max_words = max_words
        pieces = [m.id_to_piece(k) for k in range(m.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or m.encode("a  b ", out_type=str) != ["▁a", "▁", "▁b", "▁"]:
            raise ValueError("pieces may go on over a space, or white space is changed")
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.space = m.piece_to_id("▁")
        #: Characters that stand next to each other in a piece.
        self.joined = {p[i : i + 2] for k, p in enumerate(pieces) if not m.is_byte(k) for i in range(len(p) - 1)}

    @classmethod
    def of(cls, path: str) -> "PieceModel":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of parts that begin with a space."""
        if len(self.cache) > self.max_words:
            self.cache = {}
        words = [t[1:].split(" ") if "  " not in t else [w[1:] for w in re.findall(" +[^ ]*", t)] for t in texts]
        new = set().union(*words).difference(self.cache)
        short = [w for w in new if 0 < len(w) <= 1 << 16]
        self.cache.update(zip(short, [array("i", x).tobytes() for x in self.model.encode(short, num_threads=1)], strict=True))
        long = [w for w in new if len(w) > 256]
        self.cache |= {w: array("i", self._long(w)).tobytes() for w in long if len(w) > 1 << 16}
        self.cache[""] = array("i", [self.space]).tobytes()
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, ws)), np.intc) for ws in words]
        for w in long:
            del self.cache[w]
        return out

    def _long(self, word: str) -> list[int]:
        """A very long word, cut between characters that no piece has side by side; a line feed, which is no piece, keeps the first off the word's start."""
        at = [0]
        for i in range(1, len(word)):
            if i - at[-1] >= 4096 and word[i - 1 : i + 1] not in self.joined and word[i] != " " and word[i - 1] != " ":
                at.append(i)
        if "\n" in "".join(self.joined):
            at = [0]
        cut = [word[a:b] for a, b in zip(at, [*at[1:], len(word)], strict=True)]
        out = list(self.model.encode(cut[0]))
        for c in cut[1:]:
            out += self.model.encode("\n" + c)[2:]
        return out


class Aligner:
    """Aligns texts in two vocabularies; one for a Python worker."""

    _loaded: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PieceEncoder.of(path_a, "byte", special=False), PieceModel.of(path_b)
        byte = {c: k for k, c in enumerate(byte_letters())}
        vocab = self.a.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, k in vocab.items():
            tokens[k] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.bytes_a, self.bytes_b = pa.array(tokens, pa.binary()), pa.array(self.b.bytes, pa.binary())
        self.size_a, self.size_b = (pc.binary_length(x).cast(pa.int64()) for x in (self.bytes_a, self.bytes_b))
        #: Each id as decimal digits with what may follow it.
        self.digits = pa.array([f"{k}{s}".encode() for k in range(max(len(tokens), len(self.b.bytes))) for s in ",|;"], pa.binary())

    @classmethod
    def of(cls, path_a: str, path_b: str) -> "Aligner":
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def side(self, ids: list[np.ndarray], size: pa.Array, place: str) -> pa.Table:
        """``(part, id, end, place)`` of every token: its part, that part and the byte where it ends there, and its number."""
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
        flat, part = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(size.take(flat))
        # within a part: less what the parts before it have
        starts = np.cumsum([0, *(len(x) for x in ids)])[:-1]
        before = pc.subtract(total, size.take(flat)).take(pa.array(np.minimum(starts, max(len(flat) - 1, 0))))
        return pa.table({"part": part.cast(pa.int32()), "id": flat, "end": pc.add(pc.shift_left(part.cast(pa.int64()), 40), pc.subtract(total, before.take(part))), place: pa.array(np.arange(len(flat), dtype=np.int32))})

    def align(self, texts: list[str]) -> tuple[list[dict | None], pa.Table]:
        """For each part its figures, or None where its tokens don't give its bytes; and ``(part, a, b, m)``: links and how often they occur."""
        raw = [t.encode() for t in texts]
        ids_a, ids_b = [np.frombuffer(x, self.a.dtype) for x in self.a.many(texts)], self.b.many(texts)
        fit = np.flatnonzero(_same(self.bytes_a, ids_a, raw) & _same(self.bytes_b, ids_b, raw)).tolist()
        if not fit:
            return [None] * len(texts), _NO_LINKS
        ids_a, ids_b = [ids_a[k] for k in fit], [ids_b[k] for k in fit]
        a, b = self.side(ids_a, self.size_a, "i"), self.side(ids_b, self.size_b, "j")
        both = a.select(["end", "i"]).join(b.select(["end", "j"]), "end", join_type="inner", use_threads=False)
        ga, gb = _groups(both["i"], len(a)), _groups(both["j"], len(b))
        na, nb = np.bincount(ga), np.bincount(gb)
        last_a, last_b = np.cumsum(na), np.cumsum(nb)
        part = a["part"].to_numpy()[last_a - 1]
        n_groups, n_links = np.bincount(part, minlength=len(fit)), np.zeros(len(fit), np.int64)
        np.add.at(n_links, part, na * nb)
        # digits in the order of the groups, those of the first vocabulary before those of the second
        at_a, at_b = np.arange(len(a)) + (last_b - nb)[ga], np.arange(len(b)) + last_a[gb]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[at_a], codes[at_b] = a["id"].to_numpy() * 3 + (np.arange(len(a)) == last_a[ga] - 1), b["id"].to_numpy() * 3 + 2 * (np.arange(len(b)) == last_b[gb] - 1)
        text = self.digits.take(pa.array(codes))
        ends = np.frombuffer(text.buffers()[1], np.int32)[np.cumsum([0, *(len(x) + len(y) for x, y in zip(ids_a, ids_b, strict=True))])]
        said = memoryview(text.buffers()[2])
        out: list[dict | None] = [None] * len(texts)
        for p, k in enumerate(fit):
            out[k] = {"n_a": len(ids_a[p]), "n_b": len(ids_b[p]), "n_groups": int(n_groups[p]), "n_links": int(n_links[p]), "said": said[ends[p] : ends[p + 1] - 1]}
        return out, _links(a, b, ga, gb, na, nb, np.asarray(fit, np.int32)[part])


_NO_LINKS = pa.table({"part": pa.array([], pa.int32()), "pair": pa.array([], pa.int64()), "m": pa.array([], pa.int64())})


def _same(tokens: pa.Array, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Of each part whether its tokens' bytes, one after another, are its own."""
    _, offsets, data = tokens.take(pa.array(np.concatenate(ids).astype(np.int32))).buffers()
    ends = np.frombuffer(offsets, np.int32)[np.cumsum([0, *map(len, ids)])].tolist() if data is not None else [0] * (len(ids) + 1)
    joined = memoryview(data).cast("B") if data is not None else memoryview(b"")
    return np.array([e > s and joined[s:e] == r for s, e, r in zip(ends[:-1], ends[1:], raw, strict=True)])


def _groups(closing: pa.ChunkedArray, n: int) -> np.ndarray:
    """The group of each of n tokens, of which some close one."""
    flag = np.zeros(n, np.int64)
    flag[closing.to_numpy()] = 1
    return np.cumsum(flag) - flag


def _links(a: pa.Table, b: pa.Table, ga: np.ndarray, gb: np.ndarray, na: np.ndarray, nb: np.ndarray, part: np.ndarray) -> pa.Table:
    """Links with how often they occur in their part. Equal ids of a group are counted before they meet, so that no group gives all its pairs."""
    one = (na == 1) & (nb == 1)
    x, y = a["id"].to_numpy().astype(np.int64), b["id"].to_numpy().astype(np.int64)
    plain = pa.table({"part": part[one], "pair": x[one[ga]] << 32 | y[one[gb]], "m": np.ones(int(one.sum()), np.int64)})
    count = lambda g, v, c, n: pa.table({"g": g, v: c}).group_by(["g", v], use_threads=False).aggregate([([], "count_all")]).rename_columns(["g", v, n])
    more = count(ga[~one[ga]], "a", x[~one[ga]], "ma").join(count(gb[~one[gb]], "b", y[~one[gb]], "mb"), "g", join_type="inner", use_threads=False)
    rest = pa.table({"part": part[more["g"].to_numpy()], "pair": more["a"].to_numpy() << 32 | more["b"].to_numpy(), "m": more["ma"].to_numpy() * more["mb"].to_numpy()})
    return _summed(pa.concat_tables([plain.cast(_NO_LINKS.schema), rest.cast(_NO_LINKS.schema)]))


def _summed(t: pa.Table) -> pa.Table:
    return t.group_by(["part", "pair"], use_threads=False).aggregate([("m", "sum")]).rename_columns(["part", "pair", "m"])


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _aligned(path_a: str, path_b: str, keep: tuple[str, ...], block: int, unit: int):
    """Arrow batches of texts → a row for each with its figures and its links as numbers in its block's list; that list is in the block's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner.of(path_a, path_b), 0
        for b in batches:
            at, text = 0, b.column(b.num_columns - 1)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy()
            while at < b.num_rows:
                # rows up to the block's size, one at least
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), block, "right")))
                rows = _block(aligner, text.slice(at, n), unit)
                one = np.full(len(rows), TaskContext.get().partitionId() << 31 | number)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[:-1]), pa.array(one), *rows.combine_chunks().to_batches()[0].columns], [*keep, "block", *rows.column_names])
                at, number = at + n, number + 1

    return run


def _block(aligner: Aligner, texts: pa.Array, unit: int) -> pa.Table:
    n = len(texts)
    figures = {k: np.zeros(n, np.int64) for k in _FIGURES}
    sha, bad, links, waiting, size = [None] * n, np.zeros(n, bool), [_NO_LINKS], [], 0

    def flush() -> None:
        if not waiting:
            return
        docs = np.array([k for k, _ in waiting], np.int32)
        found, some = aligner.align([t for _, t in waiting])
        for k, f in zip(docs.tolist(), found, strict=True):
            if f is None:
                bad[k] = True
                continue
            for c in _FIGURES:
                figures[c][k] += f[c]
            if sha[k] is None:
                sha[k] = hashlib.sha256()
            else:
                sha[k].update(b";")
            sha[k].update(f["said"])
        links.append(some.set_column(0, "part", pa.array(docs[some["part"].to_numpy()])))
        if len(links) > 8:
            links[:] = [_summed(pa.concat_tables(links))]
        waiting.clear()

    for k, t in enumerate(texts):
        for p in parts(t.as_py(), unit) if t.is_valid and len(t.as_buffer()) else ():
            waiting.append((k, p))
            size += len(p)
            if size >= unit:
                flush()
                size = 0
    flush()
    for c in _FIGURES:
        figures[c][bad] = 0
    t = pa.concat_tables(links)
    t = _summed(t.filter(pa.array(~bad[t["part"].to_numpy()]))).sort_by("part").combine_chunks()
    coded = t["pair"].combine_chunks().dictionary_encode() if len(t) else pa.DictionaryArray.from_arrays(pa.array([], pa.int32()), pa.array([], pa.int64()))
    pairs, docs_with = coded.dictionary.to_numpy(zero_copy_only=False), np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)) if len(t) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(t["part"].to_numpy(), minlength=n))).astype(np.int32))
    listed = lambda v, kind: pa.ListArray.from_arrays(offsets, pa.array(v, kind))
    first = lambda v: pa.array([v.tolist(), *[None] * (n - 1)], pa.list_(pa.int32()))
    said = [None if h is None or bad[k] else h.hexdigest() for k, h in enumerate(sha)]
    return pa.table({**figures, "groups_sha256": pa.array([h or "" for h in said], pa.string()), "link": listed(coded.indices.to_numpy(), pa.int32()), "times": listed(t["m"].to_numpy(), pa.int64()), "list_a": first(pairs >> 32), "list_b": first(pairs & 0xFFFFFFFF), "list_n": first(docs_with)})


def _scored(keep: tuple[str, ...]):
    """The rows of a block and the corpus-wide figures of its list → the rows with their sums."""

    def run(rows: pa.Table, scores: pa.Table) -> pa.Table:
        n = len(scores)
        count, best = np.zeros(n, np.int64), np.zeros(n, bool)
        at = scores["at"].to_numpy()
        count[at], best[at] = scores["count"].to_numpy(), scores["best"].to_numpy(zero_copy_only=False)
        rows = rows.combine_chunks()
        links, times = rows["link"].combine_chunks(), rows["times"].combine_chunks()
        k, m, part = links.flatten().to_numpy(), times.flatten().to_numpy(), pc.list_parent_indices(links).to_numpy()
        sums = np.zeros((2, len(rows)), np.int64)
        np.add.at(sums[0], part, m * best[k])
        np.add.at(sums[1], part, m * count[k])
        out = {c: rows[c] for c in (*keep, *_FIGURES)} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": rows["groups_sha256"]}
        return pa.table(out)

    return run


def link_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, unit: int = UNIT) -> DataFrame:
    """``keep`` columns ``+ n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: a row for each row.

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a
    ``sentencepiece`` one that adds a space. Null and empty texts, and those
    that one of them doesn't give back byte for byte, have zeros and ''. Each
    row counts as a document, equal rows too; null ids come back; an empty
    table gives no rows; other columns are ignored.

    Rows are aligned in blocks of about ``block`` characters, each with a list
    of its different links, so that a link is shuffled once for a block however
    many of its documents have it. A long text is aligned in parts.
    """
    names = {c: unused(docs, f"_{c}") for c in keep}
    kept = tuple(names.values())
    rows = docs.select(*(F.col(c).alias(k) for c, k in names.items()), F.col(text).alias("text"))
    types = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in kept]
    figures = ", ".join(f"{c} long" for c in _FIGURES)
    schema = ", ".join([*types, "block long", figures, "groups_sha256 string, link array<int>, times array<long>, list_a array<int>, list_b array<int>, list_n array<int>"])
    stash = Stash(docs.sparkSession, "links")
    found = stash.put(rows.mapInArrow(_aligned(path_a, path_b, kept, block, unit), schema))
    lists = found.where("list_a is not null").select("block", F.posexplode(F.arrays_zip("list_a", "list_b", "list_n")).alias("at", "x")).select("block", "at", F.col("x.list_a").alias("a"), F.col("x.list_b").alias("b"), F.col("x.list_n").alias("n"))
    counts = stash.put(lists.groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    scores = lists.drop("n").join(counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "best")
    schema = ", ".join([*types, figures, "n_best long, count_sum long, groups_sha256 string"])
    own = found.select(*kept, "block", *_FIGURES, "groups_sha256", "link", "times")
    out = own.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(_scored(kept), schema)
    return out.withColumnsRenamed({k: c for c, k in names.items()})
