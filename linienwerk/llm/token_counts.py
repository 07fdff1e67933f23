"""Token counts of whole texts by a shortcut for pre-tokens that are one token.

A byte-level vocabulary cuts a text into pre-tokens by a pattern and merges the
bytes of each for itself. Before any text is read it is proved, by encoding
every string of the vocabulary, which pre-tokens are a single token. A text's
pre-tokens are then looked up: those proved count one each, and only the rest
go through the merges, each of them once for a bounded cache.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: The pattern by which byte-level vocabularies cut texts; fixed by their format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Shortcut:
    """What is proved about a vocabulary: of a size that the vocabulary's own bounds."""

    #: Pre-tokens that are one token.
    whole: frozenset[str]
    #: Strings that the library cuts out of a text first, each one token.
    added: tuple[str, ...]


def byte_letters() -> str:
    """Byte-level vocabularies write printable bytes as themselves, and the others, in order, from code point 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


def _agreed(pre, c: str) -> bool:
    """Whether both libraries class a character alike: it is put where only its own class joins it to what stands before."""
    for pattern, probe, pieces in ((r"\p{L}", "a" + c, 1), (r"\p{N}", "1" + c, 1), (r"\s", f"x\n{c}\nx", 4)):
        if regex.match(pattern, c):
            return len(pre(probe)) == pieces
    return len(pre("!" + c)) == 1


def prove(path: str) -> Shortcut:
    """Reads a ``tokenizers`` file of a byte-level vocabulary and proves its shortcut; raises ValueError for other kinds."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a plain byte-level vocabulary")
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take more than their own string")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    added = tuple(t["content"] for t in spec["added_tokens"])
    byte = {c: b for b, c in enumerate(byte_letters())}
    texts = []
    for token in spec["model"]["vocab"]:
        try:
            texts.append(bytes(byte[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # a part of a character, or no token of bytes
            continue
    texts = [t for t in texts if not any(a in t for a in added)]
    one = [t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    return Shortcut(frozenset(t for t in one if len(tokenizer.pre_tokenizer.pre_tokenize_str(t)) == 1), added)


_READY: dict[str, "Counter"] = {}


class Counter:
    """Counts tokens of texts with a proved shortcut; one for a Python worker and vocabulary."""

    def __init__(self, path: str, shortcut: Shortcut, max_rest: int = 400_000, window: int = 1 << 18):
        # Spark's tasks take all cores; threads of the library would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cut, self.window, self.max_rest = Tokenizer.from_file(path), regex.compile(PATTERN), window, max_rest
        self.whole, self.rest = shortcut.whole, {}
        #: Of each character met whether the pattern cuts at it as the library does.
        self.sure: dict[str, bool] = {}
        self.added = regex.compile("|".join(map(regex.escape, sorted(shortcut.added, key=len, reverse=True)))) if shortcut.added else None

    @classmethod
    def of(cls, path: str, shortcut: Broadcast) -> "Counter":
        if path not in _READY:
            _READY[path] = cls(path, shortcut.value)
        return _READY[path]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None:
            return self._plain(text)
        n, at = 0, 0
        for m in self.added.finditer(text):
            n += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return n + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        """Tokens of a text without added strings."""
        return sum(self._count(p) for p in self._pieces(text))

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens. Of a window the last two are left for the next one, as they may go on."""
        at, size, sure = 0, self.window, self._sure(text)
        while at < len(text):
            end = min(at + size, len(text))
            pieces = self.cut.findall(text, at, end) if sure else [text[at + a : at + b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text[at:end])]
            if end < len(text):
                if len(pieces) < 3:
                    size *= 2
                    continue
                del pieces[-2:]
            at, size = at + sum(map(len, pieces)), self.window
            yield pieces

    def _sure(self, text: str) -> bool:
        """Whether the library's cuts are those of the pattern; the two may know characters of other Unicode versions."""
        if text.isascii():
            return True
        chars = set(text)
        for c in chars.difference(self.sure):
            self.sure[c] = _agreed(self.tokenizer.pre_tokenizer.pre_tokenize_str, c)
        return all(map(self.sure.__getitem__, chars))

    def _count(self, pieces: list[str]) -> int:
        rest = [p for p in pieces if p not in self.whole]
        known = self.rest
        if len(known) > self.max_rest:
            known.clear()
        if new := list(set(rest).difference(known)):
            # a pre-token for itself is cut no further, so the library merges just its bytes
            found = zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)
            if max(map(len, new)) <= 256:
                known.update(found)
            else:
                known = {**dict(found), **{p: known[p] for p in rest if p in known}}
        return len(pieces) - len(rest) + sum(map(known.__getitem__, rest))


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns ``+ n_bytes, n_tokens, over_limit``: a row for each row, without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens; equal rows and null ids come
    back as they are; an empty table gives none. A text of any length is read
    in windows, so a worker needs no more than the text and a window's pieces.
    Strings of added tokens are one token each, as by the library's default.
    """
    shortcut = docs.sparkSession.sparkContext.broadcast(prove(path))
    names = [*keep, "n_bytes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path, shortcut)
        for b in batches:
            # one text at a time leaves Arrow's memory
            counts = pa.array([counter(x.as_py()) for x in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], counts], names)

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(*keep, size, F.col(text).alias("n_tokens"))
    schema = rows.drop("n_tokens").schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
