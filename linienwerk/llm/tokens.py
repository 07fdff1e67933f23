"""Whole texts to token ids, with a bounded cache of the pieces already encoded.

A byte-pair vocabulary first cuts a text into pre-tokens and then encodes each
for itself. A piece of text between two cuts that the pre-tokenizer certainly
makes is thus encoded alike in any text, and is looked up before it is encoded.
Texts where a cut isn't certain are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Where two runs of white space meet at a space, a pre-token may span them.
_UNSURE_BYTE = re.compile(r"\s \s|  |[\x1c-\x1f] | [\x1c-\x1f]")
#: White space to Python but not to the vocabulary's patterns.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: White space but for the space and the line feed.
_RARE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Runs that are words of their own where white space is dropped: Latin letters, and signs.
_RUN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,!?;:|*$%&#<>()/=+-]+")

_LOADED: dict[tuple[str, str, bool], "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` file.

    ``cut='byte'``: a byte-level vocabulary whose words take their leading
    space; ``cut='word'``: one that drops white space; ``cut='none'``: every
    text is encoded whole, as is one that holds an added token's string, which
    the library makes one id, unless ``special`` is false: such strings are then
    plain text.
    """

    def __init__(self, path: str, cut: str, max_pieces: int = 350_000, special: bool = True):
        # Spark's tasks take all cores; threads of the library would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if special]
        self.added = re.compile("|".join(added), re.IGNORECASE) if added else None
        #: The longest part of each added token that has no case; searching for it is fast.
        self.hints = {max(re.split(r"[^\W\d_]+", t.content), key=len) for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: Ids of pieces, and those of the time before: what is met again stays.
        self.cut, self.max_pieces, self.cache, self.old = cut, max_pieces, {}, {}
        vocab = self.tokenizer.get_vocab()
        #: Of each id the bytes of its token, and whether it ends a word.
        self.sizes, self.ends = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), bool)
        for token, k in vocab.items():
            self.sizes[k], self.ends[k] = len(token), token.endswith("</w>")

    @classmethod
    def of(cls, path: str, cut: str, special: bool = True) -> "PieceEncoder":
        """One encoder for a Python worker, kept between its tasks."""
        if (path, cut, special) not in _LOADED:
            _LOADED[path, cut, special] = cls(path, cut, special=special)
        return _LOADED[path, cut, special]

    def __call__(self, text: str | None) -> bytes:
        """The ids of a text as little-endian integers of ``self.dtype``."""
        return self.many([text])[0]

    def batch(self, rows, size: int = 64) -> Iterator[tuple[int | None, bytes]]:
        """First column and ids of the second of an Arrow batch, some texts at a time."""
        for at in range(0, rows.num_rows, size):
            part = rows.slice(at, size)
            yield from zip(part.column(0).to_pylist(), self.many(part.column(1).to_pylist()), strict=True)

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; what none of them has met is encoded together."""
        if len(self.cache) > self.max_pieces:
            self.cache, self.old = {}, self.cache
        cut = [self._pieces(text or "") for text in texts]
        new = set().union(*[p for p in cut if p is not None]).difference(self.cache)
        if new := self._unknown(new):
            self._learn(new)
        get = self.cache.__getitem__
        return [self._whole(t or "") if p is None else b"".join(map(get, p)) for t, p in zip(texts, cut, strict=True)]

    def _pieces(self, text: str) -> list[str] | None:
        """Parts that the pre-tokenizer certainly cuts apart; in a byte-level vocabulary each but the first had a space before it."""
        if self.added and any(h in text for h in self.hints) and self.added.search(text):
            return None
        if self.cut == "byte" and "\x00" not in text and not self._unsure(text):
            pieces = text.split(" ")
            pieces[0] = "\x00" + pieces[0]
            return pieces
        if self.cut == "word" and not any(c in text for c in _SEPARATORS):
            return text.split()
        return None

    @staticmethod
    def _unsure(text: str) -> bool:
        """Whether the pattern of unsure bytes is found; most texts have nothing that it could start with."""
        return ("  " in text or "\n " in text or any(c in text for c in _RARE)) and _UNSURE_BYTE.search(text) is not None

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those of the pieces that weren't met before; the others are taken over from the time before."""
        if self.old:
            again = {p for p in pieces if p in self.old}
            self.cache.update(zip(again, map(self.old.__getitem__, again), strict=True))
            return pieces.difference(again)
        return pieces

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Enters pieces into the cache. Many are encoded as one text and told apart again."""
        rest = (self._learn_bytes if self.cut == "byte" else self._learn_words)(new)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast([self._spelt(p) for p in rest], add_special_tokens=False), strict=True):
            self.cache[p] = np.asarray(e.ids, self.dtype).tobytes()

    def _spelt(self, p: str) -> str:
        return p if self.cut == "word" else p[1:] if p[:1] == "\x00" else " " + p

    def _enter(self, pieces: list[str], texts: list[str], ends_of) -> None:
        for k, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            some = pieces[k * 256 : k * 256 + 256]
            ids = np.asarray(e.ids, self.dtype)
            ends = (ends_of(some, ids) * self.dtype.itemsize).tolist()
            self.cache.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _learn_bytes(self, new: set[str]) -> list[str]:
        """Pieces between spaces, one after another; their bytes tell which ids are whose. Returns those that white space makes unsure."""
        sure = [p for p in new if p and p[0] != "\x00" and not p[0].isspace() and not p[-1].isspace()]
        ends = lambda some, ids: np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) + 1 for p in some])) + 1
        self._enter(sure, [" " + " ".join(sure[k : k + 256]) for k in range(0, len(sure), 256)], ends)
        return list(new.difference(sure))

    def _learn_words(self, new: set[str]) -> list[str]:
        """Runs of Latin letters and runs of signs are words of their own; an id that ends a word ends its run."""
        cache, parts, rest = self.cache, {}, []
        runs = {p for p in new if p.isascii() and p.isalpha()}
        for p in new.difference(runs):
            found = _RUN.findall(p)
            if sum(map(len, found)) == len(p):
                parts[p] = found
                runs.update(found)
            else:
                rest.append(p)
        words = list(self._unknown({x for x in runs if x not in cache}))
        self._enter(words, [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)], lambda some, ids: np.flatnonzero(self.ends[ids]) + 1)
        for p, found in parts.items():
            if len(found) > 1:
                cache[p] = b"".join([cache[x] for x in found])
        return rest
