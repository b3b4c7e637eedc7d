"""Encoding with the ``tokenizers`` library, one distinct text unit at a time.

Both vocabularies used here split a text before their merges, and no split piece ever
holds a non-space character followed by a space.  A text may therefore be cut in front
of every single space that a non-space follows, and each unit encoded by itself gives
the same ids as the whole text.  Running prose repeats its units, so each task keeps the
ids of the units it met (``CACHE_BYTES`` in each of two generations, and the units of one
text more) and calls
the library only for new ones.  A new run of Latin letters is one piece for the splitter
of either vocabulary, so it goes to the library's model without being split again.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

CACHE_BYTES = 160_000_000
#: what a cached unit takes besides its characters and ids
_ENTRY = 160

_LOOSE_SPACE = re.compile(r" (?!\S)")
_UNIT_START = re.compile(r"(?= \S)")
_LATIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
# Latin letters or digits followed by ASCII punctuation: every pre-tokenizer splits there
# (letters that normalise into a mark at their end are left out)
_WORD_END = re.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ÿ])(?=[!-/:-@\[-`{-~])")


class _Made(dict):
    """A dict that makes a missing value once."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class UnitEncoder:
    """Whole-text encoder over one vocabulary file.

    ``keep_space``: units keep the space in front of them (byte-level vocabularies);
    otherwise white space never reaches an id and units are what lies between spaces.
    A text that holds the string of a special token is encoded whole, as the library does.
    """

    def __init__(self, path: str, dtype: str = "<u4", keep_space: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"special tokens of {path} match normalised text")
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"ids of {path} do not fit {dtype}")
        self.keep_space = keep_space
        self._units, self._before, self._held = _Made(self._unit), {}, 0
        self._parts, self._held_parts = _Made(self._part), 0
        self._code = {2: "H", 4: "I"}[self.dtype.itemsize]
        # fixed values: the printable character that byte-level vocabularies write for a byte
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self._alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}

    def units(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the units after it without their space."""
        if self.keep_space and _LOOSE_SPACE.search(text):
            first, *rest = _UNIT_START.split(text)
            return first, [u[1:] for u in rest]
        first, *rest = text.split(" ")
        return first, rest

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit not met lately: as before, or from its words and punctuation runs."""
        known = self._before.get(unit)
        ids = known if known is not None else self._spell(" " + unit if self.keep_space else unit)
        self._held += _ENTRY + len(unit) + len(ids)
        return ids

    def _spell(self, unit: str) -> bytes:
        return b"".join(map(self._parts.__getitem__, _WORD_END.split(unit)))

    def _part(self, piece: str) -> bytes:
        if _LATIN(piece):
            written = self._written(piece if self.keep_space else piece.lower())
            ids = [t.id for t in self.tokenizer.model.tokenize(written)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self._held_parts += _ENTRY + len(piece) + 4 * len(ids)
        return array(self._code, ids).tobytes()

    def _written(self, piece: str) -> str:
        """The characters byte-level vocabularies write for the bytes of a piece."""
        if piece.isascii():
            return piece.replace(" ", self._alphabet[32])
        return piece.encode().decode("latin-1").translate(self._alphabet)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: empty) as little-endian unsigned integers."""
        if self._held > CACHE_BYTES:
            self._units, self._before, self._held = _Made(self._unit), self._units, 0
        if self._held_parts > CACHE_BYTES:
            self._parts, self._held_parts = _Made(self._part), 0
        if not text:
            return b""
        for special in self._special:
            if special in text:
                return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, rest = self.units(text)
        return self._spell(first) + b"".join(map(self._units.__getitem__, rest))


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, dtype: str = "<u4", keep_space: bool = True) -> UnitEncoder:
    """The encoder of this Python worker (workers are reused between tasks)."""
    key = (path, dtype, keep_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(path, dtype, keep_space)
    return _ENCODERS[key]


def by_chars(values, most: int = 2_000_000):
    """Slices (from, to) of a list of texts with about ``most`` characters each."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)
