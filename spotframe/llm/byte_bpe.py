"""Byte-level BPE with the ``tiktoken`` library and a local rank file.

Every match of the split pattern is merged by itself.  Texts longer than ``SPAN``
characters are first cut at places that no match can cross: in front of a space (or run
of white space) that follows a non-space, or between a letter or digit and ASCII
punctuation or the reverse where no contraction can span it.  Ids are little-endian
unsigned 32-bit integers; decoding joins the raw bytes of the ids, so ids that cut a
character in two still round-trip.

Null texts encode as empty texts; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[!-/:-@\[-`{-~])")
_CODECS: dict[tuple[str, str], object] = {}


def codec(rank_path: str, pattern: str):
    """The encoding of this Python worker, read from the rank file once."""
    key = (rank_path, pattern)
    if key not in _CODECS:
        import tiktoken
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _CODECS[key] = tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[key]


def spans(text: str, span: int = SPAN) -> Iterator[str]:
    """The text in order, cut at the first safe place after every ``span`` characters."""
    start = 0
    while len(text) - start > span:
        cut = _SAFE.search(text, start + span)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str, span: int = SPAN) -> bytes:
    if len(text) <= span:
        return np.array(enc.encode_ordinary(text), "<u4").tobytes()
    return b"".join(np.array(enc.encode_ordinary(s), "<u4").tobytes() for s in spans(text, span))


def encode(text: Column, rank_path: str, pattern: str, span: int = SPAN) -> Column:
    """Ids of a text column as a binary column."""
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        enc = codec(rank_path, pattern)
        return pd.Series([encode_text(enc, t or "", span) for t in texts], dtype=object)
    return run(text)


def decode(ids: Column, rank_path: str, pattern: str) -> Column:
    """Raw bytes of an id column made by ``encode``; null ids give null."""
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        enc = codec(rank_path, pattern)
        return pd.Series([None if v is None else enc.decode_bytes(np.frombuffer(v, "<u4").tolist())
                          for v in values], dtype=object)
    return run(ids)
