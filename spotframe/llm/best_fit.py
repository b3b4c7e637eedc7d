"""Best-fit decreasing packing of documents into sequences of a fixed capacity.

Documents longer than the capacity are cut into full pieces and a rest; nothing else is
cut.  Pieces are dealt by a hash of their identity into groups of about ``GROUP_ROWS``
(a group of that size packs about as tightly as all of them at once: what it can lose is
its last few open sequences).  Within a group, longest first, each piece goes to the open
sequence with the least room that still fits it, found by a segment tree over remaining
capacities in logarithmic time.

Null or empty texts are the end id alone.  Rows that repeat a doc_id are packed each by
itself.  A null doc_id is an ordinary document.  A table without rows gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spotframe.llm.common import fresh, text_of
from spotframe.llm.tokenize import by_chars, encoder
from spotframe.session import stage

CAPACITY = 2048
GROUP_ROWS = 200_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TightestRoom:
    """Segment tree over remaining capacities 0..capacity: leaf r holds the open bins with
    r left, an inner node how many bins its leaves hold."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room of at least ``need``."""
        node = need + self.size
        if not self.count[node]:
            # up to the first ancestor whose right sibling holds something, then down left
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset in the bin of every length (each at most ``capacity``)."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    tree, opened = TightestRoom(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        found = tree.take(n)
        room, number = found or (capacity, opened)
        opened += found is None
        bins[i], offsets[i] = number, capacity - room
        if room > n:
            tree.put(room - n, number)
    return bins, offsets


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
               keep_space: bool = False, with_ids: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` where they lie and cut them: one row per piece with
    doc_id, piece, start, length, ids_crc32 and, on request, ids (32-bit little-endian)."""
    end = np.array([end_id], "<u4").tobytes()
    span = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, "<u4", keep_space)
        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in by_chars(texts):
                rows = []
                for doc, text in zip(ids_of[a:b], texts[a:b]):
                    body = enc.encode(text) + end
                    for k in range(0, len(body), span):
                        part = body[k:k + span]
                        rows.append((doc, k // span, k // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names=names[:n])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(cut, _PIECE + (", ids binary" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to every row of ``pieces`` (a column ``length`` of at
    most ``capacity``; other columns are carried along, so keep them small).  Pieces that
    have either column already are refused."""
    for c in pieces.columns:
        if c.lower() in ("sequence_id", "offset"):
            raise ValueError(f"pieces already have a column {c}")
    pieces = stage(pieces)
    groups = max(1, -(-pieces.count() // group_rows))
    keys = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns] or list(pieces.columns)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    group = fresh(pieces.columns, "packing_group")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=group).sort_values(keys, ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=bins + (int(key[0]) << 40), offset=offsets)

    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(*keys), F.lit(groups)))
    return dealt.groupBy(group).applyInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   group_rows: int = GROUP_ROWS, keep_space: bool = False) -> DataFrame:
    """Pieces of all documents with their place: the plan of the packed corpus."""
    return pack(cut_pieces(docs, tokenizer_path, end_id, capacity, keep_space), capacity, group_rows)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, end_id: int = 0,
              capacity: int = CAPACITY, keep_space: bool = False) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, 32-bit little-endian, at
    most ``capacity`` of them), doc_ids and lengths of the pieces in order."""
    ids = cut_pieces(docs, tokenizer_path, end_id, capacity, keep_space, with_ids=True)
    same = ["doc_id", "piece", "length", "ids_crc32"]
    one = ids.dropDuplicates(same)          # repeated rows: equal ids, one copy is enough
    null_safe = [one[c].eqNullSafe(placed[c]) for c in same]
    cond = null_safe[0]
    for c in null_safe[1:]:
        cond = cond & c
    rows = placed.join(one, cond).select(
        placed["sequence_id"], F.struct(placed["offset"], placed["doc_id"], placed["length"], one["ids"]).alias("p"))
    got = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return got.select("sequence_id",
                      F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
                      F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
