"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Layout under one shared folder:

- ``<shard>.bin``: the ids of consecutive documents, nothing between them, as
  little-endian ``uint16`` (vocabularies up to 65,536 ids) or ``uint32``;
- ``<shard>.idx``: little-endian ``int64``, the token offset in the shard of every
  document and, last, the shard's length;
- ``<shard>.doc``: little-endian ``int64``, the doc_id of every document (null as the
  smallest number);
- ``manifest``: Parquet, one row per shard: ordinal, names, documents, tokens, base.
  A base is the prefix sum of the tokens of all shards before, so base + offset is a
  document's place in the whole corpus;
- ``documents``: Parquet, one row per document: doc_id, shard, position in the shard.

Documents are ordered by doc_id (null first; rows that share one by text).  A text that
is null or empty is the end id alone.  A table without rows makes no shard.  Columns
other than doc_id and text are not looked at.

Every attempt of a task writes shards under names of its own and only the rows of
attempts that Spark commits name them, so lost executors and speculative copies leave at
most files that nothing reads.  Folders are reached through pyarrow's file systems
(``file:`` or a plain path, ``hdfs:``, ``s3:``, ``gs:``); on mounted folders the files
are memory-mapped for reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotframe.llm.common import text_of
from spotframe.llm.tokenize import encoder

SHARD_BYTES = 64 << 20
NO_ID = -(1 << 63)
READERS = 20_000
_ROW = "doc_id long, task int, part int, name string, position long, n_tokens long"


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class _Shard:
    """One shard being written; the bytes go out as they come."""

    def __init__(self, store, root: str, width: int):
        self.store, self.width = store, width
        self.name = uuid.uuid4().hex
        self.stem = f"{root}/{self.name}"
        self.out = store.open_output_stream(f"{self.stem}.bin")
        self.offsets, self.docs, self.bytes = [0], [], 0

    def add(self, doc: int | None, ids: bytes) -> tuple[int, int]:
        self.out.write(ids)
        self.bytes += len(ids)
        self.docs.append(NO_ID if doc is None else doc)
        self.offsets.append(self.bytes // self.width)
        return len(self.docs) - 1, len(ids) // self.width

    def close(self) -> None:
        self.out.close()
        for kind, numbers in (("idx", self.offsets), ("doc", self.docs)):
            with self.store.open_output_stream(f"{self.stem}.{kind}") as out:
                out.write(np.array(numbers, "<i8").tobytes())


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int,
                      end_id: int = 0, keep_space: bool = True, shard_bytes: int = SHARD_BYTES,
                      partitions: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the files described above to ``folder``.

    One range shuffle brings documents into doc_id order; the encoded ids go straight
    from the task to its shards and are never shuffled.
    """
    spark = docs.sparkSession
    dtype = id_type(vocabulary)
    end = np.array([end_id], dtype).tobytes()
    width = len(end)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = (rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id"))
    dealt = dealt.sortWithinPartitions("doc_id", "text").withColumn("task", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        enc = encoder(tokenizer_path, dtype, keep_space)
        shard, part = None, 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            parts, names, positions, counts = [], [], [], []
            for doc, text in zip(doc_ids, texts):
                if shard is not None and shard.bytes >= shard_bytes:
                    shard.close()
                    shard, part = None, part + 1
                shard = shard or _Shard(store, root, width)
                position, n = shard.add(doc, enc.encode(text) + end)
                parts.append(part)
                names.append(shard.name)
                positions.append(position)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("task"), pa.array(parts, pa.int32()),
                 pa.array(names, pa.string()), pa.array(positions, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "task", "part", "name", "position", "n_tokens"])
        if shard is not None:
            shard.close()

    dealt.mapInArrow(write, _ROW).write.parquet(f"{folder}/documents")
    written = spark.read.parquet(f"{folder}/documents")
    shards = written.groupBy("task", "part", "name").agg(F.count("*").alias("documents"),
                                                         F.sum("n_tokens").alias("tokens"))
    # one row per shard of shard_bytes: the only rows that meet in one task
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    (shards.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
     .withColumn("dtype", F.lit(dtype)).coalesce(1).write.parquet(f"{folder}/manifest"))


class TokenShard:
    """Random access to one shard: ``shard[i]`` is the id array of its i-th document."""

    def __init__(self, folder: str, name: str, dtype: str):
        store, root = _store(folder)
        self.ids = self._map(store, f"{root}/{name}.bin", dtype)
        self.offsets = self._map(store, f"{root}/{name}.idx", "<i8")
        self.docs = self._map(store, f"{root}/{name}.doc", "<i8")

    @staticmethod
    def _map(store, path: str, dtype: str) -> np.ndarray:
        if isinstance(store, pafs.LocalFileSystem):
            return np.memmap(path, dtype, mode="r")
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i]:self.offsets[i + 1]]


def read_documents(spark: SparkSession, folder: str, digest_only: bool = False) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32
    (over unsigned 32-bit ids) and, unless ``digest_only``, ids (array of long).

    Shards are dealt to tasks; a task maps one shard at a time, so it holds the documents
    of one batch, not of the shard.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not digest_only:
        out += ", ids array<long>"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                shard = TokenShard(folder, row.name, row.dtype)
                for at in range(0, len(shard), 4096):
                    some = [shard[i] for i in range(at, min(at + 4096, len(shard)))]
                    doc = pd.Series(np.array(shard.docs[at:at + len(some)]))
                    got = {"doc_id": doc.astype("Int64").mask(doc == NO_ID),
                           "start": row.base + np.asarray(shard.offsets[at:at + len(some)]),
                           "n_tokens": [len(x) for x in some],
                           "ids_crc32": [zlib.crc32(x.astype("<u4")) for x in some]}
                    if not digest_only:
                        got["ids"] = [x.astype(np.int64) for x in some]
                    yield pd.DataFrame(got)

    # as many tasks as there are shards, up to ``READERS``; by number, so they stay apart
    shards = manifest.select("name", "base", "dtype").repartition(max(1, min(READERS, manifest.count())), "name")
    return shards.mapInPandas(read, out)
