"""Filter interaction audit: what each filter removes after any others, by posting lists.

Every document is tested once by five filters (A to E).  Documents are dealt to tasks by
ranges of doc_id; for each part and block of ids a task keeps one sorted posting list of
failing ids per filter, and one each of ids of good and toxic documents.  Unions over every
set of filters and the differences that a filter adds to them come from galloping k-way
merges of these lists; only their sizes leave the task and are summed per part.  An order
of filters is then a walk through these sums, so no order touches the documents again.

Rows of one doc_id, or of none, are rows of their own: a posting id is the row's place in
its sorted block.  Of equal texts, all rows with a larger doc_id than the smallest fail E;
rows of that smallest id and rows without an id do not.  Labels are matched by doc_id; of
repeated labels one that marks the document counts.  Null texts count as empty, and a null
part as the empty string.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.llm.common import text_of
from spotframe.session import stage

FILTERS = "ABCDE"
SALTS = 64
BLOCK = 1 << 16
#: ids looked at from every list before a merge moves on
STRIDE = 4096


def gallop(ids: np.ndarray, start: int, bound: int) -> int:
    """First place from ``start`` on whose id exceeds ``bound``: doubling steps, then halving."""
    step, end = 1, start
    while end < len(ids) and ids[end] <= bound:
        start, end, step = end + 1, end + step, step * 2
    return start + int(np.searchsorted(ids[start:min(end, len(ids))], bound, side="right"))


def _slices(lists: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Matching slices of all lists over growing id ranges.  A range ends with the smallest of
    the lists' next ``STRIDE``-th ids, so none of its slices is longer."""
    at = [0] * len(lists)
    while any(i < len(x) for i, x in zip(at, lists)):
        bound = min(int(x[min(i + STRIDE, len(x)) - 1]) for i, x in zip(at, lists) if i < len(x))
        ends = [gallop(x, i, bound) for i, x in zip(at, lists)]
        yield [x[i:j] for i, j, x in zip(at, ends, lists)]
        at = ends


def union(lists: list[np.ndarray]) -> np.ndarray:
    """Sorted ids of any of the sorted lists."""
    out = [np.empty(0, np.int64)]
    for some in _slices(lists):
        some = [s for s in some if len(s)]
        out.append(some[0] if len(some) == 1 else np.unique(np.concatenate(some)))
    return np.concatenate(out)


def _found(ids: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(among, ids), max(0, len(among) - 1))
    return among[at] == ids if len(among) else np.zeros(len(ids), bool)


def difference(ids: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Sorted ids that none of the sorted lists holds."""
    out = [np.empty(0, np.int64)]
    for some in _slices([ids, *lists]):
        left = some[0]
        for other in some[1:]:
            if len(left) and len(other):
                left = left[~_found(left, other)]
        out.append(left)
    return np.concatenate(out)


def shared(ids: np.ndarray, among: np.ndarray) -> int:
    """How many ids both sorted lists hold."""
    return sum(int(_found(a, b).sum()) for a, b in _slices([ids, among]))


def _sizes(postings: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per set of earlier filters (bits) and filter outside it: sizes of the earlier union,
    of what the filter adds to it, and of the good and toxic ids in that."""
    n = len(postings)
    unions: list[np.ndarray] = [np.empty(0, np.int64)]
    for before in range(1, 1 << n):
        top = before.bit_length() - 1
        unions.append(union([unions[before & ~(1 << top)], postings[top]]))
    out = []
    for before in range(1 << n):
        lists = [postings[f] for f in range(n) if before >> f & 1]
        for f in range(n):
            if not before >> f & 1:
                # one list that holds all of the earlier ones spares a merge
                new = difference(postings[f], [unions[before]] if len(lists) > 1 else lists)
                out.append((len(unions[before]), len(new), shared(new, good), shared(new, toxic)))
    return np.array(out, np.int64)


def _cells(n: int = len(FILTERS)) -> list[tuple[int, int]]:
    """(earlier filters, filter) in the order of ``_sizes``."""
    return [(before, f) for before in range(1 << n) for f in range(n) if not before >> f & 1]


def failures(rows: DataFrame) -> DataFrame:
    """``rows(text, ...)`` with the bits of the filters A to D that a text fails for its text."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words)
    upper = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [F.size("words") < 200, F.size(F.array_distinct("words")) * 100 < F.size("words") * 50,
             upper * 100 > F.length("text") * 3, F.col("text").rlike(r"[#$%&*|]")]
    bits = sum((F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)), F.lit(0))
    return rows.withColumn("bits", bits).drop("text", "words")


def tested(docs: DataFrame, part: str) -> DataFrame:
    """part, doc_id, bits of all five filters for every row.

    A text is known by its SHA-256 digest.  The smallest id of each digest is found by salted
    groups and goes back to every salt that holds rows of it, so copies of one text are
    dealt over ``SALTS`` keys."""
    # written once: the texts are read once, and both uses see the same salts
    rows = stage(failures(docs.select(
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
        F.unhex(F.sha2(text_of(), 256)).alias("digest"),
        F.pmod(F.xxhash64(F.col("doc_id"), F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt"))))
    salted = rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    again = (salted.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
             .filter((F.col("n") > 1) & F.col("least").isNotNull())
             .select("digest", "least", F.explode("salts").alias("salt")))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return (rows.join(again, ["digest", "salt"], "left")
            .select("part", "doc_id", F.col("bits").bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("bits"), "salt"))


def set_sizes(rows: DataFrame) -> DataFrame:
    """part, docs, sizes (one flat array in the order of ``_sizes``) from rows of ``part,
    doc_id, bits, good, toxic, salt``, block by block over ranges of doc_id."""
    n = len(FILTERS)

    def audit(part: str, ids: list, bits: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> tuple[int, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        bits, good, toxic = bits[order], good[order], toxic[order]
        return len(ids), _sizes([np.flatnonzero(bits >> f & 1) for f in range(n)], np.flatnonzero(good), np.flatnonzero(toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list] = {}
        held: dict[str, list] = {}

        def settle(part: str) -> None:
            parts = held.pop(part, [])
            if parts:
                ids, *flags = (np.concatenate(c) for c in zip(*parts))
                docs, sizes = audit(part, ids, *flags)
                old = totals.get(part, [0, 0])
                totals[part] = [old[0] + docs, old[1] + sizes]

        kept = 0
        for batch in batches:
            code = batch.column("part").dictionary_encode()
            where = code.indices.to_numpy()
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "bits", "good", "toxic")]
            for k, part in enumerate(code.dictionary.to_pylist()):
                at = np.flatnonzero(where == k)
                held.setdefault(part, []).append([c[at] for c in columns])
            kept += batch.num_rows
            if kept >= BLOCK:
                for part in list(held):
                    settle(part)
                kept = 0
        for part in list(held):
            settle(part)
        for part, (docs, sizes) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([docs], pa.int64()), pa.array([sizes.ravel().tolist()], pa.list_(pa.int64()))],
                                             names=["part", "docs", "sizes"])

    # ranges of ids; rows of one id, or without any, are told apart by their salt
    spread = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).repartitionByRange("doc_id", "salt")
    return spread.select("part", "doc_id", "bits", "good", "toxic").mapInArrow(run, "part string, docs long, sizes array<long>")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, as the module describes."""
    spark = docs.sparkSession
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("good"),
                           (F.col("toxic") == 1).cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    none = F.lit(0)
    rows = (tested(docs, part).join(marks, "doc_id", "left")
            .withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)}))
    cells = _cells()
    long = (set_sizes(rows).select("part", "docs", F.posexplode("sizes").alias("at", "size"))
            .groupBy("part", "at").agg(F.sum("docs").alias("docs"), F.sum("size").alias("size")))
    at = F.floor(F.col("at") / 4).cast("int")
    wide = (long.groupBy("part", at.alias("cell"))
            .agg(F.max("docs").alias("docs"),
                 *[F.max(F.when(F.col("at") % 4 == i, F.col("size"))).alias(name) for i, name in enumerate(("gone", "removed", "good_lost", "toxic_lost"))]))
    n = len(FILTERS)
    # 80 and 600 rows, whatever the input
    known = spark.createDataFrame([(k, before, FILTERS[f], math.factorial(before.bit_count()) * math.factorial(n - 1 - before.bit_count()))
                                   for k, (before, f) in enumerate(cells)], "cell int, before int, filter string, orders int")
    steps = spark.createDataFrame([("".join(order), i + 1, letter, sum(1 << FILTERS.index(x) for x in order[:i]))
                                   for order in permutations(FILTERS) for i, letter in enumerate(order)],
                                  "filter_order string, step int, filter string, before int")
    own = Window.partitionBy("part", "filter")
    bare = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own)
    alone = F.max(F.when(F.col("before") + F.element_at(F.create_map(*[x for i, c in enumerate(FILTERS) for x in (F.lit(c), F.lit(1 << i))]), F.col("filter"))
                         == (1 << n) - 1, F.col("removed"))).over(own)
    sizes = (wide.join(F.broadcast(known), "cell")
             .withColumns({"fails": bare, "unique_fails": alone, "shapley": F.sum(F.col("removed") * F.col("orders")).over(own)}))
    return (sizes.join(F.broadcast(steps), ["filter", "before"])
            .select("part", "filter_order", "step", (F.col("docs") - F.col("gone") - F.col("removed")).alias("kept"), "removed",
                    (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"))
