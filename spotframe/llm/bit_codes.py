"""Nearest neighbours by randomly rotated one-bit codes.

Every vector x is taken relative to the nearest of a few pivots c, rotated by one random
rotation into ``bits`` dimensions, and kept as the signs of its coordinates with two
corrections: its distance to the pivot, and how far the sign vector agrees with the rotated
direction it stands for.  A query, rotated likewise and cut to ``PLANES`` bits a coordinate,
meets a code by and-ing and counting bits.  That count over the agreement estimates the
inner product without bias, with an error of about 1 / sqrt(bits); ``WIDTH`` deviations of
it give a lower bound for each distance.  Only vectors whose bound lies within the k-th
distance known so far are measured exactly, on the original vectors.

Pivots and a first bound on every query's k-th distance come from a sample: the ``SAMPLE``
rows (fewer of very long vectors) whose vec_id hashes lowest.  All rows are indexed.
Vectors lie in blocks of about ``BLOCK`` of one pivot, dealt out by position so that copies
of one vector never fill a block; a block none of whose vectors can be near a query by the
triangle inequality is passed over.  Every block meets the queries in groups of ``GROUP``,
and hands on at most k rows a query.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor
do rows without vec_id, nor vectors of another length than the commonest (of equally common
ones the longest).  Rows that repeat a vec_id are candidates each, but for a query of that
id; a repeated query is asked once, with its smallest vector.  Ties go to the smaller
vec_id.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import stage

SAMPLE, SAMPLE_NUMBERS = 4096, 4_000_000
PIVOTS, PIVOT_ROWS = 64, 8192
BLOCK, GROUP, PACK = 16_384, 65_536, 1024
PLANES = 5
#: deviations of the estimate that a bound allows for
WIDTH = 4.0
_PACKED = "pivot int, serial long, n int, ids array<long>, vectors array<double>, codes binary, reach array<double>, agree array<double>"


@dataclass
class Coder:
    rotation: np.ndarray        # dimensions x bits, orthonormal rows
    pivots: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, pivots: int, bits: int | None = None, seed: int = 5) -> Coder:
        d, rng = sample.shape[1], np.random.default_rng(seed)
        bits = -(-(bits or max(d, min(4 * d, 1024))) // 64) * 64
        turn = np.linalg.qr(rng.normal(size=(bits, d)))[0].T
        return cls(turn, _centres(sample, pivots, rng))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.pivots ** 2).sum(1) - 2 * x @ self.pivots.T).argmin(1)

    def encode(self, x: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, distance to the pivot, and agreement of signs and direction."""
        off = x - self.pivots[pivot]
        reach = np.sqrt((off ** 2).sum(1))
        turned = off @ self.rotation
        with np.errstate(divide="ignore", invalid="ignore"):
            agree = np.abs(turned).sum(1) / (reach * np.sqrt(turned.shape[1]))
        return np.packbits(turned > 0, axis=1).view(np.uint64), reach, np.where(agree > 0, agree, 1.0)


def _centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres of the sample's distinct vectors."""
    points = np.unique(sample, axis=0)
    if len(points) <= k:
        return points
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(8):
        own = ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    packs: DataFrame            # of vectors of one pivot, ``PACK`` at most
    coder: Coder
    sample: np.ndarray
    sample_ids: np.ndarray
    blocks: list[int]           # per pivot


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector (as doubles) of the rows that take part."""
    def good(v: Column) -> Column:
        return F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & good(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("size")).count().agg(F.max(F.struct("count", "size"))).first()[0]
    return rows.filter(F.size("vector") == (size["size"] if size else 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def build_index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", bits: int | None = None,
                sample: int = SAMPLE) -> Index | None:
    """Index of all usable vectors, written to the shared folder; None without any."""
    rows = usable(df, vec_id, vector)
    totals = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not totals["n"]:
        return None
    most = max(1, min(sample, SAMPLE_NUMBERS // totals["d"]))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(most).collect()     # ``most`` rows
    points = np.array([r["vector"] for r in some])
    coder = Coder.of(points, max(1, min(PIVOTS, totals["n"] // PIVOT_ROWS)), bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), batch.num_rows)
            own = coder.nearest(x)
            for pivot in np.unique(own):
                at = np.flatnonzero(own == pivot)
                for i in range(0, len(at), PACK):
                    few = at[i:i + PACK]
                    code, reach, agree = coder.encode(x[few], pivot)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pivot], pa.int32()), pa.array([serial], pa.int64()), pa.array([len(few)], pa.int32()), pa.array([ids[few]]),
                         pa.array([x[few].ravel()]), pa.array([code.tobytes()]), pa.array([reach]), pa.array([agree])],
                        names=["pivot", "serial", "n", "ids", "vectors", "codes", "reach", "agree"])
                    serial += 1
    packs = stage(rows.mapInArrow(pack, _PACKED))
    sizes = {r["pivot"]: r["n"] for r in packs.groupBy("pivot").agg(F.sum("n").alias("n")).collect()}     # one row a pivot
    return Index(packs, coder, points, np.array([r["vec_id"] for r in some]),
                 [-(-sizes.get(p, 0) // BLOCK) for p in range(len(coder.pivots))])


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def _query_packs(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Queries in packs, with a bound on each one's k-th distance from the sample."""
    sample, sample_ids = index.sample, index.sample_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PACK):
                few = batch.slice(i, PACK)
                ids, q = few.column("vec_id").to_numpy(), _matrix(few.column("vector"), few.num_rows)
                bound = np.full(len(ids), np.inf)
                for j in range(len(ids)):
                    known = _distances(sample, q[j])[sample_ids != ids[j]]
                    if len(known) >= k:
                        bound[j] = np.partition(known, k - 1)[k - 1]
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids]), pa.array([q.ravel()]), pa.array([bound])],
                                                 names=["n", "ids", "vectors", "reach"])
    once = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return stage(once.mapInArrow(pack, "n int, ids array<long>, vectors array<double>, reach array<double>"))


@dataclass
class Block:
    """Vectors of one pivot, met by packs of queries."""
    coder: Coder
    pivot: int
    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    reach: np.ndarray
    agree: np.ndarray

    def __post_init__(self):
        bits = self.coder.rotation.shape[1]
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        # share of a query's length that the estimate may be off by
        self.off = WIDTH * np.sqrt(np.maximum(0, 1 - self.agree ** 2) / (bits - 1)) / self.agree
        self.compared = 0

    def estimates(self, turned: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query, estimated squared distances and what they may be too high by."""
        bits = turned.shape[1]
        low = turned.min(1)
        step = (turned.max(1) - low) / ((1 << PLANES) - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = np.where(step[:, None] > 0, np.rint((turned - low[:, None]) / step[:, None]), 0).astype(np.uint8)
        planes = [np.packbits(cut >> p & 1, axis=1).view(np.uint64) for p in range(PLANES)]
        sums = (low * bits + step * cut.sum(1, dtype=np.int64))
        for j, length in enumerate(lengths):
            met = np.zeros(len(self.ids), np.int64)
            for p in range(PLANES):
                met += np.bitwise_count(self.codes & planes[p][j]).sum(1, dtype=np.int64) << p
            product = (2 * (low[j] * self.ones + step[j] * met) - sums[j]) / np.sqrt(bits) / self.agree
            error = self.off * length + WIDTH * step[j] / np.sqrt(12) / self.agree
            both = self.reach ** 2 + length ** 2
            yield both - 2 * self.reach * product, 2 * self.reach * error + 1e-9 * both

    def nearest(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query that has any: the ids and distances of its k nearest here within its bound."""
        off = q - self.coder.pivots[self.pivot]
        lengths = np.sqrt((off ** 2).sum(1))
        near = np.flatnonzero(~(lengths - self.reach.max() > bound * (1 + 1e-9)))
        for j, (guess, slack) in zip(near, self.estimates(off[near] @ self.coder.rotation, lengths[near])):
            open_ = self.ids != ids[j]
            limit = bound[j]
            first = np.argpartition(guess, k)[:k + 1] if len(guess) > k + 1 else np.arange(len(guess))
            first = first[open_[first]]
            if len(first) >= k:
                limit = min(limit, np.partition(_distances(self.x[first], q[j]), k - 1)[k - 1])
            at = np.flatnonzero(open_ & ~(guess - slack > limit * limit))
            self.compared += len(at)
            d = _distances(self.x[at], q[j])
            at, d = at[d <= limit], d[d <= limit]
            best = np.lexsort((self.ids[at], d))[:k]
            if len(best):
                yield int(ids[j]), self.ids[at[best]], d[best]


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``queries(vec_id, vector)``."""
    asked = _query_packs(index, queries, k)
    total = asked.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP))
    first = [0, *np.cumsum(index.blocks).tolist()]
    blocks = first[-1]
    counts, starts = (F.array(*[F.lit(int(v)) for v in a]) for a in (index.blocks, first))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.get(starts, F.col("pivot")) + F.pmod("serial", F.get(counts, F.col("pivot"))).cast("int")
    held = index.packs.select(block.alias("block"), every(groups).alias("part"), F.lit(0).alias("kind"),
                              "pivot", "n", "ids", "vectors", "codes", "reach", "agree")
    # block by block against all queries: packs of queries go to every block
    sent = (asked.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
            .select(every(blocks).alias("block"), "part", F.lit(1).alias("kind"), F.lit(0).alias("pivot"), "n", "ids", "vectors",
                    F.lit(b"").alias("codes"), "reach", F.array().cast("array<double>").alias("agree")))
    coder = index.coder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packs, block = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                got = {c: batch.column(c)[row] for c in ("block", "part", "kind", "pivot", "n", "ids", "vectors", "codes", "reach")}
                key, n = (got["block"].as_py(), got["part"].as_py()), got["n"].as_py()
                numbers = lambda c: got[c].values.to_numpy(zero_copy_only=False)
                ids, x, reach = numbers("ids"), numbers("vectors").reshape(n, -1), numbers("reach")
                if key != at:
                    at, packs, block = key, [], None
                if got["kind"].as_py() == 0:
                    codes = np.frombuffer(got["codes"].as_py(), np.uint64).reshape(n, -1)
                    packs.append((got["pivot"].as_py(), ids, x, codes, reach, batch.column("agree")[row].values.to_numpy(zero_copy_only=False)))
                    continue
                if block is None and packs:
                    block = Block(coder, packs[0][0], *(np.concatenate([p[i] for p in packs]) for i in range(1, 6)))
                    packs = []
                if block is None:
                    continue
                found = list(block.nearest(ids, x, reach, k))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                         pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                        names=["query_id", "vec_id", "score"])

    met = (held.unionByName(sent).repartition(max(1, blocks * groups), "block", "part").sortWithinPartitions("block", "part", "kind")
           .mapInArrow(run, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, wanted: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
                       bits: int | None = None) -> DataFrame:
    """The k nearest rows of every row of ``df`` that ``wanted`` (over vec_id) marks."""
    index = build_index(df, vec_id, vector, bits)
    if index is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = index.packs.select(F.explode(F.arrays_zip("ids", F.sequence(F.lit(0), F.col("n") - 1))).alias("e"), "vectors")
    d = index.sample.shape[1]
    asked = rows.select(F.col("e.ids").alias("vec_id"), F.slice("vectors", F.col("e")["1"] * d + 1, d).alias("vector"))
    return search(index, asked.filter(wanted), k)
