"""Embedding whitening by a blockwise QR and a bidiagonal qd solver.

Each entry c of a vector becomes the whole number x = floor(64 c) + 1000000.  With n vectors
and per-dimension sums S, both exact, every task reduces its centred rows x - S/n block by
block to one triangular factor, and factors are reduced ``FAN_IN`` at a time until one is
left: the factor R of all centred rows, so that R'R / n is the covariance, never formed
itself.  The driver takes R (dimensions x dimensions, whatever the number of rows),
Householder-bidiagonalises it, finds its singular values by dqds and its right singular
vectors by twisted factorisations (``spotframe.llm.bidiagonal``).  Rows are then projected
where they lie, and the covariance of the projections is summed up to report how far it is
from the identity.

Rows take part whose vector is not null and holds no null or non-finite entry, and none so
large (2**56 and more) that x does not fit a long.  The dimension is the commonest length
of these vectors (of equally common ones the longest); other lengths and empty vectors are
left out.  Repeated rows and null ids are rows of their own.  A component without variance
(a constant dimension, fewer vectors than dimensions) has a null whitened value and
explains 0; the identity is measured over the others, and is null where there is none.
A deviation that does not fit a long is null.  A table without vectors gives no rows.
Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotframe.llm.bidiagonal import right_singular

SCALE, OFFSET = 64, 1_000_000
FAN_IN = 64
BLOCK = 8192
LARGEST = float(1 << 56)
_LONG = np.iinfo(np.int64)


def whole_entries(vector: Column) -> Column:
    """x of every entry; null where the vector takes no part."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST))
    return F.when(fits & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass
class Centre:
    """Exact mean S/n as a whole part and the rest."""
    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])
        self.most = max(abs(int(w)) + 1 for w in self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it does not fit a long."""
        reach = self.n * (int(np.abs(x - self.whole).max(initial=0)) + 1)
        if reach ** 2 * x.shape[1] <= _LONG.max:
            left = np.array([s % self.n for s in self.sums], np.int64)
            return (((x - self.whole) * self.n - left) ** 2).sum(1).tolist()
        own = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [d if d <= _LONG.max else None for d in own]


def _sums(rows: DataFrame) -> tuple[Centre | None, int]:
    """Centre of the vectors of the commonest length, and the number of tasks that read them.
    Sums run in two halves, so no task overflows; at most one line per dimension and
    length reaches the driver."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        halves: dict[int, list] = {}
        for batch in batches:
            by_length: dict[int, list[int]] = {}
            for i, width in enumerate(np.diff(batch.column("x").offsets.to_numpy())):
                by_length.setdefault(int(width), []).append(i)
            for width, at in by_length.items():
                x = _matrix(batch.column("x").take(pa.array(at)))
                old = halves.setdefault(width, [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
                halves[width] = [old[0] + len(x), old[1] + (x >> 32).sum(0), old[2] + (x & 0xFFFFFFFF).sum(0)]
        for width, (n, high, low) in halves.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * width), pa.array([width] * width), pa.array(np.arange(width)), pa.array([n] * width),
                 pa.array(high), pa.array(low)], names=["part", "width", "at", "n", "high", "low"])
    parts = rows.select("x").mapInArrow(partial, "part long, width long, at long, n long, high long, low long")
    count = F.max("part").alias("tasks")
    totals = (parts.groupBy("width", "at").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(28,0)")).alias("high"),
                                               F.sum(F.col("low").cast("decimal(28,0)")).alias("low"), count))
    best = totals.agg(F.max(F.struct("n", "width"))).first()[0]
    if best is None:
        return None, 0
    lines = sorted(totals.filter(F.col("width") == best["width"]).collect(), key=lambda r: r["at"])
    return Centre(int(best["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in lines]), int(lines[0]["tasks"]) + 1


def _reduced(parts: DataFrame, tasks: int, merge) -> np.ndarray | None:
    """One array left of ``parts(part, a)``, whose arrays ``merge`` joins a few at a time."""
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "a": [merge(rows["a"].tolist())]})

    while True:
        last = tasks <= FAN_IN
        key = F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN_IN)
        parts = parts.withColumn("part", key).groupBy("part").applyInPandas(join, "part long, a array<double>")
        if last:
            got = parts.collect()       # one row
            return np.array(got[0]["a"]) if got else None
        tasks = -(-tasks // FAN_IN)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, always square."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    return np.linalg.qr(rows, mode="r")


def _partials(rows: DataFrame, step, state, finish) -> DataFrame:
    """``parts(part, a)``: one array per task, folded over the task's vectors in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else []
            for i in range(0, len(x), BLOCK):
                now = step(now, x[i:i + BLOCK])
        if now is not state:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([finish(now).tolist()])],
                                             names=["part", "a"])
    return rows.select("x").mapInArrow(run, "part long, a array<double>")


def triangular_factor(rows: DataFrame, centre: Centre, tasks: int) -> np.ndarray:
    """R with R'R = sum of the outer products of all centred rows."""
    d = len(centre.sums)
    parts = _partials(rows, lambda r, x: _triangle(np.vstack([r, centre.centred(x)])), np.zeros((0, d)), np.ravel)
    return _reduced(parts, tasks, lambda few: _triangle(np.vstack([np.reshape(a, (d, d)) for a in few])).ravel()).reshape(d, d)


@dataclass
class Whitening:
    """``directions`` are unit eigenvectors of the covariance (columns), ``variance`` their
    eigenvalues in falling order, 0 where there is no variance."""
    centre: Centre
    directions: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; NaN on components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, (self.centre.centred(x) @ self.directions) / np.sqrt(self.variance), np.nan)


def _moments(some: np.ndarray) -> np.ndarray:
    mean = some.mean(0)
    off = some - mean
    return np.concatenate([[len(some)], mean, (off.T @ off).ravel()])


def _merged(few: list) -> np.ndarray:
    """Count, mean and centred products of several parts as of their union."""
    few = [np.asarray(a, float) for a in few]
    k = int(round((np.sqrt(4 * len(few[0]) - 3) - 1) / 2))
    n = np.array([a[0] for a in few])
    means = np.array([a[1:k + 1] for a in few])
    mean = n @ means / n.sum()
    off = means - mean
    return np.concatenate([[n.sum()], mean, sum(a[k + 1:] for a in few) + ((off * n[:, None]).T @ off).ravel()])


def _with_error(rows: DataFrame, model: Whitening, tasks: int) -> Whitening:
    """The model with the largest entry of |covariance of the whitened rows - identity|."""
    live = model.variance > 0
    k = int(live.sum())
    if k:
        add = lambda m, x: (lambda new: new if m is None else _merged([m, new]))(_moments(model.project(x)[:, live]))
        got = _reduced(_partials(rows, add, None, np.asarray), tasks, _merged)
        model.identity_error = float(np.abs(got[k + 1:].reshape(k, k) / got[0] - np.eye(k)).max())
    return model


def _rows(df: DataFrame, vector: str, keep: list[str], width: int | None = None) -> DataFrame:
    found = df.select(*[F.col(c) for c in keep], whole_entries(F.col(vector)).alias("x"))
    return found.filter(F.col("x").isNotNull() if width is None else F.size("x") == width)


def fit(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening | None:
    """Whitening of all vectors of ``df``; None where there are none."""
    centre, tasks = _sums(_rows(df, vector, []))
    if centre is None:
        return None
    rows = _rows(df, vector, [], len(centre.sums))
    squares, vectors = right_singular(triangular_factor(rows, centre, tasks))
    d = len(squares)
    # what the reductions leave of a dimension without variance is rounding
    noise = (8 * d * np.finfo(float).eps) ** 2 * (squares[0] + d * centre.n * np.finfo(float).eps ** 2)
    squares = np.where(squares > noise, squares, 0.0)
    total, k = squares.sum(), min(components, d)
    model = Whitening(centre, vectors[:, :k], squares[:k] / centre.n, squares[:k] / total if total > 0 else np.zeros(k))
    return _with_error(rows, model, tasks)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector
    and component."""
    model = fit(df, vector, components)
    kind = df.schema[vec_id].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                   "explained double, identity_error double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                some = batch.slice(i, BLOCK)
                x = _matrix(some.column("x"))
                flat = model.project(x).ravel()
                cut = pa.array(np.arange(len(x) + 1) * len(model.variance), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [some.column("vec_id"), pa.array(model.centre.deviations(x), pa.int64()),
                     pa.ListArray.from_arrays(cut, pa.array(flat, mask=np.isnan(flat)))],
                    names=["vec_id", "deviation", "values"])

    rows = _rows(df.withColumnRenamed(vec_id, "vec_id") if vec_id != "vec_id" else df, vector, ["vec_id"], len(model.centre.sums))
    wide = rows.mapInArrow(run, f"vec_id {kind}, deviation long, values array<double>")
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    return (wide.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                    F.lit(model.identity_error).cast("double").alias("identity_error")))
