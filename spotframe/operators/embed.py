"""PCA embedding and component choice.

G8 works on sparse rows over the selected (variable) genes.  Tasks add up the outer products of
their cells, pair by pair of a cell's entries, so the work follows the entries; only cells with
many entries are made dense, ``BLOCK`` at a time.  Only the upper triangle of that Gram matrix,
with the sums as a last column, leaves a task, is added up row by row, and is centred in closed form.  Its genes x genes
matrix is the one thing on the driver, bounded by the selected genes.  Components get a fixed
sign (largest absolute loading positive).  G9 fits log stdev = a + b log pc by regr_slope / regr_intercept
and picks the first PC whose fitted drop to the next is below 1 % of the total
fitted drop, clamped to [5, 20].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import ship_library, stage

KEYS = ["sample", "barcode"]
BLOCK = 512          # cells made dense at a time inside a task
DENSE = 24           # a cell with more than a DENSE-th of the genes is made dense
PAIRS = 1 << 20      # pairs of entries written out at a time inside a task


def gene_index(spark, genes: list[str]) -> DataFrame:
    """(gene, i): positions of the selected genes."""
    return spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, i int")


def dense_vectors(values: DataFrame, genes: list[str]) -> DataFrame:
    """(sample, barcode, vec array<double>) over ``genes`` (absent = 0)."""
    p = len(genes)
    # one row per selected gene: bounded by the list the caller passed
    v = values.join(F.broadcast(gene_index(values.sparkSession, genes)), "gene").select(*KEYS, "i", "value")
    per = v.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("_m"))
    return per.select(*KEYS, F.transform(F.sequence(F.lit(0), F.lit(p - 1)),
                                         lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0))).alias("vec"))


def sparse_rows(values: DataFrame, genes: list[str], cells: DataFrame | None = None) -> DataFrame:
    """(sample, barcode, at array<int>, x array<double>): entries of the selected genes by their
    position.  With ``cells``, one row for each of them, empty where a cell has no entry."""
    # one row per selected gene: bounded by the list the caller passed
    v = values.join(F.broadcast(gene_index(values.sparkSession, genes)), "gene")
    per = v.groupBy(*KEYS).agg(F.collect_list(F.struct("i", "value")).alias("_e"))
    if cells is not None:
        per = cells.select(*KEYS).join(per, KEYS, "left")
    return per.select(*KEYS, F.coalesce("_e.i", F.array().cast("array<int>")).alias("at"),
                      F.coalesce("_e.value", F.array().cast("array<double>")).alias("x"))


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, x, size): the entries of all rows of a batch, one row's after the other's, and how many each row has."""
    at, x = batch.column("at"), batch.column("x")
    return at.flatten().to_numpy(), x.flatten().to_numpy(), np.diff(at.offsets.to_numpy())


def _add_pairs(total: np.ndarray, at: np.ndarray, x: np.ndarray, size: np.ndarray) -> None:
    """Add every row's outer product with itself, ``PAIRS`` products at a time."""
    rows = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size.astype(np.int64) ** 2) // PAIRS)) + 1, [len(size)]])
    ends = np.concatenate([[0], np.cumsum(size)])
    for lo, hi in zip(rows, rows[1:]):
        n, some = size[lo:hi], slice(ends[lo], ends[hi])
        others = np.repeat(n, n)                                   # per entry: the entries of its row
        left = np.repeat(np.arange(len(others)), others)
        skip = np.cumsum(others) - others - np.repeat(np.cumsum(n) - n, n)
        right = np.arange(len(left)) - np.repeat(skip, others)
        np.add.at(total.reshape(-1), at[some][left].astype(np.int64) * len(total) + at[some][right], x[some][left] * x[some][right])


def _add_dense(total: np.ndarray, at: np.ndarray, x: np.ndarray, size: np.ndarray) -> None:
    """The same by matrix products of ``BLOCK`` rows."""
    ends = np.concatenate([[0], np.cumsum(size)])
    for lo in range(0, len(size), BLOCK):
        n = size[lo:lo + BLOCK]
        some = slice(ends[lo], ends[lo + len(n)])
        dense = np.zeros((len(n), len(total)))
        np.add.at(dense, (np.repeat(np.arange(len(n)), n), at[some]), x[some])
        total += dense.T @ dense


def _gram(rows: DataFrame, p: int) -> np.ndarray:
    """Sum over all rows of the outer product of (entries, 1) with itself."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p + 1, p + 1))
        for batch in batches:
            at, x, size = _entries(batch)
            many = size > p // DENSE
            of = np.repeat(many, size)
            _add_dense(total, at[of], x[of], size[many])
            _add_pairs(total, at[~of], x[~of], size[~many])
            total[:p, p] += np.bincount(at, x, p)
            total[p, p] += batch.num_rows
        if total[p, p]:
            for start in range(0, p + 1, 256):
                some = range(start, min(start + 256, p + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([total[i, i:] for i in some], pa.list_(pa.float64()))], ["i", "g"])

    parts = rows.select("at", "x").mapInArrow(blocks, "i int, g array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    full = np.zeros((p + 1, p + 1))
    for r in sums.select("i", vector_to_array("g").alias("g")).toArrow().to_batches():   # p + 1 rows
        g = r.column("g")
        for i, lo, hi in zip(r.column("i").to_numpy(), g.offsets.to_numpy(), g.offsets.to_numpy()[1:]):
            full[i, i:] = full[i:, i] = g.values.to_numpy()[lo:hi]
    return full


def _project(rows: DataFrame, comp: np.ndarray, shift: np.ndarray) -> DataFrame:
    """(sample, barcode, vec): every row times ``comp`` less ``shift``.  The factors travel to
    the tasks: genes x components numbers."""
    k = comp.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                at, x, size = _entries(part)
                genes, at = np.unique(at, return_inverse=True)     # only genes that occur in the block
                dense = np.zeros((len(part), len(genes)))
                np.add.at(dense, (np.repeat(np.arange(len(part)), size), at), x)
                vec = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * k, (dense @ comp[genes] - shift).ravel())
                yield pa.RecordBatch.from_arrays([part.column("sample"), part.column("barcode"), vec], ["sample", "barcode", "vec"])

    return rows.select(*KEYS, "at", "x").mapInArrow(run, "sample string, barcode string, vec array<double>")


def pca(values: DataFrame, genes: list[str], k: int, cells: DataFrame | None = None,
        absent: DataFrame | None = None) -> dict[str, DataFrame]:
    """Embedding (sample, barcode, vec), stdev (pc, stdev), loadings (gene, pc, loading); at
    most as many components as genes.

    ``absent`` (gene, zero_z): what an entry without a row is worth, as ``scale_genes``
    returns it.  It is subtracted from the rows that exist, so absent entries are 0; the
    shift is constant per gene and centring removes it.  Entries that repeat add up.
    """
    spark, p = values.sparkSession, len(genes)
    ship_library(spark)
    if absent is not None:
        values = values.join(absent.select("gene", "zero_z"), "gene").select(
            *KEYS, "gene", (F.col("value") - F.col("zero_z")).alias("value"))
    rows = stage(sparse_rows(values, genes, cells))
    gram = _gram(rows, p)
    n = max(gram[p, p], 1.0)
    mean = gram[p, :p] / n
    var, comp = np.linalg.eigh((gram[:p, :p] - n * np.outer(mean, mean)) / max(n - 1.0, 1.0))
    k = min(k, p)
    var, comp = var[::-1][:k], comp[:, ::-1][:, :k]
    comp = np.ascontiguousarray(comp * np.where(comp[np.abs(comp).argmax(axis=0), range(k)] < 0, -1.0, 1.0))
    stdev = spark.createDataFrame([(j + 1, float(s)) for j, s in enumerate(np.sqrt(np.maximum(var, 0.0)))], "pc int, stdev double")
    load = spark.createDataFrame([(g, c.tolist()) for g, c in zip(genes, comp)], "gene string, v array<double>")
    load = load.select("gene", F.posexplode("v").alias("j", "loading")).select(
        "gene", (F.col("j") + 1).alias("pc"), "loading")
    return {"embedding": _project(rows, comp, mean @ comp), "stdev": stdev, "loadings": load}


def choose_pcs(stdev: DataFrame, lo: int = 5, hi: int = 20, frac: float = 0.01) -> DataFrame:
    """G9 (+ B18): one row with the fitted power law and the chosen PC count."""
    fit = stdev.agg(F.regr_slope(F.log("stdev"), F.log("pc")).alias("b"),
                    F.regr_intercept(F.log("stdev"), F.log("pc")).alias("a"),
                    F.max("pc").alias("n_pc")).first()             # three scalars
    a, b, n_pc = float(fit["a"]), float(fit["b"]), int(fit["n_pc"])
    t = stdev.withColumn("fitted", F.exp(F.lit(a) + F.lit(b) * F.log("pc")))
    w = Window.orderBy("pc")                                     # <= a few hundred components
    all_ = Window.partitionBy()
    t = (t.withColumn("drop", F.col("fitted") - F.lead("fitted").over(w))
          .withColumn("total", F.max("fitted").over(all_) - F.min("fitted").over(all_)))
    first = t.filter(F.col("drop") < F.lit(frac) * F.col("total")).agg(F.min("pc").alias("pc_elbow"))
    return first.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(n_pc).alias("n_pc"), "pc_elbow",
                        F.least(F.greatest(F.coalesce("pc_elbow", F.lit(n_pc)), F.lit(lo)), F.lit(hi)).alias("n_chosen"))


def top_loadings(loadings: DataFrame, k: int) -> DataFrame:
    """Top-k genes per component by |loading|."""
    w = Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "gene")
    return loadings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
