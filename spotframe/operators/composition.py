"""Composition clustering of spots: Lloyd k-means on the long
spot x cell-type table, fixed iterations, deterministic start.

  distance(s, c) = |x_s|^2 - 2 x_s . c + |c|^2  (every spot against the centroid table of
                   k x types numbers, inside the task that holds the spot)
  start          the k spots first in md5(sample || '/' || barcode) order
  ties           smallest centroid index; an empty cluster keeps its centroid
  labels         CC1..CCk renumbered by cluster size (desc), then index
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from spotframe.session import cut_lineage, ship_library

KEYS = ["sample", "barcode"]


def _spot_hash() -> F.Column:
    return F.md5(F.concat_ws("/", "sample", "barcode"))


def initial_centroids(x: DataFrame, k: int) -> DataFrame:
    first = x.select(*KEYS).distinct().withColumn("_h", _spot_hash()).orderBy("_h").limit(k)
    first = first.withColumn("k", (F.row_number().over(Window.orderBy("_h")) - 1).cast("int"))
    return x.join(F.broadcast(first.select(*KEYS, "k")), KEYS).select("k", "cell_type", F.col("score").alias("c"))


def lloyd(x: DataFrame, k: int, iters: int, centroids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K1 core: returns (assignment (sample, barcode, k, dist), centroids (k, cell_type, c))."""
    C = centroids if centroids is not None else initial_centroids(x, k)
    assign, C = lloyd_models(x, C.withColumn("m", F.lit(k)), [k], iters)
    return assign.drop("m"), C.drop("m")


#: numbers in one block of spots x clusters made dense inside a task
DISTANCE_CELLS = 1 << 20


def _nearest(batch: pa.RecordBatch, cents: np.ndarray, cc: np.ndarray, starts: list[int]) -> Iterator[tuple]:
    """(first row, spot vectors, nearest cluster of every model, its distance) for blocks of the batch's
    spots; types add up in their own order, so that equal centroids stay equally far.  The last column,
    of rows without a type, meets no centroid."""
    step, n_types = max(1, DISTANCE_CELLS // max(1, len(cc))), cents.shape[1]
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        t, n = part.column("t"), part.num_rows
        x = np.zeros((n, n_types))
        np.add.at(x, (np.repeat(np.arange(n), pc.list_value_length(t).to_numpy()), t.flatten().to_numpy()),
                  part.column("s").flatten().to_numpy())
        dot = np.zeros((n, len(cc)))
        for k in range(n_types - 1):
            dot += x[:, k, None] * cents[:, k]
        dist = part.column("xx").to_numpy(zero_copy_only=False)[:, None] - 2.0 * dot + cc
        k = np.stack([dist[:, a:b].argmin(1) for a, b in zip(starts, starts[1:])], 1)
        yield start, x, k, np.take_along_axis(dist, k + np.array(starts[:-1]), 1)


def lloyd_models(x: DataFrame, C: DataFrame, ks: list[int], iters: int) -> tuple[DataFrame, DataFrame]:
    """Several k-means models at once, each of ``ks`` clusters and named ``m`` by their number.
    A spot is one row with its scores in a list; a task measures its spots against every centroid
    and hands on sums per cluster and type.  Centroid tables have sum(ks) x types numbers.  The
    centroids returned leave out zeros."""
    spark = x.sparkSession
    types = sorted(r[0] for r in x.select("cell_type").distinct().dropna().collect())      # cell types
    index = spark.createDataFrame([(c, i) for i, c in enumerate(types)], "cell_type string, t int")
    types = [*types, None]       # rows without a type count in a centroid's length alone
    entry = F.when(F.col("score").isNotNull() & F.col("sample").isNotNull() & F.col("barcode").isNotNull(),
                   F.struct(F.coalesce("t", F.lit(len(types) - 1)).alias("t"), "score"))
    spots = cut_lineage(x.join(F.broadcast(index), "cell_type", "left").groupBy(*KEYS)
                        .agg(F.sum(F.col("score") * F.col("score")).cast("double").alias("xx"), F.collect_list(entry).alias("_e"))
                        .select(*KEYS, "xx", F.col("_e.t").alias("t"), F.col("_e.score").cast("array<double>").alias("s")))
    starts = np.append(0, np.cumsum(ks)).tolist()
    of, at = dict(zip(ks, starts)), {c: i for i, c in enumerate(types)}
    cents, cc = np.zeros((starts[-1], len(types))), np.zeros(starts[-1])
    for r in C.dropna(subset=["c"]).collect():                                            # sum(ks) x types
        cents[of[r["m"]] + r["k"], at[r["cell_type"]]] += r["c"]
        cc[of[r["m"]] + r["k"]] += r["c"] * r["c"]
    ship_library(spark)

    def sums_of(cents: np.ndarray, cc: np.ndarray):
        def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((starts[-1], cents.shape[1] + 1))
            for batch in table:
                for _, v, k, _ in _nearest(batch, cents, cc, starts):
                    v = np.append(v, np.ones((len(v), 1)), 1)
                    for m, first in enumerate(starts[:-1]):
                        own = np.zeros((len(v), starts[m + 1] - first))
                        own[np.arange(len(v)), k[:, m]] = 1.0
                        total[first:starts[m + 1]] += own.T @ v
            p, t = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(t, pa.int32()), pa.array(total[p, t])], names=["p", "t", "s"])
        return run

    def named(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in table:
            for start, _, k, dist in _nearest(batch, cents, cc, starts):
                part, n = batch.slice(start, len(k)), len(ks)
                ends = pa.array(np.arange(0, k.size + 1, n), pa.int32())
                gone = np.repeat(part.column("xx").is_null().to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("sample"), part.column("barcode"), pa.ListArray.from_arrays(ends, pa.array(k.ravel(), pa.int32())),
                     pa.ListArray.from_arrays(ends, pa.array(dist.ravel(), mask=gone))], names=["sample", "barcode", "k", "dist"])

    for _ in range(iters):
        total = np.zeros((starts[-1], len(types) + 1))
        for r in spots.mapInArrow(sums_of(cents, cc), "p int, t int, s double").groupBy("p", "t").agg(F.sum("s").alias("s")).collect():
            total[r["p"], r["t"]] = r["s"]
        # an empty cluster keeps its centroid
        some = total[:, -1] > 0
        cents, cc = cents.copy(), cc.copy()
        cents[some] = total[some, :-1] / total[some, -1:]
        cc[some] = (cents[some] ** 2).sum(1)
    schema = StructType([*(spots.schema[c] for c in KEYS), StructField("k", ArrayType(IntegerType())), StructField("dist", ArrayType(DoubleType()))])
    found = cut_lineage(spots.mapInArrow(named, schema)).withColumn("m", F.array(*[F.lit(m) for m in ks]))
    assign = found.select(*KEYS, F.explode(F.arrays_zip("m", "k", "dist")).alias("_z")).select(*KEYS, "_z.m", "_z.k", "_z.dist")
    left = [(m, k, c, float(cents[of[m] + k, i])) for m in ks for k in range(m) for i, c in enumerate(types) if cents[of[m] + k, i]]
    return assign, spark.createDataFrame(left, "m int, k int, cell_type string, c double")


def relabel_by_size(assign: DataFrame, prefix: str = "CC") -> DataFrame:
    sizes = assign.groupBy("k").agg(F.count("*").alias("n"))
    order = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "k")))
    lab = order.select("k", F.concat(F.lit(prefix), F.col("_r").cast("string")).alias("cc"))
    return assign.join(F.broadcast(lab), "k").drop("k")


def composition_clusters(composition: DataFrame, k: int = 5, iters: int = 10) -> DataFrame:
    """K1: (sample, barcode, cc, dist) with labels CC1..CCk by size."""
    assign, _ = lloyd(composition, k, iters)
    return relabel_by_size(assign)


def elbow(composition: DataFrame, kmax: int = 20, iters: int = 10) -> DataFrame:
    """K2: within-cluster sum of squares for k = 1..kmax, all fitted together."""
    ks = list(range(1, kmax + 1))
    first = initial_centroids(composition, kmax)      # the start of k clusters is the first k of kmax
    models = F.explode(F.filter(F.array(*[F.lit(m) for m in ks]), lambda m: m > F.col("k"))).alias("m")
    assign, _ = lloyd_models(composition, first.select("*", models), ks, iters)
    return assign.groupBy(F.col("m").alias("k")).agg(F.sum("dist").alias("wcss"))
