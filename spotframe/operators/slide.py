"""Spot adjacency, distance-band pairs and neighbourhood views.

Joins of two tables with a row or more per spot carry the "merge" hint: staged Parquet is much
smaller than its rows, so such a table can look small enough to go through the driver.

No theta joins: hexagonal neighbours are an equi-join on exploded neighbour
positions; distance bands bin coordinates into r x r cells, explode the 3 x 3
neighbouring cells on one side, equi-join on the cell, then filter exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["sample", "barcode"]

# Neighbour offsets (d_row, d_col) of the hexagonal array layout.
HEX_OFFSETS = [(0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)]


def spot_neighbors(spots: DataFrame, include_self: bool = False) -> DataFrame:
    """Directed edges (sample, src, dst, weight=1) between immediate hexagonal neighbours."""
    offs = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in HEX_OFFSETS])
    src = spots.select("sample", F.col("barcode").alias("src"), F.explode(offs).alias("o"),
                       "array_row", "array_col")
    src = src.select("sample", "src", (F.col("array_row") + F.col("o.dr")).alias("array_row"),
                     (F.col("array_col") + F.col("o.dc")).alias("array_col"))
    dst = spots.select("sample", F.col("barcode").alias("dst"), "array_row", "array_col")
    e = src.join(dst.hint("merge"), ["sample", "array_row", "array_col"]).select("sample", "src", "dst")
    if include_self:
        e = e.unionByName(spots.select("sample", F.col("barcode").alias("src"), F.col("barcode").alias("dst")))
    return e.withColumn("weight", F.lit(1.0))


def spot_pairs_within(spots: DataFrame, r: float, include_self: bool = False) -> DataFrame:
    """C11: directed pairs (sample, src, dst, d) with Euclidean distance d <= r."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(r))).cast("long")
    a = spots.select("sample", F.col("barcode").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"),
                     cell("x").alias("cx"), cell("y").alias("cy"))
    nb = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = a.select("*", F.explode(nb).alias("o")).select(
        "sample", "src", "xa", "ya", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    b = spots.select("sample", F.col("barcode").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"),
                     cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    p = a.join(b.hint("merge"), ["sample", "cx", "cy"]).select("sample", "src", "dst", d.alias("d"))
    p = p.filter(F.col("d") <= F.lit(float(r)))
    if not include_self:
        p = p.filter(F.col("src") != F.col("dst"))
    return p


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("sample", "src").agg(F.count("*").alias("deg"))


def neighbor_mean(values: DataFrame, edges: DataFrame, key: str | list[str]) -> DataFrame:
    """Mean of ``value`` over each spot's neighbours (absent = 0), for every ``key`` seen nearby.

    values: (sample, barcode, *key, value) sparse; edges: (sample, src, dst).
    Returns (sample, barcode, *key, nbr_mean) for spots with a non-zero neighbour sum.
    """
    key = [key] if isinstance(key, str) else list(key)
    v = values.select("sample", F.col("barcode").alias("dst"), *key, "value")
    s = edges.select("sample", "src", "dst").join(v.hint("merge"), ["sample", "dst"]).groupBy("sample", "src", *key).agg(
        F.sum("value").alias("_s"))
    return s.join(degree(edges).hint("merge"), ["sample", "src"]).select(
        "sample", F.col("src").alias("barcode"), *key, (F.col("_s") / F.col("deg")).alias("nbr_mean"))


def views(composition: DataFrame, spots: DataFrame, para_l: float, para_cutoff: float | None = None,
          key: str = "cell_type", value: str = "score") -> DataFrame:
    """Intra (own), juxta (sum over immediate neighbours), para (sum of exp(-d^2 / l^2)-weighted
    values within ``3 l``, self excluded). Long output (sample, barcode, view, cell_type, value)."""
    comp = composition.select(*KEYS, F.col(key).alias("cell_type"), F.col(value).alias("value"))
    intra = comp.withColumn("view", F.lit("intra"))
    hex_e = spot_neighbors(spots)
    juxta = (hex_e.join(comp.withColumnRenamed("barcode", "dst").hint("merge"), ["sample", "dst"])
             .groupBy("sample", F.col("src").alias("barcode"), "cell_type").agg(F.sum("value").alias("value"))
             .withColumn("view", F.lit("juxta")))
    cut = para_cutoff if para_cutoff is not None else 3.0 * para_l
    pairs = spot_pairs_within(spots, cut).withColumn("w", F.exp(-F.pow(F.col("d") / F.lit(float(para_l)), 2)))
    para = (pairs.join(comp.withColumnRenamed("barcode", "dst").hint("merge"), ["sample", "dst"])
            .groupBy("sample", F.col("src").alias("barcode"), "cell_type")
            .agg(F.sum(F.col("w") * F.col("value")).alias("value"))
            .withColumn("view", F.lit("para")))
    cols = ["sample", "barcode", "view", "cell_type", "value"]
    return intra.select(*cols).unionByName(juxta.select(*cols)).unionByName(para.select(*cols))
