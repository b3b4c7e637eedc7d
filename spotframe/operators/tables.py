"""Per-group tables and joins behind the reports
(SURVEY C1, C2, C4, C5, C13, D3, D4, D9, D10, D14, D16, D17, D18, E6, F1-F6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.ranks import exact_percentile, exact_percentiles

KEYS = ["sample", "barcode"]


def levels(df: DataFrame, col: str) -> list:
    """Distinct values of a categorical column, sorted: the column names of a wide table."""
    return sorted(r[0] for r in df.select(col).distinct().collect())


def align(expr: DataFrame, anno: DataFrame) -> DataFrame:
    """Restrict to annotated barcodes (semi join)."""
    return expr.join(anno.select(*KEYS), KEYS, "left_semi")


def attach_labels(df: DataFrame, anno: DataFrame, cols: list[str]) -> DataFrame:
    """Inner join of labels on (sample, barcode)."""
    return df.join(anno.select(*KEYS, *cols), KEYS, "inner")


def to_wide(long: DataFrame, key: str = "cell_type", value: str = "score", names: list | None = None,
            prefix: str = "") -> DataFrame:
    """Long -> wide at a sink (pivot over a bounded, explicit list of names)."""
    names = names if names is not None else levels(long, key)
    w = long.groupBy(*KEYS).pivot(key, names).agg(F.first(value))
    return w.select(*KEYS, *[F.col(f"`{n}`").alias(prefix + n) for n in names])


def attach_scores(spots: DataFrame, wide: DataFrame) -> DataFrame:
    """Left join of per-spot scores onto metadata."""
    return spots.join(wide, KEYS, "left")


def spot_coordinates(spots: DataFrame, scale: DataFrame, factor: str = "tissue_lowres_scalef") -> DataFrame:
    """C4: pixel coordinates times the per-sample image scale factor (one row per sample: broadcast)."""
    s = F.broadcast(scale.select("sample", F.col(factor).alias("_f")))
    return spots.join(s, "sample").select(
        *[c for c in spots.columns if c not in ("x", "y")],
        (F.col("x") * F.col("_f")).alias("x_img"), (F.col("y") * F.col("_f")).alias("y_img"))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keyed 1:1 join replacing positional column binding; fails on duplicate keys."""
    dup = right.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key in right side: {dup[0]}")
    return left.join(right, keys, "inner")


def feature_map(values: DataFrame, spots: DataFrame, names: list[str], name_col: str = "gene",
                lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Chosen features at every spot, missing = 0, optional min / max cut-off."""
    sel = values.filter(F.col(name_col).isin(names)).select(*KEYS, F.col(name_col).alias("feature"), "value")
    grid = spots.select(*KEYS, "x", "y", F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))
    v = F.coalesce(F.col("value"), F.lit(0.0))
    if lo is not None:
        v = F.greatest(v, F.lit(lo))
    if hi is not None:
        v = F.least(v, F.lit(hi))
    return grid.join(sel, KEYS + ["feature"], "left").select(*KEYS, "x", "y", "feature", v.alias("value"))


def crosstab_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """D3: frequency of (a, b) including zero cells, share within b and within a."""
    la, lb = levels(df, a), levels(df, b)
    counts = df.groupBy(a, b).agg(F.count("*").alias("freq"))
    grid = (df.sparkSession.range(1)
            .select(F.explode(F.array(*[F.lit(x) for x in la])).alias(a))
            .select(a, F.explode(F.array(*[F.lit(x) for x in lb])).alias(b)))
    t = grid.join(counts, [a, b], "left").fillna(0, ["freq"])
    wa = Window.partitionBy(b)
    wb = Window.partitionBy(a)
    return t.select(a, b, "freq",
                    (F.col("freq") / F.sum("freq").over(wa)).alias(f"share_in_{b}"),
                    (F.col("freq") / F.sum("freq").over(wb)).alias(f"share_in_{a}"))


def freq(df: DataFrame, col: str) -> DataFrame:
    """D4."""
    return df.groupBy(col).agg(F.count("*").alias("freq"))


def max_scale(composition: DataFrame, key: str = "cell_type", value: str = "score") -> DataFrame:
    """Scale each type's scores to the type maximum (0 maximum -> NULL via try_divide)."""
    m = composition.groupBy(key).agg(F.max(value).alias("_max"))
    return (composition.join(m, key)
            .withColumn(value, F.try_divide(F.col(value), F.col("_max"))).drop("_max"))


def top_label(composition: DataFrame, key: str = "cell_type", value: str = "score") -> DataFrame:
    """Per spot best class and its score; ties go to the first class in name order."""
    best = F.min_by(F.col(key), F.struct(-F.col(value), F.col(key)))
    return composition.groupBy(*KEYS).agg(best.alias("top_label"), F.max(value).alias("top_score"))


def clip_quantile(df: DataFrame, col: str, q: float, by: list[str] | None = None) -> DataFrame:
    """Clip ``col`` above at its exact ``q`` quantile (within ``by`` groups)."""
    by = by or []
    if by:
        qs = exact_percentile(df, col, q, by, out="_q")
        d = df.join(qs, by)
    else:
        qv = exact_percentile(df, col, q, out="_q").first()[0]
        d = df.withColumn("_q", F.lit(float(qv)))
    return d.withColumn(col, F.least(F.col(col), F.col("_q"))).drop("_q")


def n_batches(spots: DataFrame, col: str = "sample") -> int:
    """Number of distinct batches (drives the model covariate choice)."""
    return spots.select(F.countDistinct(col)).first()[0]


def qc_summary(metrics: DataFrame, cols: list[str], by: str = "sample",
               probs: tuple = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Exact quantiles of QC metrics per sample (the data behind violin plots), long form."""
    long = reduce(lambda a, b: a.unionByName(b),
                  [metrics.select(by, F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])
    res = exact_percentiles(long, "v", list(probs), [by, "metric"])
    return res.select(by, "metric", "prob", F.col("percentile").alias("value"))


def qc_scatter_r(metrics: DataFrame, a: str, b: str, by: str = "sample") -> DataFrame:
    """Pearson r of two QC metrics per sample (the number printed on the scatter plots)."""
    return metrics.groupBy(by).agg(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"))


def first_distinct(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """Distinct keys in first-seen order, first n."""
    first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_o"))
    return first.orderBy("_o", key).limit(n).select(key)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """bag union by name (missing columns -> NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(dfs: list[DataFrame], col: str) -> DataFrame:
    """Union of per-sample lists, de-duplicated."""
    return reduce(lambda a, b: a.union(b), [d.select(col) for d in dfs]).distinct()
