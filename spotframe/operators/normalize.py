"""Normalisation and variable-gene selection, zero-aware.

Statistics that include zeros are closed-form in (n_cells, n_nonzero, sums over
non-zeros); the gene x cell grid is never materialised.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.ranks import exact_percentile
from spotframe.session import stage

KEYS = ["sample", "barcode"]


def depth(expr: DataFrame) -> DataFrame:
    return expr.groupBy(*KEYS).agg(F.sum("value").alias("depth"))


def median_depth(cells: DataFrame, expr: DataFrame, depths: DataFrame | None = None) -> float:
    """Exact median of per-cell totals (``depths``, if at hand) over ``cells`` (cells without
    counts count as 0).  Computed from distributed ranks, so no task ever buffers all cells."""
    d = cells.select(*KEYS).join(depths if depths is not None else depth(expr), KEYS, "left").select(F.coalesce("depth", F.lit(0.0)).alias("depth"))
    return float(exact_percentile(d, "depth", 0.5).first()[0])


def normalize_total(expr: DataFrame, target: float | None = None, cells: DataFrame | None = None,
                    log: bool = False) -> DataFrame:
    """G2 (and G1 with ``log``): v / depth * target; target defaults to the median depth, for
    which the depths are written once."""
    d = depth(expr)
    if target is None:
        d = stage(d)
        target = median_depth(cells if cells is not None else expr.select(*KEYS).distinct(), expr, d)
    v = F.col("value") / F.col("depth") * F.lit(float(target))
    if log:
        v = F.log1p(v)
    # one row per cell: small in its files, but it grows with the cells and would fill the driver as rows
    return expr.join(d.hint("merge"), KEYS).select(*KEYS, "gene", v.alias("value"))


def log_normalize(expr: DataFrame, scale: float | None = None, cells: DataFrame | None = None) -> DataFrame:
    """G1: ln(1 + v / depth * scale); scale defaults to the exact median depth."""
    return normalize_total(expr, scale, cells, log=True)


def log1p_layer(expr: DataFrame) -> DataFrame:
    """G3."""
    return expr.withColumn("value", F.log1p("value"))


def gene_moments(expr: DataFrame, n_cells: int, unlog: bool = False) -> DataFrame:
    """Mean and sample variance per gene over all ``n_cells`` cells, zeros included."""
    v = F.expm1("value") if unlog else F.col("value")
    n = F.lit(float(n_cells))
    g = expr.groupBy("gene").agg(F.count("*").alias("nnz"), F.sum(v).alias("s1"), F.avg(v).alias("_m"),
                                 F.var_pop(v).alias("_v"))
    mean = F.col("s1") / n
    # squares about the mean: within the rows that exist, between them and the mean, and the zeros
    ss = (F.col("_v") * F.col("nnz") + F.col("nnz") * F.pow(F.col("_m") - mean, 2)
          + (n - F.col("nnz")) * F.pow(mean, 2))
    return g.select("gene", "nnz", mean.alias("mean"), (ss / (n - F.lit(1.0))).alias("var"))


def _det3(m):
    return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))


def solve3(a, b):
    """3 x 3 linear solve by Cramer's rule (the normal equations of a quadratic fit)."""
    d = _det3(a)
    out = []
    for k in range(3):
        m = [[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
        out.append(_det3(m) / d)
    return out


def hvg_vst(expr: DataFrame, n_cells: int, n: int = 3000) -> DataFrame:
    """Standardised variance after a quadratic mean-variance trend in log10 space.

    Trend: least squares log10 var ~ 1 + log10 mean + (log10 mean)^2 on genes with var > 0
    (normal equations from 9 sums, solved on the driver: a 3 x 3 system).
    z = (v - mean) / sd_hat clipped above at sqrt(N); zeros contribute (-mean / sd_hat)^2 each.
    """
    mom = stage(gene_moments(expr, n_cells))                     # the trend and the variances read them
    fit = mom.filter(F.col("var") > 0).select(F.log10("mean").alias("x"), F.log10("var").alias("y"))
    sums = fit.agg(F.count("*").alias("x0"), F.sum("x").alias("x1"), F.sum(F.col("x") * F.col("x")).alias("x2"),
                   F.sum(F.col("x") * F.col("x") * F.col("x")).alias("x3"),
                   F.sum(F.col("x") * F.col("x") * F.col("x") * F.col("x")).alias("x4"),
                   F.sum("y").alias("y0"), F.sum(F.col("y") * F.col("x")).alias("y1"),
                   F.sum(F.col("y") * F.col("x") * F.col("x")).alias("y2")).first()
    c0, c1, c2 = solve3([[sums[f"x{i + j}"] for j in range(3)] for i in range(3)], [sums[f"y{i}"] for i in range(3)])
    lx = F.log10("mean")
    sd_hat = F.sqrt(F.pow(F.lit(10.0), F.lit(float(c0)) + F.lit(float(c1)) * lx + F.lit(float(c2)) * lx * lx))
    clip = math.sqrt(n_cells)
    mom = mom.withColumn("sd_hat", sd_hat)
    e = expr.join(mom.select("gene", "mean", "sd_hat"), "gene")
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd_hat"), F.lit(clip))
    nz = e.groupBy("gene").agg(F.sum(z * z).alias("sz2"))
    out = mom.join(nz, "gene").withColumn(
        "variance_standardized",
        (F.col("sz2") + (F.lit(float(n_cells)) - F.col("nnz")) * F.pow(F.col("mean") / F.col("sd_hat"), 2))
        / F.lit(float(n_cells - 1)))
    # distributed top-k (TakeOrderedAndProject): each task keeps n rows, then one merge of n rows
    top = out.select("gene", "mean", "var", "variance_standardized").orderBy(
        F.desc("variance_standardized"), "gene").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("variance_standardized"), "gene")))


def quadratic_trend(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, c0, c1, c2) of the least squares y ~ c0 + c1 x + c2 x^2 in every group of
    ``points(*by, x, y)``: nine sums a group, solved as columns.  Null where a group has fewer
    than three distinct x."""
    x, y = F.col("x"), F.col("y")
    sums = points.groupBy(*by).agg(*[F.sum(F.pow(x, i)).alias(f"x{i}") for i in range(5)],
                                   *[F.sum(y * F.pow(x, i)).alias(f"y{i}") for i in range(3)])
    a = [[F.col(f"x{i + j}") for j in range(3)] for i in range(3)]
    b = [F.col(f"y{i}") for i in range(3)]
    minors = [[[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return sums.select(*by, _det3(a).alias("_d"), *[_det3(m).alias(f"_n{k}") for k, m in enumerate(minors)]).select(
        *by, *[F.try_divide(F.col(f"_n{k}"), F.col("_d")).alias(f"c{k}") for k in range(3)])


def _ten_to_trend(lx):
    return F.pow(F.lit(10.0), F.col("c0") + F.col("c1") * lx + F.col("c2") * lx * lx)


def hvg_vst_by(expr: DataFrame, by: str = "sample", n: int = 3000) -> DataFrame:
    """G5 inside every sample at once: (sample, gene, variance_standardized, rank) of the ``n`` most
    variable genes of each.  Every sample has its own cells, moments and trend, all from one
    grouping by (sample, gene) and one join back for the clipped squares.  Variances are ranked
    to six digits, equal ones by gene."""
    cells = expr.select(by, "barcode").distinct().groupBy(by).agg(F.count("*").cast("double").alias("n"))
    mom = expr.groupBy(by, "gene").agg(F.count("*").alias("nnz"), F.sum("value").alias("s1"),
                                       F.avg("value").alias("_m"), F.var_pop("value").alias("_v")).join(cells, by)
    mom = mom.filter(F.col("n") > 1).withColumn("mean", F.col("s1") / F.col("n"))
    # squares about the mean, as in gene_moments
    ss = (F.col("_v") * F.col("nnz") + F.col("nnz") * F.pow(F.col("_m") - F.col("mean"), 2)
          + (F.col("n") - F.col("nnz")) * F.pow("mean", 2))
    mom = mom.select(by, "gene", "nnz", "n", "mean", (ss / (F.col("n") - 1)).alias("var")).filter(F.col("mean") > 0)
    trend = quadratic_trend(mom.filter(F.col("var") > 0).select(by, F.log10("mean").alias("x"), F.log10("var").alias("y")), [by])
    mom = mom.join(trend, by).select(by, "gene", "nnz", "n", "mean", F.sqrt(_ten_to_trend(F.log10("mean"))).alias("sd_hat"))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd_hat"), F.sqrt("n"))
    squares = expr.join(mom.select(by, "gene", "n", "mean", "sd_hat"), [by, "gene"]).groupBy(by, "gene").agg(
        F.sum(z * z).alias("sz2"))
    out = mom.join(squares, [by, "gene"]).select(by, "gene", F.round(
        (F.col("sz2") + (F.col("n") - F.col("nnz")) * F.pow(F.col("mean") / F.col("sd_hat"), 2)) / (F.col("n") - 1), 6)
        .alias("variance_standardized"))
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("variance_standardized"), "gene")     # bounded by the genes
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def integration_features(hvgs: DataFrame, n: int = 3000) -> DataFrame:
    """Genes variable in any sample, (gene, n_samples, median_rank, rank): by the number of
    samples that chose them, then by their median rank there, then by name; the first ``n``."""
    g = hvgs.groupBy("gene").agg(F.count("*").alias("n_samples"), F.median("rank").alias("median_rank"))
    order = [F.desc("n_samples"), F.asc("median_rank"), F.asc("gene")]
    return g.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


THETA_RANGE = (0.01, 10_000.0)


def fit_theta(expr: DataFrame, depth: DataFrame) -> DataFrame:
    """(gene, theta): overdispersion of every gene under mu = gene total * depth / all counts.

    By moments, theta = sum mu^2 / (sum (x - mu)^2 - sum mu) over all cells, zeros included:
    closed form in the gene's sums of x, x^2 and x * depth.  log10 theta of the overdispersed
    genes is then smoothed by a quadratic in log10 mean, and every gene takes the trend's value,
    kept inside ``THETA_RANGE`` (the upper end where no trend can be fitted)."""
    whole = depth.agg(F.count("*").alias("n"), F.sum("depth").alias("t"), F.sum(F.col("depth") * F.col("depth")).alias("t2")).first()
    n, t, t2 = (float(v or 0.0) for v in whole)
    g = expr.join(depth, KEYS).groupBy("gene").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("xx"),
        F.sum(F.col("value") * F.col("depth")).alias("xd")).filter(F.col("total") > 0)
    share = F.col("total") / F.lit(t)
    excess = F.col("xx") - F.lit(2.0) * share * F.col("xd") + share * share * F.lit(t2) - F.col("total")
    g = g.select("gene", F.log10(F.col("total") / F.lit(n)).alias("x"),
                 F.when(excess > 0, F.log10(share * share * F.lit(t2) / excess)).alias("y")).withColumn("_one", F.lit(0))
    trend = quadratic_trend(g.filter(F.col("y").isNotNull()), ["_one"])       # one row
    low, high = (F.lit(v) for v in THETA_RANGE)
    return g.join(F.broadcast(trend), "_one", "left").select(
        "gene", F.coalesce(F.least(F.greatest(_ten_to_trend(F.col("x")), low), high), high).alias("theta"))


def pearson_hvgs(expr: DataFrame, depth: DataFrame, n: int = 3000) -> DataFrame:
    """G4 selection: the ``n`` genes with the largest variance of Pearson residuals under their own
    smoothed theta: gene, theta, mean, var (to six digits, equal ones by gene), rank."""
    theta = fit_theta(expr, depth)
    _, stats = pearson_residuals(expr, depth, theta)
    out = stats.join(theta, "gene").select("gene", "theta", "mean", F.round("var", 6).alias("var"))
    order = [F.desc("var"), F.asc("gene")]
    return out.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hvg_dispersion(expr: DataFrame, n_cells: int, min_mean: float = 0.0125, max_mean: float = 3.0,
                   min_disp: float = 0.5, bins: int = 20) -> DataFrame:
    """Mean / normalised-dispersion cut-offs on unlogged values (ExpMean / LogVMR style).

    mean' = ln(1 + m), dispersion = ln(s^2 / m); genes binned in ``bins`` equal-width bins of mean',
    z-scored inside the bin (one-gene bin -> z = 1); m = 0 excluded.
    """
    mom = gene_moments(expr, n_cells, unlog=True).filter(F.col("mean") > 0)
    g = mom.select("gene", F.log1p("mean").alias("mean_log"),
                   F.log(F.col("var") / F.col("mean")).alias("dispersion"))
    rng = g.agg(F.min("mean_log").alias("lo"), F.max("mean_log").alias("hi")).first()
    lo, hi = float(rng["lo"]), float(rng["hi"])
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("mean_log") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    g = g.withColumn("bin", b)
    wb = Window.partitionBy("bin")
    g = (g.withColumn("_m", F.avg("dispersion").over(wb))
          .withColumn("_s", F.stddev_samp("dispersion").over(wb))
          .withColumn("_n", F.count("*").over(wb)))
    z = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((F.col("dispersion") - F.col("_m")) / F.col("_s"))
    g = g.withColumn("dispersion_norm", z).drop("_m", "_s", "_n")
    return g.filter((F.col("mean_log") > min_mean) & (F.col("mean_log") < max_mean)
                    & (F.col("dispersion_norm") >= min_disp))


def scale_genes(expr: DataFrame, n_cells: int, genes: DataFrame | None = None, clip: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Z-score per gene over all cells, clipped at ``clip``.

    Returns (nonzero entries with their z, per-gene table with ``zero_z`` = the z of every
    absent entry).  The dense block is left to the caller, on selected genes only.
    """
    e = expr.join(genes.select("gene"), "gene", "left_semi") if genes is not None else expr
    mom = gene_moments(e, n_cells).withColumn("sd", F.sqrt("var"))
    zc = lambda v: F.when(F.col("sd") > 0, F.least(F.greatest((v - F.col("mean")) / F.col("sd"), F.lit(-clip)), F.lit(clip))).otherwise(F.lit(0.0))
    nz = e.join(mom.select("gene", "mean", "sd"), "gene").select(*KEYS, "gene", zc(F.col("value")).alias("value"))
    g = mom.select("gene", "mean", "sd", zc(F.lit(0.0)).alias("zero_z"))
    return nz, g


def dense_scaled(nonzero: DataFrame, absent: DataFrame, cells: DataFrame) -> DataFrame:
    """Every cell of ``cells`` with every gene of ``absent`` (outputs of ``scale_genes`` on
    selected genes): the z of its entry, or the gene's zero z where it has none.  The genes
    travel as one array, so each cell is widened where it lies."""
    genes = absent.agg(F.collect_list(F.struct("gene", "zero_z")).alias("_genes")).withColumn("_one", F.lit(0))
    grid = (cells.withColumn("_one", F.lit(0)).join(F.broadcast(genes), "_one").drop("_one")
            .select("*", F.explode("_genes").alias("_g")).select("*", "_g.gene", "_g.zero_z").drop("_genes", "_g"))
    return (grid.join(nonzero.select(*KEYS, "gene", "value"), [*KEYS, "gene"], "left")
            .withColumn("value", F.coalesce("value", "zero_z")).drop("zero_z"))


def pearson_residuals(expr: DataFrame, depth: DataFrame, theta: float | DataFrame = 100.0, clip: float | None = None,
                      genes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Analytic Pearson residuals of counts under a negative binomial null,
    r = (x - mu) / sqrt(mu + mu^2 / theta) with mu = gene total * depth / all counts, clipped at
    +-sqrt(cells) (``clip``).  ``depth``: (sample, barcode, depth) of every cell; ``theta``: one
    number or (gene, theta), as ``fit_theta`` gives.

    Returns (entries of ``genes`` that exist with their residual, per gene: total, mean and
    variance of the residual over all cells).  A zero's residual depends only on the gene and
    the cell's depth, so zeros are summed over the histogram of distinct depths (bounded by
    the largest depth) and never written out."""
    n = depth.count()
    bound = F.lit(float(clip if clip is not None else math.sqrt(n)))
    total = float(depth.agg(F.sum("depth")).first()[0] or 0.0)
    e = expr.join(genes.select("gene"), "gene", "left_semi") if genes is not None else expr
    sums = e.groupBy("gene").agg(F.sum("value").alias("total"))
    sums = sums.join(theta, "gene") if isinstance(theta, DataFrame) else sums.withColumn("theta", F.lit(float(theta)))

    def residual(x):
        mu = F.col("total") * F.col("depth") / F.lit(total)
        r = (x - mu) / F.sqrt(mu + mu * mu / F.col("theta"))
        return F.when(mu > 0, F.least(F.greatest(r, -bound), bound)).otherwise(F.lit(0.0))

    nz = e.join(sums, "gene").join(depth, KEYS)
    nz = nz.select(*KEYS, "gene", residual(F.col("value")).alias("value"), residual(F.lit(0.0)).alias("_zero"))
    have = nz.groupBy("gene").agg(F.sum(F.col("value") - F.col("_zero")).alias("_d1"),
                                  F.sum(F.col("value") * F.col("value") - F.col("_zero") * F.col("_zero")).alias("_d2"))
    hist = depth.groupBy("depth").agg(F.count("*").alias("n"))
    hist = hist.agg(F.collect_list(F.struct("depth", "n")).alias("_h")).withColumn("_one", F.lit(0))
    wide = (sums.withColumn("_one", F.lit(0)).join(F.broadcast(hist), "_one")
            .select("gene", "total", "theta", F.explode("_h").alias("_x"))
            .select("gene", "total", "theta", "_x.depth", "_x.n"))
    zero = residual(F.lit(0.0))
    all0 = wide.groupBy("gene", "total").agg(F.sum(zero * F.col("n")).alias("_z1"), F.sum(zero * zero * F.col("n")).alias("_z2"))
    mean = (F.col("_z1") + F.col("_d1")) / F.lit(float(n))
    var = (F.col("_z2") + F.col("_d2") - F.lit(float(n)) * mean * mean) / F.lit(float(n - 1))
    stats = all0.join(have, "gene").select("gene", "total", mean.alias("mean"), var.alias("var"))
    return nz.drop("_zero"), stats
