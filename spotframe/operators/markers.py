"""One-vs-rest marker genes and the per-cluster expression tables built on them
(SURVEY G19, D5, D6, D12, D13, D15, D19, B12, C6, C7).

``find_markers`` is a zero-aware Wilcoxon rank-sum test for every (gene, group)
at once.  Zeros form one tie block of rank (z + 1) / 2; the non-zero ranks come
from one window by gene, or from the skew-safe ``average_rank`` where a gene has
more than ``hot_distinct`` rows.  Per (gene, group):

  R1 = sum(rank of non-zeros in group) + z1 (z + 1) / 2,  U = R1 - n1 (n1 + 1) / 2
  sigma^2 = n1 n2 / 12 ((N + 1) - sum(t^3 - t) / (N (N - 1)))
  Z = max(|U - n1 n2 / 2| - 0.5, 0) / sigma,  p = erfc(Z / sqrt 2)
  log2FC = log2(mean expm1 in + 1) - log2(mean expm1 out + 1) over all cells
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.ranks import average_rank
from spotframe.functions.stats import norm_sf_two_sided, round_half_up
from spotframe.session import cut_lineage

KEYS = ["sample", "barcode"]


def group_sizes(labels: DataFrame, group: str) -> DataFrame:
    """(<group>, n1): one row per group."""
    return labels.groupBy(group).agg(F.count("*").alias("n1"))


def _explode_groups(df: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Every row of ``df`` once per group: the size table travels as one array, so each row
    is widened where it lies."""
    one = sizes.agg(F.collect_list(F.struct(group, "n1")).alias("_groups")).withColumn("_one", F.lit(0))
    return (df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")
            .select("*", F.explode("_groups").alias("_g")).select("*", f"_g.{group}", "_g.n1").drop("_groups", "_g"))


def _ranked_by_gene(rows: DataFrame, group: str) -> DataFrame:
    """Rows (gene, value, <group>, cnt) of ``rows`` with ``tie`` (weight of their value) and the average-tie
    rank of ``average_rank``, from one shuffle by gene; for genes whose rows fit one task."""
    up_to = F.sum("cnt").over(Window.partitionBy("gene").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tie = F.sum("cnt").over(Window.partitionBy("gene", "value"))
    count = F.sum("cnt") if "cnt" in rows.columns else F.count("*")
    d = rows.filter(F.col("gene").isNotNull()).repartition("gene").groupBy("gene", "value", group).agg(count.alias("cnt"))
    d = d.withColumn("_up_to", up_to).withColumn("tie", tie)
    return d.withColumn("rank", (F.col("_up_to") - F.col("tie")) + (F.col("tie") + F.lit(1)) / F.lit(2.0)).drop("_up_to")


def find_markers(expr: DataFrame, labels: DataFrame, group: str = "cluster", only_pos: bool = False,
                 min_pct: float = 0.0, min_logfc: float = 0.0, max_p: float | None = None,
                 n_genes: int | None = None, buckets: int = 32, hot_distinct: int = 100_000) -> DataFrame:
    """Markers for every group of ``labels`` (sample, barcode, <group>) against the rest.

    ``expr`` holds log-normalised non-zero values; cells absent from ``labels`` are ignored.
    Output: group, gene, avg_log2fc, pct_1, pct_2, z, p_val, p_val_adj; rows come unordered.  ``n_genes`` (Bonferroni m) defaults to the genes present in ``expr``.
    """
    lab = labels.select(*KEYS, F.col(group).cast("string").alias(group))
    sizes = cut_lineage(group_sizes(lab, group))
    n_all = sizes.agg(F.sum("n1")).first()[0] or 0
    if n_genes is None:
        n_genes = expr.select("gene").distinct().count()
    e = expr.join(lab, KEYS).select("gene", "value", group)
    # tables that feed two consumers (tie terms / rank sums) are materialised once; equal rows are counted
    # ahead of the ranks only where a gene has many
    many = lambda t: not t.groupBy("gene").count().filter(F.col("count") > hot_distinct).isEmpty()
    vc = cut_lineage(e.groupBy("gene", "value", group).agg(F.count("*").alias("cnt"))) if many(expr) else None
    if vc is None or not many(vc):
        ranked = cut_lineage(_ranked_by_gene(e if vc is None else vc, group))
        # rows of one value share its tie block t: t^3 - t is the sum of cnt (t^2 - 1) over them
        gstat = ranked.groupBy("gene").agg(
            F.sum("cnt").alias("nnz"),
            F.sum(F.col("cnt") * (F.pow(F.col("tie").cast("double"), 2) - F.lit(1.0))).alias("ties_nz"),
            F.sum(F.col("cnt") * F.expm1("value")).alias("s_all"))
        ranked = ranked.filter(F.col("value").isNotNull())
    else:
        ranks = cut_lineage(average_rank(vc, ["gene"], "value", weight="cnt", buckets=buckets, hot_distinct=hot_distinct))
        gstat = ranks.groupBy("gene").agg(
            F.sum("cnt").alias("nnz"),
            F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties_nz"),
            F.sum(F.col("cnt") * F.expm1("value")).alias("s_all"))
        ranked = vc.join(ranks.select("gene", "value", "rank"), ["gene", "value"])
    per = (ranked.groupBy("gene", group)
           .agg(F.sum("cnt").alias("nnz1"), F.sum(F.col("cnt") * F.col("rank")).alias("r_nz1"),
                F.sum(F.col("cnt") * F.expm1("value")).alias("s1")))
    grid = _explode_groups(gstat, sizes, group)
    t = grid.join(per, ["gene", group], "left").fillna(0, ["nnz1", "r_nz1", "s1"])
    N = F.lit(float(n_all))
    n1 = F.col("n1").cast("double")
    n2 = N - n1
    z = N - F.col("nnz")
    z1 = n1 - F.col("nnz1")
    r1 = F.col("r_nz1") + F.col("nnz1") * z + z1 * (z + F.lit(1.0)) / F.lit(2.0)
    u = r1 - n1 * (n1 + F.lit(1.0)) / F.lit(2.0)
    mu = n1 * n2 / F.lit(2.0)
    ties = F.col("ties_nz") + (z * z * z - z)
    var = n1 * n2 / F.lit(12.0) * ((N + F.lit(1.0)) - ties / (N * (N - F.lit(1.0))))
    sigma = F.sqrt(F.greatest(var, F.lit(0.0)))
    zabs = F.when(sigma > 0, F.greatest(F.abs(u - mu) - F.lit(0.5), F.lit(0.0)) / sigma).otherwise(F.lit(0.0))
    zstat = F.when(u < mu, -zabs).otherwise(zabs)
    p = F.when(sigma > 0, norm_sf_two_sided(zabs)).otherwise(F.lit(1.0))
    mean_in = F.col("s1") / n1
    mean_out = F.when(n2 > 0, (F.col("s_all") - F.col("s1")) / n2).otherwise(F.lit(0.0))
    lfc = F.log2(mean_in + F.lit(1.0)) - F.log2(mean_out + F.lit(1.0))
    pct1 = round_half_up(F.col("nnz1") / n1, 3)
    pct2 = F.when(n2 > 0, round_half_up((F.col("nnz") - F.col("nnz1")) / n2, 3)).otherwise(F.lit(0.0))
    out = t.select(F.col(group), "gene", lfc.alias("avg_log2fc"), pct1.alias("pct_1"), pct2.alias("pct_2"),
                   zstat.alias("z"), p.alias("p_val"))
    out = out.withColumn("p_val_adj", F.least(F.lit(1.0), F.col("p_val") * F.lit(float(n_genes))))
    cond = (F.greatest("pct_1", "pct_2") >= F.lit(min_pct)) & (F.abs("avg_log2fc") >= F.lit(min_logfc))
    if only_pos:
        cond = cond & (F.col("avg_log2fc") > 0)
    if max_p is not None:
        cond = cond & (F.col("p_val") < F.lit(max_p))
    # one row per gene and group; written out so that no filter repeats the p-value's long formula
    return cut_lineage(out).filter(cond)


def significant(markers: DataFrame, min_fc: float | None = None, max_padj: float | None = None,
                min_pct1: float | None = None, max_pct2: float | None = None,
                min_d: float | None = None, max_p: float | None = None) -> DataFrame:
    """Significance predicates on a marker table; d = pct_1 - pct_2, max_p on the raw p."""
    cond = F.lit(True)
    if max_p is not None:
        cond = cond & (F.col("p_val") < max_p)
    if min_fc is not None:
        cond = cond & (F.col("avg_log2fc") > min_fc)
    if max_padj is not None:
        cond = cond & (F.col("p_val_adj") < max_padj)
    if min_pct1 is not None:
        cond = cond & (F.col("pct_1") > min_pct1)
    if max_pct2 is not None:
        cond = cond & (F.col("pct_2") < max_pct2)
    if min_d is not None:
        cond = cond & ((F.col("pct_1") - F.col("pct_2")) > min_d)
    return markers.filter(cond)


def average_expression(expr: DataFrame, labels: DataFrame, group: str = "cluster",
                       genes: DataFrame | None = None) -> DataFrame:
    """Mean of expm1(value) per gene x group over all cells of the group (zeros included)."""
    lab = labels.select(*KEYS, F.col(group))
    sizes = lab.groupBy(group).agg(F.count("*").alias("n"))
    e = expr.join(genes.select("gene"), "gene", "left_semi") if genes is not None else expr
    s = e.join(lab, KEYS).groupBy("gene", group).agg(F.sum(F.expm1("value")).alias("_s"))
    return s.join(sizes, group).select("gene", group, (F.col("_s") / F.col("n")).alias("avg_exp"))


def unlog_expression(expr: DataFrame, digits: int = 6) -> DataFrame:
    """Back-transformed, rounded values."""
    return expr.withColumn("value", F.round(F.expm1("value"), digits))


def attach_avg(markers: DataFrame, avg: DataFrame, group: str = "cluster") -> DataFrame:
    """Average expression at (gene, group) for each marker row."""
    return markers.join(avg.select("gene", group, "avg_exp"), ["gene", group], "left")


def map_gene_name(df: DataFrame, genes: DataFrame, src: str = "gene", key: str = "gene_id",
                  dst: str = "gene_name", out: str | None = None) -> DataFrame:
    """Id <-> name lookup (left join; the gene catalogue is bounded by the genome)."""
    look = genes.select(F.col(key).alias("_k"), F.col(dst).alias(out or dst)).dropDuplicates(["_k"])
    return df.join(look, df[src] == look["_k"], "left").drop("_k")


def dotplot_table(expr: DataFrame, labels: DataFrame, genes: DataFrame, group: str = "cluster",
                  clip: float = 2.5) -> DataFrame:
    """Mean unlogged expression, percent expressing, and z of ln(1 + mean) across groups."""
    lab = labels.select(*KEYS, F.col(group).cast("string").alias(group))
    sizes = group_sizes(lab, group)
    e = expr.join(genes.select("gene"), "gene", "left_semi").join(lab, KEYS)
    s = e.groupBy("gene", group).agg(F.sum(F.expm1("value")).alias("_s"),
                                     F.count(F.when(F.col("value") > 0, 1)).alias("_nnz"))
    grid = _explode_groups(genes.select("gene").distinct(), sizes, group)
    t = grid.join(s, ["gene", group], "left").fillna(0, ["_s", "_nnz"])
    t = t.select("gene", group, (F.col("_s") / F.col("n1")).alias("avg_exp"),
                 (F.lit(100.0) * F.col("_nnz") / F.col("n1")).alias("pct_exp"))
    w = Window.partitionBy("gene")
    lm = F.log1p("avg_exp")
    zs = (lm - F.avg(lm).over(w)) / F.stddev_samp(lm).over(w)
    return t.withColumn("avg_exp_scaled", F.least(F.greatest(F.coalesce(zs, F.lit(0.0)), F.lit(-clip)), F.lit(clip)))


def cluster_correlation(avg: DataFrame, group: str = "cluster") -> DataFrame:
    """Spearman correlation between groups over genes (average-tie ranks, then Pearson).

    ``avg`` is (gene, group, avg_exp) on a selected gene list (e.g. top markers)."""
    w = Window.partitionBy(group).orderBy("avg_exp")
    wt = Window.partitionBy(group, "avg_exp")
    r = avg.withColumn("rk", F.rank().over(w) + (F.count("*").over(wt) - 1) / F.lit(2.0))
    a = r.select("gene", F.col(group).alias("group_a"), F.col("rk").alias("ra"))
    b = r.select("gene", F.col(group).alias("group_b"), F.col("rk").alias("rb"))
    return a.join(b, "gene").groupBy("group_a", "group_b").agg(F.corr("ra", "rb").alias("rho"))
