"""Quality control, gene/cell filters and simple predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["sample", "barcode"]

# Gene-name patterns for mitochondrial and haemoglobin genes
# (matched case-insensitively; the haemoglobin class excludes '(', 'p', ')').
MT_PATTERN = "^MT-"
HB_PATTERN = "^Hb[^(p)]"
MT_PREFIX = "MT-"


def genes_matching(genes: DataFrame, pattern: str, col: str = "gene_name",
                   case_insensitive: bool = True) -> DataFrame:
    """B2: genes whose name matches a regex."""
    pat = f"(?i){pattern}" if case_insensitive else pattern
    return genes.filter(F.col(col).rlike(pat))


def split_genes(expr: DataFrame, prefix: str = MT_PREFIX, gene_col: str = "gene") -> tuple[DataFrame, DataFrame]:
    """Case-sensitive prefix split -> (main without the prefix genes, side with them)."""
    hit = F.col(gene_col).startswith(prefix)
    return expr.filter(~hit), expr.filter(hit)


def qc_counts(expr: DataFrame) -> DataFrame:
    """Per-spot total count and number of detected features."""
    return expr.groupBy(*KEYS).agg(F.sum("value").alias("n_count"),
                                   F.count(F.when(F.col("value") > 0, 1)).alias("n_feature"))


def pct_feature_set(expr: DataFrame, gene_set: DataFrame, name: str, gene_col: str = "gene") -> DataFrame:
    """Percent (0-100) of a spot's counts that fall in ``gene_set`` (column ``gene``)."""
    flagged = gene_set.select(F.col(gene_col).alias("gene")).distinct().withColumn("_in", F.lit(True))
    e = expr.join(flagged, "gene", "left")
    return e.groupBy(*KEYS).agg(
        (F.lit(100.0) * F.sum(F.when(F.col("_in"), F.col("value")).otherwise(F.lit(0.0)))
         / F.sum("value")).alias(name))


def add_qc_metrics(expr: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """D1 + D2: qc counts plus one percent column per non-empty gene set."""
    m = qc_counts(expr)
    for name, gs in sets.items():
        if gs.isEmpty():
            continue
        m = m.join(pct_feature_set(expr, gs, name), KEYS, "left")
    return m


def filter_cells(metrics: DataFrame, low_feature: int | None = None, high_feature: int | None = None,
                 max_mt: float | None = None, max_hb: float | None = None,
                 mt_col: str = "percent_mt", hb_col: str = "percent_hb") -> DataFrame:
    """Keep spots inside the QC bounds; a None bound (or a missing column) is no test.
    Percent bounds are on the 0-100 scale."""
    cond = F.lit(True)
    if low_feature is not None:
        cond = cond & (F.col("n_feature") >= low_feature)
    if high_feature is not None:
        cond = cond & (F.col("n_feature") <= high_feature)
    if max_mt is not None and mt_col in metrics.columns:
        cond = cond & (F.coalesce(F.col(mt_col), F.lit(0.0)) <= max_mt)
    if max_hb is not None and hb_col in metrics.columns:
        cond = cond & (F.coalesce(F.col(hb_col), F.lit(0.0)) <= max_hb)
    return metrics.filter(cond)


def min_features(expr: DataFrame, n: int) -> DataFrame:
    """Restrict ``expr`` to cells with at least ``n`` detected features.

    One pass: a count over the spot's own rows (a spot holds at most one row per gene, so the
    window partition is bounded by the gene catalogue)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*KEYS)
    nf = F.count(F.when(F.col("value") > 0, 1)).over(w)
    return expr.withColumn("_nf", nf).filter(F.col("_nf") >= n).drop("_nf")


def filter_genes(expr: DataFrame, min_cells: int) -> DataFrame:
    """Restrict ``expr`` to genes detected (>0) in at least ``min_cells`` cells."""
    g = expr.filter(F.col("value") > 0).groupBy("gene").count().filter(F.col("count") >= min_cells)
    return expr.join(g.select("gene"), "gene", "left_semi")


def create_object(expr: DataFrame, min_cells: int = 0, min_feat: int = 0) -> DataFrame:
    """B5 then B6 (cell filter first, gene filter on the kept cells)."""
    e = min_features(expr, min_feat) if min_feat else expr
    return filter_genes(e, min_cells) if min_cells else e


def gene_stats(expr: DataFrame) -> DataFrame:
    """Number of expressing cells and non-zero mean per gene."""
    return expr.groupBy("gene").agg(F.count(F.when(F.col("value") > 0, 1)).alias("n_cells"),
                                    F.avg("value").alias("nonzero_mean"))


def filter_nonzero_mean(expr: DataFrame, cutoff: float) -> DataFrame:
    """Keep genes with log10(non-zero mean) > log10(cutoff)."""
    g = gene_stats(expr).filter(F.log10("nonzero_mean") > F.log10(F.lit(float(cutoff))))
    return expr.join(g.select("gene"), "gene", "left_semi")


def positions_to_int(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric coordinates (string or double) -> int, truncating toward zero."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double").cast("int"))
    return df


def drop_empty_spots(composition: DataFrame, value: str = "score") -> DataFrame:
    """Keep spots whose score row-sum is not 0."""
    keep = composition.groupBy(*KEYS).agg(F.sum(value).alias("_s")).filter(F.col("_s") != 0)
    return composition.join(keep.select(*KEYS), KEYS, "left_semi")


def flag_members(all_spots: DataFrame, kept: DataFrame, name: str = "kept") -> DataFrame:
    """0/1 membership flag of each spot in ``kept``."""
    k = kept.select(*KEYS).distinct().withColumn("_m", F.lit(1))
    return all_spots.join(k, KEYS, "left").withColumn(name, F.coalesce("_m", F.lit(0))).drop("_m")


def subset(df: DataFrame, **conds) -> DataFrame:
    """Keep rows whose column value is in the given list."""
    for col, values in conds.items():
        vals = values if isinstance(values, (list, tuple, set)) else [values]
        df = df.filter(F.col(col).isin(list(vals)))
    return df


def parse_groups(spark: SparkSession, spec: str) -> DataFrame:
    """B17: 'T,B:Fibro,epi' -> (group_id, name) rows, group_id 1-based."""
    one = spark.range(1).select(F.lit(spec).alias("spec"))
    g = one.select(F.posexplode(F.split("spec", ":")).alias("pos", "grp"))
    return g.select((F.col("pos") + 1).cast("int").alias("group_id"),
                    F.explode(F.split("grp", ",")).alias("name")).select(
        "group_id", F.trim("name").alias("name"))


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Abort with a message when required columns are absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
