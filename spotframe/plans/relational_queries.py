"""Relational core: QC metrics and filters, joins, per-group tables, ranking, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import normalize as nm
from spotframe.operators import qc
from spotframe.operators import ranking as rk
from spotframe.operators import tables as tb
from spotframe.plans.catalog import finish, register
from spotframe.plans.oracle_views import with_views
from spotframe.sources import adapter

KEYS = ["sample", "barcode"]
# Driver parameters (FIXTURES.md): the MT-like / HB-like name patterns on this data,
# QC thresholds in percent, nonzero-mean cut-off 25.
MT_LIKE = "^red "
HB_LIKE = "^hot b"
MAX_PCT = 15.0
LOW_FEATURE = 20
NZ_MEAN_CUTOFF = 25.0


def _gene_sets(spark, d):
    g = adapter.genes(spark, d)
    mt = qc.genes_matching(g, MT_LIKE).select(F.col("gene_id").alias("gene"))
    hb = qc.genes_matching(g, HB_LIKE).select(F.col("gene_id").alias("gene"))
    return mt, hb


def qc_metrics_df(spark, d):
    e = adapter.expr(spark, d)
    mt, hb = _gene_sets(spark, d)
    return qc.add_qc_metrics(e, {"percent_mt": mt, "percent_hb": hb})


QC_SQL = f"""
mt AS (SELECT gene_id AS gene FROM genes WHERE regexp_matches(gene_name, '{MT_LIKE}', 'i')),
hb AS (SELECT gene_id AS gene FROM genes WHERE regexp_matches(gene_name, '{HB_LIKE}', 'i')),
qcm AS (SELECT e.sample, e.barcode, sum(e.value) AS n_count, count(CASE WHEN e.value > 0 THEN 1 END) AS n_feature,
               100.0 * sum(CASE WHEN mt.gene IS NOT NULL THEN e.value ELSE 0.0 END) / sum(e.value) AS percent_mt,
               100.0 * sum(CASE WHEN hb.gene IS NOT NULL THEN e.value ELSE 0.0 END) / sum(e.value) AS percent_hb
        FROM expr e LEFT JOIN mt USING (gene) LEFT JOIN hb USING (gene) GROUP BY 1, 2)"""
V_QC = ["expr", "genes"]


@register("qc_metrics", with_views(QC_SQL + "\nSELECT sample, barcode, n_count, n_feature, round(percent_mt, 6) AS percent_mt, round(percent_hb, 6) AS percent_hb FROM qcm", V_QC))
def qc_metrics(spark, d):
    """D1 + D2 (+ B2 gene sets): per-spot totals, features, percent in MT-like / HB-like sets."""
    return finish(qc_metrics_df(spark, d))


@register("qc_filter_cells", with_views(QC_SQL + f"""
SELECT sample, barcode, n_count, n_feature FROM qcm
WHERE n_feature >= {LOW_FEATURE} AND percent_mt <= {MAX_PCT} AND percent_hb <= {MAX_PCT}""", V_QC))
def qc_filter_cells(spark, d):
    """QC cell filter (features >= 20, MT-like and HB-like percent <= 15)."""
    m = qc.filter_cells(qc_metrics_df(spark, d), low_feature=LOW_FEATURE, max_mt=MAX_PCT, max_hb=MAX_PCT)
    return finish(m.select("sample", "barcode", "n_count", "n_feature"))


@register("genes_mt_like", with_views(f"""
SELECT gene_id, gene_name FROM genes WHERE regexp_matches(gene_name, '{MT_LIKE}', 'i')""", ["genes"]))
def genes_mt_like(spark, d):
    """B2: genes selected by a case-insensitive name regex."""
    return qc.genes_matching(adapter.genes(spark, d), MT_LIKE).select("gene_id", "gene_name")


@register("split_prefix_side", with_views("""
SELECT gene, count(*) AS n_spots, sum(value) AS total FROM expr_coarse WHERE starts_with(gene, 'red ') GROUP BY gene""",
                                          ["expr_coarse"]))
def split_prefix_side(spark, d):
    """Case-sensitive prefix split, the side part summarised per gene."""
    _, side = qc.split_genes(adapter.expr_coarse(spark, d), "red ")
    return finish(side.groupBy("gene").agg(F.count("*").alias("n_spots"), F.sum("value").alias("total")))


@register("split_prefix_main", with_views("""
SELECT sample, count(*) AS n_entries, count(DISTINCT gene) AS n_genes FROM expr_coarse
WHERE NOT starts_with(gene, 'red ') GROUP BY sample""", ["expr_coarse"]))
def split_prefix_main(spark, d):
    """The main part (prefix genes removed) summarised per sample."""
    main, _ = qc.split_genes(adapter.expr_coarse(spark, d), "red ")
    return main.groupBy("sample").agg(F.count("*").alias("n_entries"), F.countDistinct("gene").alias("n_genes"))


@register("create_object", with_views("""
c AS (SELECT sample, barcode FROM expr WHERE value > 0 GROUP BY 1, 2 HAVING count(*) >= 20),
e1 AS (SELECT * FROM expr SEMI JOIN c USING (sample, barcode)),
g AS (SELECT gene FROM e1 WHERE value > 0 GROUP BY gene HAVING count(*) >= 20)
SELECT sample, count(DISTINCT barcode) AS n_cells, count(DISTINCT gene) AS n_genes, count(*) AS n_entries,
       sum(value) AS total FROM e1 SEMI JOIN g USING (gene) GROUP BY sample""", ["expr"]))
def create_object(spark, d):
    """B5 then B6: cells with >= 20 features, then genes in >= 20 of those cells; per-sample size."""
    e = qc.create_object(adapter.expr(spark, d), min_cells=20, min_feat=20)
    return finish(e.groupBy("sample").agg(F.countDistinct("barcode").alias("n_cells"),
                                          F.countDistinct("gene").alias("n_genes"),
                                          F.count("*").alias("n_entries"), F.sum("value").alias("total")))


@register("gene_stats", with_views("""
SELECT gene, count(CASE WHEN value > 0 THEN 1 END) AS n_cells, round(avg(value), 6) AS nonzero_mean
FROM expr GROUP BY gene""", ["expr"]))
def gene_stats(spark, d):
    """Expressing cells and non-zero mean per gene."""
    return finish(qc.gene_stats(adapter.expr(spark, d)))


@register("filter_nonzero_mean", with_views(f"""
g AS (SELECT gene FROM expr GROUP BY gene HAVING log10(avg(value)) > log10({NZ_MEAN_CUTOFF}))
SELECT gene, count(*) AS n_cells, sum(value) AS total FROM expr SEMI JOIN g USING (gene) GROUP BY gene""", ["expr"]))
def filter_nonzero_mean(spark, d):
    """Genes with log10(non-zero mean) > log10(25)."""
    e = qc.filter_nonzero_mean(adapter.expr(spark, d), NZ_MEAN_CUTOFF)
    return finish(e.groupBy("gene").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total")))


@register("positions_to_int", with_views("""
SELECT sample, barcode, CAST(trunc(x) AS INTEGER) AS x, CAST(trunc(y) AS INTEGER) AS y,
       CAST(trunc(-y) AS INTEGER) AS y_neg FROM spots""", ["spots"]))
def positions_to_int(spark, d):
    """Coordinate cast to int, truncating toward zero (also for negative values)."""
    s = adapter.spots(spark, d).select("sample", "barcode", "x", "y", (-F.col("y")).alias("y_neg"))
    return qc.positions_to_int(s, ["x", "y", "y_neg"])


@register("drop_empty_spots", with_views("""
k AS (SELECT sample, barcode FROM composition WHERE cell_type <> 'PROMO' GROUP BY 1, 2 HAVING sum(score) <> 0)
SELECT sample, count(DISTINCT barcode) AS n_spots, round(sum(score), 6) AS total FROM
  (SELECT * FROM composition WHERE cell_type <> 'PROMO') c SEMI JOIN k USING (sample, barcode) GROUP BY sample""",
                                         ["composition"]))
def drop_empty_spots(spark, d):
    """B13 + B14: drop one class, then spots whose remaining score row-sum is 0."""
    c = adapter.composition(spark, d).filter(F.col("cell_type") != "PROMO")
    k = qc.drop_empty_spots(c)
    return finish(k.groupBy("sample").agg(F.countDistinct("barcode").alias("n_spots"), F.sum("score").alias("total")))


@register("flag_members", with_views(QC_SQL + f""",
kept AS (SELECT sample, barcode FROM qcm WHERE n_feature >= {LOW_FEATURE} AND percent_mt <= {MAX_PCT} AND percent_hb <= {MAX_PCT})
SELECT s.sample, s.barcode, CASE WHEN k.barcode IS NULL THEN 0 ELSE 1 END AS kept
FROM spots s LEFT JOIN kept k ON s.sample = k.sample AND s.barcode = k.barcode""", ["spots", "expr", "genes"]))
def flag_members(spark, d):
    """0/1 flag for every spot: did it pass the QC filter."""
    kept = qc.filter_cells(qc_metrics_df(spark, d), low_feature=LOW_FEATURE, max_mt=MAX_PCT, max_hb=MAX_PCT)
    return qc.flag_members(adapter.spots(spark, d).select(*KEYS), kept, "kept")


@register("subset_cluster_condition", with_views("""
SELECT c.sample, c.cell_type, count(*) AS n_spots, round(avg(c.score), 6) AS mean_score
FROM composition c JOIN spots s USING (sample, barcode)
WHERE s.cluster IN ('BUILDING', 'MACHINERY') AND s.condition IN ('C') GROUP BY 1, 2""", ["composition", "spots"]))
def subset_cluster_condition(spark, d):
    """Subset to clusters of interest and a condition list."""
    s = qc.subset(adapter.spots(spark, d), cluster=["BUILDING", "MACHINERY"], condition=["C"])
    c = adapter.composition(spark, d).join(s.select(*KEYS), KEYS, "left_semi")
    return finish(c.groupBy("sample", "cell_type").agg(F.count("*").alias("n_spots"), F.avg("score").alias("mean_score")))


GROUP_SPEC = "ECONOMY,PROMO:STANDARD,SMALL,LARGE"


@register("group_scores", with_views("""
g AS (SELECT * FROM (VALUES (1, 'ECONOMY'), (1, 'PROMO'), (2, 'STANDARD'), (2, 'SMALL'), (2, 'LARGE')) t(group_id, name))
SELECT c.sample, c.barcode, CAST(g.group_id AS INTEGER) AS group_id, round(sum(c.score), 6) AS score
FROM composition c JOIN g ON c.cell_type = g.name GROUP BY 1, 2, 3""", ["composition"]))
def group_scores(spark, d):
    """Parse 'a,b:c,d,e' into groups and sum each spot's scores per group."""
    g = qc.parse_groups(spark, GROUP_SPEC)
    c = adapter.composition(spark, d).join(F.broadcast(g), F.col("cell_type") == F.col("name"))
    return finish(c.groupBy("sample", "barcode", "group_id").agg(F.sum("score").alias("score")))


@register("align_labels", with_views("""
a AS (SELECT sample, barcode, cluster FROM spots WHERE CAST(barcode AS BIGINT) % 2 = 1)
SELECT a.cluster, count(*) AS n_entries, count(DISTINCT e.gene) AS n_genes, sum(e.value) AS total
FROM expr e JOIN a USING (sample, barcode) GROUP BY a.cluster""", ["spots", "expr"]))
def align_labels(spark, d):
    """Restrict the matrix to annotated (reference) barcodes and attach their labels."""
    anno = adapter.spots(spark, d).filter(F.col("barcode").cast("long") % 2 == 1).select(*KEYS, "cluster")
    e = tb.attach_labels(tb.align(adapter.expr(spark, d), anno), anno, ["cluster"])
    return finish(e.groupBy("cluster").agg(F.count("*").alias("n_entries"), F.countDistinct("gene").alias("n_genes"),
                                           F.sum("value").alias("total")))


CELL_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("attach_scores", with_views("""
w AS (SELECT sample, barcode, """ + ", ".join(
    f"max(CASE WHEN cell_type = '{t}' THEN score END) AS \"{t}\"" for t in CELL_TYPES) + """
      FROM composition GROUP BY 1, 2)
SELECT s.sample, s.barcode, s.cluster, """ + ", ".join(f"round(w.\"{t}\", 6) AS \"{t}\"" for t in CELL_TYPES) + """
FROM spots s LEFT JOIN w USING (sample, barcode)""", ["spots", "composition"]))
def attach_scores(spark, d):
    """C2 (+ long -> wide at the sink): per-spot class scores left-joined onto metadata."""
    wide = tb.to_wide(adapter.composition(spark, d))
    return finish(tb.attach_scores(adapter.spots(spark, d).select(*KEYS, "cluster"), wide))


def _scale_factors(spark, d):
    # one scale factor per slide: derived from the sample number (S<k> -> 0.05 * (k + 1))
    s = adapter.spots(spark, d).select("sample").distinct()
    return s.select("sample", (F.lit(0.05) * (F.substring("sample", 2, 8).cast("int") + 1)).alias("tissue_lowres_scalef"))


@register("spot_coordinates", with_views("""
sf AS (SELECT DISTINCT sample, 0.05::DOUBLE * (CAST(substr(sample, 2, 8) AS INTEGER) + 1) AS f FROM spots)
SELECT s.sample, s.barcode, s.in_tissue, s.array_row, s.array_col, s.cluster, s.condition,
       round(s.x * sf.f, 6) AS x_img, round(s.y * sf.f, 6) AS y_img
FROM spots s JOIN sf USING (sample)""", ["spots"]))
def spot_coordinates(spark, d):
    """C4: coordinates times the per-slide low-resolution scale factor."""
    return finish(tb.spot_coordinates(adapter.spots(spark, d), _scale_factors(spark, d)))


@register("qc_join_one_to_one", with_views(QC_SQL + """
SELECT s.sample, s.barcode, s.cluster, q.n_count, q.n_feature FROM spots s JOIN qcm q USING (sample, barcode)""",
                                           ["spots", "expr", "genes"]))
def qc_join_one_to_one(spark, d):
    """Keyed 1:1 join (with duplicate-key check) of QC metrics onto spot metadata."""
    q = qc.qc_counts(adapter.expr(spark, d))
    return finish(tb.join_one_to_one(adapter.spots(spark, d).select(*KEYS, "cluster"), q))


FEATURES = ["cold bolt", "hot ring", "red plate"]


@register("feature_map", with_views("""
f AS (SELECT * FROM (VALUES ('cold bolt'), ('hot ring'), ('red plate')) t(feature))
SELECT s.sample, s.barcode, round(s.x, 6) AS x, round(s.y, 6) AS y, f.feature,
       round(least(greatest(coalesce(e.value, 0.0), 0.0), 40.0), 6) AS value
FROM spots s CROSS JOIN f LEFT JOIN expr_coarse e ON e.sample = s.sample AND e.barcode = s.barcode AND e.gene = f.feature""",
                                    ["spots", "expr_coarse"]))
def feature_map(spark, d):
    """Three genes at every spot coordinate, missing = 0, clipped to [0, 40]."""
    return finish(tb.feature_map(adapter.expr_coarse(spark, d), adapter.spots(spark, d), FEATURES, lo=0.0, hi=40.0))


@register("crosstab_cluster_sample", with_views("""
a AS (SELECT DISTINCT cluster FROM spots), b AS (SELECT DISTINCT sample FROM spots),
c AS (SELECT cluster, sample, count(*) AS freq FROM spots GROUP BY 1, 2),
t AS (SELECT a.cluster, b.sample, coalesce(c.freq, 0) AS freq FROM a CROSS JOIN b LEFT JOIN c USING (cluster, sample))
SELECT cluster, sample, freq, round(freq / sum(freq) OVER (PARTITION BY sample), 6) AS share_in_sample,
       round(freq / sum(freq) OVER (PARTITION BY cluster), 6) AS share_in_cluster FROM t""", ["spots"]))
def crosstab_cluster_sample(spark, d):
    """D3: cluster x sample frequencies with zero cells, shares within sample and within cluster."""
    return finish(tb.crosstab_share(adapter.spots(spark, d), "cluster", "sample"))


@register("freq_cluster", with_views("SELECT cluster, count(*) AS freq FROM spots GROUP BY cluster", ["spots"]))
def freq_cluster(spark, d):
    """One-way frequency table."""
    return tb.freq(adapter.spots(spark, d), "cluster")


@register("median_depth", with_views("""
SELECT sample, median(n) AS median_depth, count(*) AS n_spots FROM
  (SELECT sample, barcode, sum(value) AS n FROM expr GROUP BY 1, 2) GROUP BY sample""", ["expr"]))
def median_depth(spark, d):
    """Exact median of spot totals (per sample)."""
    from spotframe.functions.ranks import exact_percentile
    q = qc.qc_counts(adapter.expr(spark, d))
    med = exact_percentile(q, "n_count", 0.5, ["sample"], out="median_depth")
    return finish(med.join(q.groupBy("sample").agg(F.count("*").alias("n_spots")), "sample"))


@register("max_scale", with_views("""
SELECT sample, barcode, cell_type, round(score / max(score) OVER (PARTITION BY cell_type), 6) AS score FROM composition""",
                                  ["composition"]))
def max_scale(spark, d):
    """Each class scaled to its maximum."""
    return finish(tb.max_scale(adapter.composition(spark, d)))


@register("top_label", with_views("""
SELECT sample, barcode, cell_type AS top_label, round(score, 6) AS top_score FROM (
  SELECT *, row_number() OVER (PARTITION BY sample, barcode ORDER BY score DESC, cell_type) AS rn FROM composition)
WHERE rn = 1""", ["composition"]))
def top_label(spark, d):
    """Per-spot best class (ties -> first class in name order) and its score."""
    return finish(tb.top_label(adapter.composition(spark, d)))


@register("clip_quantile", with_views("""
q AS (SELECT cell_type, quantile_cont(score, 0.992) AS q FROM composition GROUP BY cell_type)
SELECT c.sample, c.barcode, c.cell_type, round(least(c.score, q.q), 6) AS score FROM composition c JOIN q USING (cell_type)""",
                                      ["composition"]))
def clip_quantile(spark, d):
    """Clip each class at its exact 0.992 quantile."""
    return finish(tb.clip_quantile(adapter.composition(spark, d), "score", 0.992, ["cell_type"]))


@register("n_batches", with_views("SELECT count(DISTINCT sample) AS n_batches FROM spots", ["spots"]))
def n_batches(spark, d):
    """Number of distinct batches."""
    return adapter.spots(spark, d).agg(F.countDistinct("sample").alias("n_batches"))


_QC_SUMMARY_SQL = """
q AS (SELECT sample, barcode, sum(value) AS n_count, count(*)::DOUBLE AS n_feature FROM expr GROUP BY 1, 2),
m AS (SELECT sample, 'n_count' AS metric, n_count AS v FROM q UNION ALL SELECT sample, 'n_feature', n_feature FROM q)
""" + "\nUNION ALL\n".join(
    f"SELECT sample, metric, {p}::DOUBLE AS prob, round(quantile_cont(v, {p}), 6) AS value FROM m GROUP BY sample, metric"
    for p in ("0.0", "0.25", "0.5", "0.75", "1.0"))


@register("qc_summary", with_views(_QC_SUMMARY_SQL, ["expr"]))
def qc_summary(spark, d):
    """Exact quantiles of QC metrics per sample (violin-plot data)."""
    return finish(tb.qc_summary(qc.qc_counts(adapter.expr(spark, d)), ["n_count", "n_feature"]))


@register("qc_scatter_r", with_views("""
SELECT sample, round(corr(n_count, n_feature), 6) AS r FROM
  (SELECT sample, barcode, sum(value) AS n_count, count(*)::DOUBLE AS n_feature FROM expr GROUP BY 1, 2) GROUP BY sample""",
                                     ["expr"]))
def qc_scatter_r(spark, d):
    """Pearson r between total counts and features, per sample."""
    return finish(tb.qc_scatter_r(qc.qc_counts(adapter.expr(spark, d)), "n_count", "n_feature"))


@register("make_unique_names", with_views("""
u AS (SELECT gene_id, gene_name, idx, CASE WHEN rn = 0 THEN gene_name ELSE gene_name || '-' || CAST(rn AS VARCHAR) END AS unique_name
      FROM (SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY idx) - 1 AS rn FROM genes))
SELECT gene_id, gene_name, unique_name FROM u""", ["genes"]))
def make_unique_names(spark, d):
    """E5: duplicated gene names made unique in file order."""
    return rk.make_unique(adapter.genes(spark, d)).select("gene_id", "gene_name", "unique_name")


@register("avg_rank_depth", with_views("""
SELECT sample, barcode, rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2.0::DOUBLE AS depth_rank
FROM (SELECT sample, barcode, sum(value) AS n FROM expr GROUP BY 1, 2)""", ["expr"]))
def avg_rank_depth(spark, d):
    """Average-tie rank of spot depth within sample."""
    q = qc.qc_counts(adapter.expr(spark, d))
    return rk.avg_rank(q, ["sample"], "n_count", out="depth_rank").select("sample", "barcode", "depth_rank")


@register("union_samples", with_views("""
SELECT sample, count(*) AS n_entries, sum(value) AS total, count(DISTINCT gene) AS n_genes FROM (
  SELECT sample, barcode, gene, value FROM expr WHERE sample < 'S3'
  UNION ALL SELECT sample, barcode, gene, value FROM expr WHERE NOT (sample < 'S3')) GROUP BY sample""",
                                      ["expr"]))
def union_samples(spark, d):
    """bag union of per-sample tables by column name."""
    e = adapter.expr(spark, d)
    early = F.col("sample") < "S3"
    parts = [e.filter(early), e.filter(~early).select("value", "gene", "barcode", "sample")]
    u = tb.union_all(parts)
    return finish(u.groupBy("sample").agg(F.count("*").alias("n_entries"), F.sum("value").alias("total"),
                                          F.countDistinct("gene").alias("n_genes")))


@register("intersect_genes", with_views("""
SELECT gene FROM expr WHERE CAST(barcode AS BIGINT) % 2 = 0 INTERSECT SELECT gene FROM expr WHERE CAST(barcode AS BIGINT) % 2 = 1""", ["expr"]))
def intersect_genes(spark, d):
    """genes measured both in query cells (even keys) and in reference cells (odd keys)."""
    e = adapter.expr(spark, d)
    odd = F.col("barcode").cast("long") % 2 == 1
    return e.filter(~odd).select("gene").intersect(e.filter(odd).select("gene"))


@register("intersect_barcodes", with_views("""
SELECT sample, barcode FROM spots WHERE cluster <> 'HOUSEHOLD' INTERSECT SELECT sample, barcode FROM expr""",
                                           ["spots", "expr"]))
def intersect_barcodes(spark, d):
    """annotated barcodes that also have metadata / counts."""
    s = adapter.spots(spark, d).filter(F.col("cluster") != "HOUSEHOLD").select(*KEYS)
    return s.intersect(adapter.expr(spark, d).select(*KEYS))


@register("except_classes", with_views("""
SELECT DISTINCT cell_type FROM composition EXCEPT SELECT * FROM (VALUES ('PROMO'), ('max')) t(cell_type)""",
                                       ["composition"]))
def except_classes(spark, d):
    """class names except excluded names ('PROMO', 'max')."""
    c = adapter.composition(spark, d).select("cell_type").distinct()
    return c.join(F.broadcast(spark.createDataFrame([("PROMO",), ("max",)], "cell_type string")), "cell_type", "left_anti")


@register("union_hvgs", with_views("""
v AS (SELECT sample, gene, var_samp(value) AS v FROM expr GROUP BY 1, 2),
r AS (SELECT sample, gene, row_number() OVER (PARTITION BY sample ORDER BY v DESC NULLS LAST, gene) AS rn FROM v)
SELECT DISTINCT gene FROM r WHERE rn <= 50""", ["expr"]))
def union_hvgs(spark, d):
    """Union over samples of each sample's top-50 variable genes (non-zero variance), de-duplicated."""
    from pyspark.sql import Window
    e = adapter.expr(spark, d)
    v = e.groupBy("sample", "gene").agg(F.var_samp("value").alias("v"))
    w = Window.partitionBy("sample").orderBy(F.desc_nulls_last("v"), "gene")
    top = v.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 50)
    return top.select("gene").distinct()


@register("unlog_expression", with_views("""
d AS (SELECT sample, barcode, sum(value) AS depth FROM expr GROUP BY 1, 2),
n AS (SELECT e.sample, e.barcode, e.gene, ln(1 + e.value / d.depth * 10000.0) AS value FROM expr e JOIN d USING (sample, barcode))
SELECT sample, barcode, gene, round(exp(value) - 1, 4) AS value FROM n""", ["expr"]))
def unlog_expression(spark, d):
    """G1 (scale 1e4) -> D6: back-transformed normalised values, rounded."""
    from spotframe.operators.markers import unlog_expression as ul
    n = nm.log_normalize(adapter.expr(spark, d), scale=10000.0)
    return ul(n, 4)


THETA = 100.0
PEARSON_SQL = f"""
dep AS (SELECT sample, barcode, sum(value) AS depth FROM expr GROUP BY 1, 2),
tot AS (SELECT sum(depth) AS t, count(*)::DOUBLE AS n FROM dep),
gt AS (SELECT gene, sum(value) AS total FROM expr GROUP BY 1),
cells AS (SELECT d.sample, d.barcode, g.gene, g.total, g.total * d.depth / tot.t AS mu, sqrt(tot.n) AS clip
          FROM dep d CROSS JOIN gt g CROSS JOIN tot),
res AS (SELECT c.sample, c.barcode, c.gene, c.total, e.value,
               least(greatest((coalesce(e.value, 0.0) - c.mu) / sqrt(c.mu + c.mu * c.mu / {THETA}), -c.clip), c.clip) AS r
        FROM cells c LEFT JOIN expr e ON e.sample = c.sample AND e.barcode = c.barcode AND e.gene = c.gene)"""


def _pearson(spark, d):
    e = adapter.expr(spark, d)
    depth = e.groupBy(*KEYS).agg(F.sum("value").alias("depth"))
    return nm.pearson_residuals(e, depth, THETA)


@register("pearson_residuals", with_views(PEARSON_SQL + """
SELECT sample, barcode, gene, round(r, 6) AS residual FROM res WHERE value IS NOT NULL""", ["expr"]))
def pearson_residuals(spark, d):
    """Analytic Pearson residual of every entry that exists."""
    nz, _ = _pearson(spark, d)
    return finish(nz.withColumnRenamed("value", "residual"))


@register("pearson_variance", with_views(PEARSON_SQL + """
SELECT gene, round(max(total), 6) AS total, round(avg(r), 6) AS mean, round(var_samp(r), 6) AS var FROM res GROUP BY gene""", ["expr"]))
def pearson_variance(spark, d):
    """Mean and variance of every gene's residuals over all cells, zeros in closed form."""
    _, stats = _pearson(spark, d)
    return finish(stats)
