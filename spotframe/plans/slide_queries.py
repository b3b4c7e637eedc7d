"""Normalisation / variable genes, per-cluster marker tables, spot adjacency and neighbourhood views."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from spotframe.operators import markers as mk
from spotframe.operators import normalize as nm
from spotframe.operators import slide as sp
from spotframe.operators.ranking import top_n_ties
from spotframe.operators.tables import first_distinct
from spotframe.plans.catalog import finish, register
from spotframe.plans.marker_queries import MARKERS_SQL, all_markers, prepared
from spotframe.plans.oracle_views import with_views
from spotframe.session import stage
from spotframe.sources import adapter

KEYS = ["sample", "barcode"]
N_HVG = 100
PAIR_RADIUS = 250.0
PARA_L = 100.0

_NORM_CTE = """
dep AS (SELECT sample, barcode, sum(value) AS depth FROM expr GROUP BY 1, 2),
med AS (SELECT median(depth) AS s FROM dep),
norm AS (SELECT e.sample, e.barcode, e.gene, ln(1 + e.value / dep.depth * med.s) AS value
         FROM expr e JOIN dep USING (sample, barcode) CROSS JOIN med)"""


@register("normalize_log", with_views(_NORM_CTE + """
SELECT sample, barcode, gene, round(value, 6) AS value FROM norm""", ["expr"]))
def normalize_log(spark, d):
    """G1 (+ D8): ln(1 + v / depth * median depth)."""
    return finish(nm.log_normalize(adapter.expr(spark, d)))


@register("normalize_total", with_views("""
dep AS (SELECT sample, barcode, sum(value) AS depth FROM expr GROUP BY 1, 2)
SELECT e.sample, e.barcode, e.gene, round(e.value / dep.depth * 10000.0, 6) AS value FROM expr e JOIN dep USING (sample, barcode)""",
                                        ["expr"]))
def normalize_total(spark, d):
    """Total normalisation to 1e4 (no log)."""
    return finish(nm.normalize_total(adapter.expr(spark, d), 10000.0))


@register("log1p_layer", with_views("""
dep AS (SELECT sample, barcode, sum(value) AS depth FROM expr_coarse GROUP BY 1, 2),
med AS (SELECT median(depth) AS s FROM dep)
SELECT e.sample, e.barcode, e.gene, round(ln(1 + e.value / dep.depth * med.s), 6) AS value
FROM expr_coarse e JOIN dep USING (sample, barcode) CROSS JOIN med""", ["expr_coarse"]))
def log1p_layer(spark, d):
    """G2 (median target) then G3 log1p, on the coarse layer."""
    return finish(nm.log1p_layer(nm.normalize_total(adapter.expr_coarse(spark, d))))


def _det3_sql(m):
    return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
            f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
            f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")


def _cramer_sql():
    a = [[f"x{i + j}" for j in range(3)] for i in range(3)]
    b = [f"y{i}" for i in range(3)]
    d = _det3_sql(a)
    out = []
    for k in range(3):
        m = [[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]
        out.append(f"{_det3_sql(m)} / {d} AS c{k}")
    return ", ".join(out)


VST_SQL = f"""
nc AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr) t),
mom0 AS (SELECT gene, count(*) AS nnz, sum(value) AS s1, sum(value * value) AS s2 FROM expr GROUP BY gene),
mom AS (SELECT gene, nnz, s1 / nc.n AS mean,
               greatest((s2 - nc.n * (s1 / nc.n) * (s1 / nc.n)) / (nc.n - 1.0), 0.0) AS var FROM mom0 CROSS JOIN nc),
fit AS (SELECT log10(mean) AS x, log10(var) AS y FROM mom WHERE var > 0),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS x0, sum(x) AS x1, sum(x * x) AS x2, sum(x * x * x) AS x3,
                sum(x * x * x * x) AS x4, sum(y) AS y0, sum(y * x) AS y1, sum(y * x * x) AS y2 FROM fit),
coef AS (SELECT {_cramer_sql()} FROM sums),
m2 AS (SELECT mom.*, sqrt(pow(10.0, c0 + c1 * log10(mean) + c2 * log10(mean) * log10(mean))) AS sd_hat
       FROM mom CROSS JOIN coef),
nz AS (SELECT e.gene, sum(pow(least((e.value - m2.mean) / m2.sd_hat, sqrt(nc.n)), 2)) AS sz2
       FROM expr e JOIN m2 USING (gene) CROSS JOIN nc GROUP BY e.gene),
vs AS (SELECT m2.gene, m2.mean, m2.var,
              (nz.sz2 + (nc.n - m2.nnz) * pow(m2.mean / m2.sd_hat, 2)) / (nc.n - 1.0) AS variance_standardized
       FROM m2 JOIN nz USING (gene) CROSS JOIN nc)"""


@register("hvg_vst", with_views(VST_SQL + f"""
SELECT gene, round(mean, 6) AS mean, round(var, 6) AS var, round(variance_standardized, 6) AS variance_standardized,
       CAST(row_number() OVER (ORDER BY variance_standardized DESC, gene) AS INTEGER) AS rank
FROM vs ORDER BY variance_standardized DESC, gene LIMIT {N_HVG}""", ["expr"]))
def hvg_vst(spark, d):
    """Top-100 genes by standardised variance after the quadratic mean-variance trend."""
    e = adapter.expr(spark, d)
    n = e.select(*KEYS).distinct().count()
    return finish(nm.hvg_vst(e, n, N_HVG))


N_FEATURES = 3000

VST_BY_SQL = f"""
nc AS (SELECT sample, count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr) t GROUP BY 1),
mom0 AS (SELECT sample, gene, count(*) AS nnz, sum(value) AS s1, sum(value * value) AS s2 FROM expr GROUP BY 1, 2),
mom AS (SELECT sample, gene, nnz, n, s1 / n AS mean, greatest((s2 - n * (s1 / n) * (s1 / n)) / (n - 1.0), 0.0) AS var
        FROM mom0 JOIN nc USING (sample) WHERE n > 1 AND s1 > 0),
fit AS (SELECT sample, log10(mean) AS x, log10(var) AS y FROM mom WHERE var > 0),
sums AS (SELECT sample, CAST(count(*) AS DOUBLE) AS x0, sum(x) AS x1, sum(x * x) AS x2, sum(x * x * x) AS x3,
                sum(x * x * x * x) AS x4, sum(y) AS y0, sum(y * x) AS y1, sum(y * x * x) AS y2 FROM fit GROUP BY 1),
coef AS (SELECT sample, {_cramer_sql()} FROM sums),
m2 AS (SELECT mom.*, sqrt(pow(10.0, c0 + c1 * log10(mean) + c2 * log10(mean) * log10(mean))) AS sd_hat
       FROM mom JOIN coef USING (sample)),
nz AS (SELECT e.sample, e.gene, sum(pow(least((e.value - m2.mean) / m2.sd_hat, sqrt(m2.n)), 2)) AS sz2
       FROM expr e JOIN m2 USING (sample, gene) GROUP BY 1, 2),
vs AS (SELECT m2.sample, m2.gene, round((nz.sz2 + (m2.n - m2.nnz) * pow(m2.mean / m2.sd_hat, 2)) / (m2.n - 1.0), 6) AS v
       FROM m2 JOIN nz USING (sample, gene)),
rk AS (SELECT sample, gene, v, row_number() OVER (PARTITION BY sample ORDER BY v DESC NULLS LAST, gene) AS r FROM vs),
chosen AS (SELECT * FROM rk WHERE r <= {N_FEATURES})"""


@register("hvg_vst_by_sample", with_views(VST_BY_SQL + """
SELECT sample, gene, v AS variance_standardized, CAST(r AS INTEGER) AS rank FROM chosen""", ["expr"]))
def hvg_vst_by_sample(spark, d):
    """G5 per sample: the 3000 genes of the largest standardised variance, each sample with its own trend."""
    return finish(nm.hvg_vst_by(adapter.expr(spark, d), "sample", N_FEATURES))


@register("integration_features", with_views(VST_BY_SQL + f""",
g AS (SELECT gene, count(*) AS n_samples, median(r) AS median_rank FROM chosen GROUP BY 1),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY n_samples DESC, median_rank, gene) AS INTEGER) AS rank FROM g)
SELECT gene, n_samples, round(CAST(median_rank AS DOUBLE), 6) AS median_rank, rank FROM o WHERE rank <= {N_FEATURES}""", ["expr"]))
def integration_features(spark, d):
    """G5 per sample -> E6: 3000 genes by the number of samples that chose them and their median rank."""
    return finish(nm.integration_features(nm.hvg_vst_by(adapter.expr(spark, d), "sample", N_FEATURES), N_FEATURES))


THETA_SQL = f"""
dep AS (SELECT sample, barcode, sum(value) AS depth FROM expr GROUP BY 1, 2),
tot AS (SELECT sum(depth)::DOUBLE AS t, count(*)::DOUBLE AS n, sum(depth * depth)::DOUBLE AS t2 FROM dep),
gs AS (SELECT e.gene, sum(e.value) AS total, sum(e.value * e.value) AS xx, sum(e.value * d.depth) AS xd
       FROM expr e JOIN dep d USING (sample, barcode) GROUP BY 1 HAVING sum(e.value) > 0),
ge AS (SELECT gs.*, log10(total / n) AS x, total / t * (total / t) * t2 AS mu2,
              xx - 2.0 * (total / t) * xd + (total / t) * (total / t) * t2 - total AS excess FROM gs CROSS JOIN tot),
gp AS (SELECT *, log10(mu2 / excess) AS y FROM ge WHERE excess > 0),
sums AS (SELECT CAST(count(*) AS DOUBLE) AS x0, sum(x) AS x1, sum(x * x) AS x2, sum(x * x * x) AS x3,
                sum(x * x * x * x) AS x4, sum(y) AS y0, sum(y * x) AS y1, sum(y * x * x) AS y2 FROM gp),
coef AS (SELECT {_cramer_sql()} FROM sums),
th AS (SELECT gene, total, coalesce(least(greatest(pow(10.0, c0 + c1 * x + c2 * x * x), {nm.THETA_RANGE[0]}), {nm.THETA_RANGE[1]}),
                                    {nm.THETA_RANGE[1]}) AS theta FROM ge CROSS JOIN coef),
cells AS (SELECT d.sample, d.barcode, th.gene, th.theta, th.total * d.depth / tot.t AS mu, sqrt(tot.n) AS clip
          FROM dep d CROSS JOIN th CROSS JOIN tot),
res AS (SELECT c.gene, c.theta, least(greatest((coalesce(e.value, 0.0) - c.mu) / sqrt(c.mu + c.mu * c.mu / c.theta),
                                               -c.clip), c.clip) AS r
        FROM cells c LEFT JOIN expr e ON e.sample = c.sample AND e.barcode = c.barcode AND e.gene = c.gene),
pv AS (SELECT gene, max(theta) AS theta, avg(r) AS mean, round(var_samp(r), 6) AS var FROM res GROUP BY gene),
pr AS (SELECT *, CAST(row_number() OVER (ORDER BY var DESC, gene) AS INTEGER) AS rank FROM pv)"""


@register("pearson_hvgs", with_views(THETA_SQL + f"""
SELECT gene, round(theta, 6) AS theta, round(mean, 6) AS mean, var, rank FROM pr WHERE rank <= {N_FEATURES}""", ["expr"]))
def pearson_hvgs(spark, d):
    """The 3000 genes of the largest residual variance, overdispersion fitted per gene and smoothed along the mean."""
    e = stage(adapter.expr(spark, d))
    return finish(nm.pearson_hvgs(e, stage(nm.depth(e)), N_FEATURES))


DISP_SQL = _NORM_CTE + """,
nc AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr) t),
mom0 AS (SELECT gene, sum(exp(value) - 1) AS s1, sum((exp(value) - 1) * (exp(value) - 1)) AS s2 FROM norm GROUP BY gene),
mom AS (SELECT gene, s1 / nc.n AS mean,
               greatest((s2 - nc.n * (s1 / nc.n) * (s1 / nc.n)) / (nc.n - 1.0), 0.0) AS var FROM mom0 CROSS JOIN nc),
g AS (SELECT gene, ln(1 + mean) AS mean_log, ln(var / mean) AS dispersion FROM mom WHERE mean > 0),
rng AS (SELECT min(mean_log) AS lo, max(mean_log) AS hi FROM g),
gb AS (SELECT g.*, CAST(least(floor((mean_log - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin FROM g CROSS JOIN rng),
gz AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY bin) = 1 THEN 1.0
                      ELSE (dispersion - avg(dispersion) OVER (PARTITION BY bin)) / stddev_samp(dispersion) OVER (PARTITION BY bin)
                 END AS dispersion_norm FROM gb)"""


@register("hvg_dispersion", with_views(DISP_SQL + """
SELECT gene, round(mean_log, 6) AS mean_log, round(dispersion, 6) AS dispersion, bin,
       round(dispersion_norm, 6) AS dispersion_norm
FROM gz WHERE mean_log > 0.0125 AND mean_log < 3.0 AND dispersion_norm >= 0.5""", ["expr"]))
def hvg_dispersion(spark, d):
    """Mean / normalised-dispersion variable genes (20 bins, mean' in (0.0125, 3), z >= 0.5)."""
    e = adapter.expr(spark, d)
    n = e.select(*KEYS).distinct().count()
    g = nm.hvg_dispersion(nm.log_normalize(e), n, 0.0125, 3.0, 0.5, 20)
    return finish(g.select("gene", "mean_log", "dispersion", "bin", "dispersion_norm"))


@register("scale_genes", with_views(_NORM_CTE + """,
nc AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr) t),
mom0 AS (SELECT gene, sum(value) AS s1, sum(value * value) AS s2 FROM norm GROUP BY gene),
mom AS (SELECT gene, s1 / nc.n AS mean,
               sqrt(greatest((s2 - nc.n * (s1 / nc.n) * (s1 / nc.n)) / (nc.n - 1.0), 0.0)) AS sd FROM mom0 CROSS JOIN nc),
z AS (SELECT n.sample, n.barcode, n.gene,
             CASE WHEN m.sd > 0 THEN least(greatest((n.value - m.mean) / m.sd, -10.0), 10.0) ELSE 0.0 END AS z,
             CASE WHEN m.sd > 0 THEN least(greatest((0.0 - m.mean) / m.sd, -10.0), 10.0) ELSE 0.0 END AS zero_z
      FROM norm n JOIN mom m USING (gene))
SELECT sample, barcode, gene, round(z, 6) AS z, round(zero_z, 6) AS zero_z FROM z""", ["expr"]))
def scale_genes(spark, d):
    """Per-gene z-scores clipped at 10; non-zero entries plus the z of absent entries."""
    e = adapter.expr(spark, d)
    n = e.select(*KEYS).distinct().count()
    nz, g = nm.scale_genes(nm.log_normalize(e), n)
    return finish(nz.withColumnRenamed("value", "z").join(g.select("gene", "zero_z"), "gene")
                  .select(*KEYS, "gene", "z", "zero_z"))


# ---- per-cluster tables built on the marker test -------------------------------------------

_TOP10 = """,
top10 AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY round(avg_log2fc, 9) DESC) AS rk FROM mk2)
          WHERE rk <= 10),
csize AS (SELECT cluster, count(*)::DOUBLE AS n FROM lab GROUP BY cluster),
avgx AS (SELECT n.gene, l.cluster, sum(exp(n.value) - 1) / max(c.n) AS avg_exp
         FROM norm n JOIN lab l USING (sample, barcode) JOIN csize c ON c.cluster = l.cluster GROUP BY 1, 2)"""
V_MK = ["spots", "expr"]


@register("average_expression", with_views(MARKERS_SQL + _TOP10 + """
SELECT gene, cluster, round(avg_exp, 6) AS avg_exp FROM avgx""", V_MK))
def average_expression(spark, d):
    """Mean unlogged expression per gene x cluster over all cells of the cluster."""
    norm, labels = prepared(spark, d)
    return finish(mk.average_expression(norm, labels, "cluster"))


@register("markers_named", with_views(MARKERS_SQL + _TOP10 + """
SELECT t.cluster, t.gene, g.gene_name, round(t.avg_log2fc, 6) AS avg_log2fc FROM top10 t
LEFT JOIN genes g ON g.gene_id = t.gene""", V_MK + ["genes"]))
def markers_named(spark, d):
    """E1 -> C6: top-10 markers with gene names looked up from the gene table."""
    t = top_n_ties(all_markers(spark, d), "cluster", "avg_log2fc", 10)
    t = mk.map_gene_name(t, adapter.genes(spark, d), "gene", "gene_id", "gene_name")
    return finish(t.select("cluster", "gene", "gene_name", "avg_log2fc"))


@register("markers_with_avg", with_views(MARKERS_SQL + _TOP10 + """
SELECT m.cluster, m.gene, round(m.avg_log2fc, 6) AS avg_log2fc, round(a.avg_exp, 6) AS avg_exp
FROM mk2 m LEFT JOIN avgx a ON a.gene = m.gene AND a.cluster = m.cluster
WHERE m.avg_log2fc > 0.05 AND m.pct_1 > 0.02""", V_MK))
def markers_with_avg(spark, d):
    """B12 -> C7: significant markers with the average expression at their (gene, cluster)."""
    norm, labels = prepared(spark, d)
    m = mk.significant(mk.find_markers(norm, labels, "cluster"), min_fc=0.05, min_pct1=0.02)
    avg = mk.average_expression(norm, labels, "cluster")
    return finish(mk.attach_avg(m, avg).select("cluster", "gene", "avg_log2fc", "avg_exp"))


@register("cluster_correlation", with_views(MARKERS_SQL + _TOP10 + """,
sel AS (SELECT a.* FROM avgx a WHERE a.gene IN (SELECT gene FROM top10)),
rk AS (SELECT gene, cluster, rank() OVER (PARTITION BY cluster ORDER BY avg_exp)
                            + (count(*) OVER (PARTITION BY cluster, avg_exp) - 1) / 2.0::DOUBLE AS r FROM sel)
SELECT a.cluster AS group_a, b.cluster AS group_b, round(corr(a.r, b.r), 6) AS rho
FROM rk a JOIN rk b USING (gene) GROUP BY 1, 2""", V_MK))
def cluster_correlation(spark, d):
    """Spearman correlation between clusters over the top-10 marker genes' average expression."""
    norm, labels = prepared(spark, d)
    top = top_n_ties(mk.find_markers(norm, labels, "cluster"), "cluster", "avg_log2fc", 10).select("gene").distinct()
    avg = mk.average_expression(norm, labels, "cluster", genes=top)
    return finish(mk.cluster_correlation(avg, "cluster"))


@register("dotplot_table", with_views(MARKERS_SQL + _TOP10 + """,
sel AS (SELECT DISTINCT gene FROM top10),
grid AS (SELECT s.gene, c.cluster, c.n FROM sel s CROSS JOIN csize c),
agg AS (SELECT n.gene, l.cluster, sum(exp(n.value) - 1) AS s, count(CASE WHEN n.value > 0 THEN 1 END) AS nnz
        FROM norm n JOIN lab l USING (sample, barcode) WHERE n.gene IN (SELECT gene FROM sel) GROUP BY 1, 2),
t AS (SELECT g.gene, g.cluster, coalesce(a.s, 0.0) / g.n AS avg_exp, 100.0 * coalesce(a.nnz, 0) / g.n AS pct_exp
      FROM grid g LEFT JOIN agg a USING (gene, cluster)),
z AS (SELECT *, (ln(1 + avg_exp) - avg(ln(1 + avg_exp)) OVER (PARTITION BY gene))
                / stddev_samp(ln(1 + avg_exp)) OVER (PARTITION BY gene) AS zz FROM t)
SELECT gene, cluster, round(avg_exp, 6) AS avg_exp, round(pct_exp, 6) AS pct_exp,
       round(least(greatest(coalesce(zz, 0.0), -2.5), 2.5), 6) AS avg_exp_scaled FROM z""", V_MK))
def dotplot_table(spark, d):
    """Dot-plot data for the top-10 marker genes (mean, percent expressing, clipped z)."""
    norm, labels = prepared(spark, d)
    top = top_n_ties(mk.find_markers(norm, labels, "cluster"), "cluster", "avg_log2fc", 10).select("gene").distinct()
    t = mk.dotplot_table(norm, labels, top, "cluster")
    return finish(t.select("gene", "cluster", "avg_exp", "pct_exp", "avg_exp_scaled"))


@register("first_marker_genes", with_views(MARKERS_SQL + """,
o AS (SELECT gene, min((cluster, p_val, -avg_log2fc, gene)) AS o FROM mk2 WHERE avg_log2fc > 0.05 GROUP BY gene)
SELECT gene FROM o ORDER BY o, gene LIMIT 100""", V_MK))
def first_marker_genes(spark, d):
    """First 100 distinct genes of the marker table in its (cluster, p, -fc, gene) order."""
    m = all_markers(spark, d).filter(F.col("avg_log2fc") > 0.05)
    return first_distinct(m.withColumn("nfc", -F.col("avg_log2fc")), "gene", ["cluster", "p_val", "nfc", "gene"], 100)


@register("heatmap_table", with_views(MARKERS_SQL + _TOP10 + """,
sel AS (SELECT DISTINCT gene FROM top10),
nc AS (SELECT count(*)::DOUBLE AS n FROM lab),
mom0 AS (SELECT n.gene, sum(n.value) AS s1, sum(n.value * n.value) AS s2 FROM norm n
         WHERE n.gene IN (SELECT gene FROM sel) GROUP BY 1),
mom AS (SELECT gene, s1 / nc.n AS mean,
               sqrt(greatest((s2 - nc.n * (s1 / nc.n) * (s1 / nc.n)) / (nc.n - 1.0), 0.0)) AS sd FROM mom0 CROSS JOIN nc)
SELECT l.sample, l.barcode, l.cluster, m.gene,
       round(CASE WHEN m.sd > 0 THEN least(greatest((coalesce(n.value, 0.0) - m.mean) / m.sd, -2.5), 2.5) ELSE 0.0 END, 6) AS z
FROM lab l CROSS JOIN mom m LEFT JOIN norm n ON n.sample = l.sample AND n.barcode = l.barcode AND n.gene = m.gene""", V_MK))
def heatmap_table(spark, d):
    """Z-scored (clip 2.5) expression of the top-10 markers at every cell, with the cell's
    cluster; absent entries carry the gene's zero z."""
    norm, labels = prepared(spark, d)
    top = top_n_ties(mk.find_markers(norm, labels, "cluster"), "cluster", "avg_log2fc", 10).select("gene").distinct()
    n = labels.count()
    nz, absent = nm.scale_genes(norm, n, genes=top, clip=2.5)
    return finish(nm.dense_scaled(nz, absent, labels).select(*KEYS, "cluster", "gene", F.col("value").alias("z")))


# ---- slide adjacency and views ------------------------------------------------------------

@register("spot_neighbors", with_views("""
SELECT a.sample, a.barcode AS src, b.barcode AS dst, 1.0::DOUBLE AS weight FROM spots a JOIN spots b ON a.sample = b.sample
 AND ((b.array_row = a.array_row AND abs(b.array_col - a.array_col) = 2)
   OR (abs(b.array_row - a.array_row) = 1 AND abs(b.array_col - a.array_col) = 1))""", ["spots"]))
def spot_neighbors(spark, d):
    """Immediate hexagonal neighbours of every spot (directed edges)."""
    return sp.spot_neighbors(adapter.spots(spark, d))


@register("spot_pairs_within", with_views(f"""
SELECT a.sample, a.barcode AS src, b.barcode AS dst, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d
FROM spots a JOIN spots b ON a.sample = b.sample AND a.barcode < b.barcode
WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {PAIR_RADIUS}""", ["spots"]))
def spot_pairs_within(spark, d):
    """C11: unordered spot pairs within distance 250 (grid-binned equi-join)."""
    p = sp.spot_pairs_within(adapter.spots(spark, d), PAIR_RADIUS).filter(F.col("src") < F.col("dst"))
    return finish(p)


@register("slide_views", with_views(f"""
ed AS (SELECT a.sample, a.barcode AS src, b.barcode AS dst FROM spots a JOIN spots b ON a.sample = b.sample
       AND ((b.array_row = a.array_row AND abs(b.array_col - a.array_col) = 2)
         OR (abs(b.array_row - a.array_row) = 1 AND abs(b.array_col - a.array_col) = 1))),
pr AS (SELECT a.sample, a.barcode AS src, b.barcode AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
       FROM spots a JOIN spots b ON a.sample = b.sample AND a.barcode <> b.barcode
       WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {3 * PARA_L}),
v AS (SELECT sample, barcode, 'intra' AS view, cell_type, score AS value FROM composition
      UNION ALL
      SELECT e.sample, e.src, 'juxta', c.cell_type, sum(c.score) FROM ed e
      JOIN composition c ON c.sample = e.sample AND c.barcode = e.dst GROUP BY 1, 2, 4
      UNION ALL
      SELECT p.sample, p.src, 'para', c.cell_type, sum(exp(-pow(p.d / {PARA_L}, 2)) * c.score) FROM pr p
      JOIN composition c ON c.sample = p.sample AND c.barcode = p.dst GROUP BY 1, 2, 4)
SELECT sample, barcode, view, cell_type, round(value, 6) AS value FROM v""", ["spots", "composition"]))
def slide_views(spark, d):
    """Intra / juxta (hexagonal neighbour sum) / para (Gaussian l = 100 within 300) views."""
    return finish(sp.views(adapter.composition(spark, d), adapter.spots(spark, d), PARA_L))
