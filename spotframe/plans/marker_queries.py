"""Samples -> QC -> normalise -> one-vs-rest markers -> per-cluster tables.

Driver parameters (FIXTURES.md): min features 20, min cells 20, markers with
min_pct = 0 and min_logfc = 0, no p filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.functions.stats import erfc_sql, round_half_up_sql
from spotframe.operators import markers as mk
from spotframe.operators import normalize as nm
from spotframe.operators import qc
from spotframe.operators.ranking import top_n_ties
from spotframe.plans.catalog import finish, register
from spotframe.plans.oracle_views import with_views
from spotframe.session import stage
from spotframe.sources import adapter

KEYS = ["sample", "barcode"]
MIN_FEATURES = 20
MIN_CELLS = 20


def prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(log-normalised expr, labels of the kept cells); both materialised once (``stage``)
    because the median, the group sizes and the marker test all read them; so are the raw counts,
    which both sides of the cell filter read, and the counts of the kept genes, which the depths and
    the normalisation read."""
    raw = stage(adapter.expr(spark, d))
    e1 = stage(qc.min_features(raw, MIN_FEATURES))
    cells = stage(e1.select(*KEYS).distinct())
    e2 = stage(qc.filter_genes(e1, MIN_CELLS))
    norm = stage(nm.log_normalize(e2, cells=cells))
    labels = stage(adapter.spots(spark, d).join(cells, KEYS, "left_semi").select(*KEYS, "cluster"))
    return norm, labels


def all_markers(spark: SparkSession, d: str) -> DataFrame:
    norm, labels = prepared(spark, d)
    return mk.find_markers(norm, labels, "cluster")


PREP_SQL = f"""
raw_cells AS (SELECT sample, barcode FROM expr WHERE value > 0 GROUP BY 1, 2 HAVING count(*) >= {MIN_FEATURES}),
e1 AS (SELECT * FROM expr SEMI JOIN raw_cells USING (sample, barcode)),
kg AS (SELECT gene FROM e1 WHERE value > 0 GROUP BY gene HAVING count(*) >= {MIN_CELLS}),
e2 AS (SELECT * FROM e1 SEMI JOIN kg USING (gene)),
dep AS (SELECT sample, barcode, sum(value) AS depth FROM e2 GROUP BY 1, 2),
med AS (SELECT median(coalesce(d.depth, 0.0::DOUBLE)) AS s FROM raw_cells c LEFT JOIN dep d USING (sample, barcode)),
norm AS (SELECT e2.sample, e2.barcode, e2.gene, ln(1 + e2.value / dep.depth * med.s) AS value
         FROM e2 JOIN dep USING (sample, barcode) CROSS JOIN med),
lab AS (SELECT sample, barcode, cluster FROM spots SEMI JOIN raw_cells USING (sample, barcode))"""

def marker_ctes(p: str = "", lab: str = "lab") -> str:
    """Oracle CTE chain of the zero-aware rank-sum test on ``norm`` with labels ``lab``
    (columns sample, barcode, cluster); CTE names carry the prefix ``p``; the last is ``{p}mk2``."""
    return f"""
{p}sizes AS (SELECT cluster, count(*)::DOUBLE AS n1 FROM {lab} GROUP BY cluster),
{p}tot AS (SELECT count(*)::DOUBLE AS nn FROM {lab}),
{p}ng AS (SELECT count(DISTINCT gene)::DOUBLE AS g FROM norm),
{p}nz AS (SELECT n.gene, n.value, l.cluster,
              rank() OVER (PARTITION BY n.gene ORDER BY n.value)
              + (count(*) OVER (PARTITION BY n.gene, n.value) - 1) / 2.0::DOUBLE AS rk
       FROM norm n JOIN {lab} l USING (sample, barcode)),
{p}gs AS (SELECT gene, count(*)::DOUBLE AS nnz, sum(exp(value) - 1) AS s_all FROM {p}nz GROUP BY gene),
{p}tie AS (SELECT gene, sum(t * t * t - t) AS ties_nz
        FROM (SELECT gene, value, count(*)::DOUBLE AS t FROM {p}nz GROUP BY 1, 2) GROUP BY gene),
{p}per AS (SELECT gene, cluster, count(*)::DOUBLE AS nnz1, sum(rk) AS r_nz1, sum(exp(value) - 1) AS s1
        FROM {p}nz GROUP BY 1, 2),
{p}st AS (SELECT gs.gene, s.cluster, s.n1, tot.nn - s.n1 AS n2, tot.nn AS nn, gs.nnz, gs.s_all, tie.ties_nz,
              coalesce(pp.nnz1, 0) AS nnz1, coalesce(pp.r_nz1, 0) AS r_nz1, coalesce(pp.s1, 0) AS s1
       FROM {p}gs gs JOIN {p}tie tie USING (gene) CROSS JOIN {p}sizes s CROSS JOIN {p}tot tot
       LEFT JOIN {p}per pp ON pp.gene = gs.gene AND pp.cluster = s.cluster),
{p}calc AS (SELECT *,
           r_nz1 + nnz1 * (nn - nnz) + (n1 - nnz1) * ((nn - nnz) + 1.0) / 2.0 - n1 * (n1 + 1.0) / 2.0 AS u,
           n1 * n2 / 2.0 AS mu,
           n1 * n2 / 12.0 * ((nn + 1.0) - (ties_nz + ((nn - nnz) * (nn - nnz) * (nn - nnz) - (nn - nnz)))
                                          / (nn * (nn - 1.0))) AS var
         FROM {p}st),
{p}zz AS (SELECT *, CASE WHEN sqrt(greatest(var, 0)) > 0
                      THEN greatest(abs(u - mu) - 0.5, 0) / sqrt(greatest(var, 0)) ELSE 0.0 END AS zabs
       FROM {p}calc),
{p}mk AS (SELECT cluster, gene,
         log2(s1 / n1 + 1.0) - log2(CASE WHEN n2 > 0 THEN (s_all - s1) / n2 ELSE 0.0 END + 1.0) AS avg_log2fc,
         {round_half_up_sql('nnz1 / n1', 3)} AS pct_1,
         CASE WHEN n2 > 0 THEN {round_half_up_sql('(nnz - nnz1) / n2', 3)} ELSE 0.0 END AS pct_2,
         CASE WHEN u < mu THEN -zabs ELSE zabs END AS z,
         CASE WHEN sqrt(greatest(var, 0)) > 0 THEN {erfc_sql('zabs / 1.4142135623730951')} ELSE 1.0 END AS p_val
       FROM {p}zz),
{p}mk2 AS (SELECT m.*, least(1.0, m.p_val * n.g) AS p_val_adj FROM {p}mk m CROSS JOIN {p}ng n)"""


MARKERS_SQL = PREP_SQL + "," + marker_ctes()

MARKER_COLS = "cluster, gene, round(avg_log2fc, 6) AS avg_log2fc, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, round(z, 6) AS z, round(p_val, 6) AS p_val, round(p_val_adj, 6) AS p_val_adj"


def _marker_cols(df: DataFrame) -> DataFrame:
    return finish(df.select("cluster", "gene", "avg_log2fc", "pct_1", "pct_2", "z", "p_val", "p_val_adj"))


@register("markers_all", with_views(MARKERS_SQL + f"\nSELECT {MARKER_COLS} FROM mk2",
                                    ["spots", "expr"]))
def markers_all(spark, d):
    """Every (gene, cluster) one-vs-rest rank-sum test."""
    return _marker_cols(all_markers(spark, d))


def _top_sql(n: int) -> str:
    return with_views(MARKERS_SQL + f""",
ranked AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY round(avg_log2fc, 9) DESC) AS rk FROM mk2)
SELECT {MARKER_COLS} FROM ranked WHERE rk <= {n}""", ["spots", "expr"])


@register("markers_top10", _top_sql(10))
def markers_top10(spark, d):
    """G19 -> E1: top-10 markers per cluster by fold change, ties kept (flagship)."""
    return _marker_cols(top_n_ties(all_markers(spark, d), "cluster", "avg_log2fc", 10))


@register("markers_top4", _top_sql(4))
def markers_top4(spark, d):
    """G19 -> E1 with n = 4."""
    return _marker_cols(top_n_ties(all_markers(spark, d), "cluster", "avg_log2fc", 4))


@register("markers_significant", with_views(MARKERS_SQL + f"""
SELECT {MARKER_COLS} FROM mk2 WHERE avg_log2fc > 0.05 AND p_val < 0.5""", ["spots", "expr"]))
def markers_significant(spark, d):
    """G19 -> B12: fold change > 0.05 and raw p < 0.5 (adjusted p is 1 on random data)."""
    return _marker_cols(mk.significant(all_markers(spark, d), min_fc=0.05, max_p=0.5))


@register("markers_positive", with_views(MARKERS_SQL + f"""
SELECT {MARKER_COLS} FROM mk2 WHERE avg_log2fc > 0 AND greatest(pct_1, pct_2) >= 0.02 AND p_val < 0.5""",
                                         ["spots", "expr"]))
def markers_positive(spark, d):
    """G19 options: only_pos, min_pct = 0.02, return threshold p < 0.5."""
    norm, labels = prepared(spark, d)
    return _marker_cols(mk.find_markers(norm, labels, "cluster", only_pos=True, min_pct=0.02, max_p=0.5))
