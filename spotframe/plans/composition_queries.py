"""Marker-overlap enrichment, composition-cluster enrichment, co-occurrence and LR co-occurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.functions.stats import hyper_lower_sql, hyper_upper_sql
from spotframe.operators import enrich as en
from spotframe.operators import lr as lrop
from spotframe.operators import markers as mk
from spotframe.operators.ranking import top_n_ties
from spotframe.operators.transfer import hash_sample
from spotframe.plans.catalog import finish, register
from spotframe.plans.lr_queries import LR_BASE, LRFlow
from spotframe.plans.marker_queries import PREP_SQL, marker_ctes, prepared
from spotframe.plans.oracle_views import with_views
from spotframe.session import stage
from spotframe.sources import adapter

KEYS = ["sample", "barcode"]
TOP_N = 50
PRESENCE = 0.2
LR_MIN_EXPR = 1.0
LR_MAX_P = 0.2
LR_SUBSET = 500
CLUSTER_A, CLUSTER_B = "BUILDING", "MACHINERY"


def _type_labels(spark, d, cells):
    """Cell-type labels for the overlap query: 'T' + nation key mod 5 of the customer."""
    c = adapter.table(spark, d, "customer").select(
        F.concat(F.lit("S"), (F.col("c_custkey") % 6).cast("string")).alias("sample"),
        F.col("c_custkey").cast("string").alias("barcode"),
        F.concat(F.lit("T"), (F.col("c_nationkey") % 5).cast("string")).alias("cluster"))
    return c.join(cells, KEYS, "left_semi")


OVERLAP_SQL = PREP_SQL + """,
lab2 AS (SELECT 'S' || CAST(c_custkey % 6 AS VARCHAR) AS sample, CAST(c_custkey AS VARCHAR) AS barcode,
                'T' || CAST(c_nationkey % 5 AS VARCHAR) AS cluster FROM customer
         SEMI JOIN raw_cells ON raw_cells.sample = 'S' || CAST(c_custkey % 6 AS VARCHAR)
                             AND raw_cells.barcode = CAST(c_custkey AS VARCHAR)),""" + marker_ctes("r", "lab") + "," + \
    marker_ctes("t", "lab2") + f""",
rset AS (SELECT DISTINCT 'region_' || cluster AS region, gene FROM
         (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY round(avg_log2fc, 9) DESC) AS rk FROM rmk2) WHERE rk <= {TOP_N}),
tset AS (SELECT DISTINCT 'sc_' || cluster AS cell_type, gene FROM
         (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY round(avg_log2fc, 9) DESC) AS rk FROM tmk2) WHERE rk <= {TOP_N}),
ngen AS (SELECT count(DISTINCT gene) AS n_genes FROM norm),
rs AS (SELECT region, count(*) AS n_a FROM rset GROUP BY 1),
ts AS (SELECT cell_type, count(*) AS n_b FROM tset GROUP BY 1),
ov AS (SELECT region, cell_type, count(*) AS k FROM rset JOIN tset USING (gene) GROUP BY 1, 2),
g AS (SELECT rs.region, ts.cell_type, coalesce(ov.k, 0) AS k, rs.n_a, ts.n_b, ngen.n_genes AS n_total
      FROM rs CROSS JOIN ts CROSS JOIN ngen LEFT JOIN ov ON ov.region = rs.region AND ov.cell_type = ts.cell_type),
h AS (SELECT *, n_a * n_b / n_total::DOUBLE AS expected,
             {hyper_upper_sql('k', 'n_total', 'n_a', 'n_b')} AS p_upper,
             {hyper_lower_sql('k', 'n_total', 'n_a', 'n_b')} AS p_lower FROM g)
SELECT region, cell_type, k, n_a, n_b, round(expected, 6) AS expected, round(p_upper, 6) AS p_upper,
       round(p_lower, 6) AS p_lower, round(-log10(p_upper), 6) AS neg_log10_p,
       round(CASE WHEN p_lower < p_upper THEN log10(p_lower) ELSE -log10(p_upper) END, 6) AS score FROM h"""


@register("marker_overlap", with_views(OVERLAP_SQL, ["spots", "expr"]))
def marker_overlap(spark, d):
    """G19 twice -> E1 -> I2 -> I1: region x cell-type marker overlap (hypergeometric tails)."""
    norm, labels = prepared(spark, d)
    cells = labels.select(*KEYS)
    n_genes = norm.select("gene").distinct().count()
    rm = top_n_ties(mk.find_markers(norm, labels, "cluster", n_genes=n_genes), "cluster", "avg_log2fc", TOP_N)
    tm = top_n_ties(mk.find_markers(norm, _type_labels(spark, d, cells), "cluster", n_genes=n_genes),
                    "cluster", "avg_log2fc", TOP_N)
    res = en.marker_overlap(en.prepare_marker_list(rm, "region_"), en.prepare_marker_list(tm, "sc_"), n_genes)
    return finish(res.select("region", "cell_type", "k", "n_a", "n_b", "expected", "p_upper", "p_lower",
                             "neg_log10_p", "score"))


@register("marker_lists", with_views(PREP_SQL + "," + marker_ctes() + """
SELECT 'region_' || cluster AS "group", gene, round(avg_log2fc, 6) AS avg_log2fc FROM mk2 WHERE avg_log2fc > 0.05 AND p_val < 0.5 AND pct_1 - pct_2 > 0.0""",
                                     ["spots", "expr"]))
def marker_lists(spark, d):
    """Marker list preparation: fold change > 0.05, raw p < 0.5, d > 0, 'region_' prefix."""
    norm, labels = prepared(spark, d)
    m = mk.find_markers(norm, labels, "cluster")
    return finish(en.prepare_marker_list(m, "region_", min_fc=0.05, max_p=0.5, min_d=0.0))


@register("cc_enrichment", with_views("""
n_cc AS (SELECT cluster AS cc, count(*)::DOUBLE AS n_cc FROM spots GROUP BY 1),
n_all AS (SELECT count(*)::DOUBLE AS n FROM spots),
c AS (SELECT c.*, s.cluster AS cc FROM composition c JOIN spots s USING (sample, barcode)),
si AS (SELECT cc, cell_type, sum(score) AS s FROM c GROUP BY 1, 2),
sa AS (SELECT cell_type, sum(score) / max(n_all.n) AS mean_all FROM c CROSS JOIN n_all GROUP BY 1),
t AS (SELECT si.cc, si.cell_type, si.s / n_cc.n_cc AS mean_in, sa.mean_all FROM si JOIN n_cc USING (cc) JOIN sa USING (cell_type)),
t2 AS (SELECT *, log2((mean_in + 1e-9) / (mean_all + 1e-9)) AS log2_ratio FROM t)
SELECT cc, cell_type, round(mean_in, 6) AS mean_in, round(mean_all, 6) AS mean_all, round(log2_ratio, 6) AS log2_ratio,
       log2_ratio > 0 AS enriched,
       CAST(row_number() OVER (PARTITION BY cc ORDER BY log2_ratio DESC, cell_type) AS INTEGER) AS rank FROM t2""",
                                      ["spots", "composition"]))
def cc_enrichment(spark, d):
    """K3: enriched cell types per cluster (mean share in cluster vs overall)."""
    lab = adapter.spots(spark, d).select(*KEYS, F.col("cluster").alias("cc"))
    return finish(en.cc_enrichment(adapter.composition(spark, d), lab))


COOC_SQL = f"""
lab AS (SELECT sample, barcode, cluster AS cc FROM spots),
pres AS (SELECT c.sample, c.barcode, l.cc, c.cell_type AS item FROM composition c JOIN lab l USING (sample, barcode)
         WHERE c.score > {PRESENCE}),
n_cc AS (SELECT cc, count(*) AS n_total FROM lab GROUP BY 1),
cnt AS (SELECT cc, item, count(*) AS c FROM pres GROUP BY 1, 2),
pairs AS (SELECT a.cc, a.item AS a, b.item AS b, a.c AS n_a, b.c AS n_b FROM cnt a JOIN cnt b ON a.cc = b.cc AND a.item < b.item),
both_ AS (SELECT x.cc, x.item AS a, y.item AS b, count(*) AS k FROM pres x JOIN pres y
          ON x.sample = y.sample AND x.barcode = y.barcode AND x.item < y.item GROUP BY 1, 2, 3),
t AS (SELECT p.cc, p.a, p.b, coalesce(b.k, 0) AS k, p.n_a, p.n_b, n_cc.n_total FROM pairs p JOIN n_cc USING (cc)
      LEFT JOIN both_ b ON b.cc = p.cc AND b.a = p.a AND b.b = p.b),
h AS (SELECT *, n_a * n_b / n_total::DOUBLE AS expected, {hyper_lower_sql('k', 'n_total', 'n_a', 'n_b')} AS p_le,
             {hyper_upper_sql('k', 'n_total', 'n_a', 'n_b')} AS p_ge FROM t)"""


def _cooc(spark, d):
    lab = adapter.spots(spark, d).select(*KEYS, F.col("cluster").alias("cc"))
    return en.cooccurrence(adapter.composition(spark, d), lab, PRESENCE)


@register("cooccurrence", with_views(COOC_SQL + """
SELECT cc, a, b, k, n_a, n_b, n_total, round(expected, 6) AS expected, round(p_le, 6) AS p_le, round(p_ge, 6) AS p_ge,
       CASE WHEN p_ge < 0.05 THEN 'positive' WHEN p_le < 0.05 THEN 'negative' ELSE 'random' END AS call FROM h""",
                                     ["spots", "composition"]))
def cooccurrence(spark, d):
    """K4: cell-type co-occurrence per cluster (presence = share > 0.2), hypergeometric tails."""
    return finish(_cooc(spark, d))


@register("chord_table", with_views(COOC_SQL + """
SELECT cc, a, b, k, round(p_ge, 6) AS p_ge FROM h ORDER BY k DESC, p_ge ASC, cc, a, b LIMIT 20""",
                                    ["spots", "composition"]))
def chord_table(spark, d):
    """K7: top-20 co-occurring cell-type pairs (chord-diagram data)."""
    return finish(en.chord_table(_cooc(spark, d)).select("cc", "a", "b", "k", "p_ge"))


ENR_SQL = LR_BASE + f""",
lab AS (SELECT sample, barcode, cluster AS cc FROM spots),
n_cc AS (SELECT cc, count(*) AS n_total FROM lab GROUP BY 1),
pres AS (SELECT c.sample, c.barcode, c.lr, c.side, l.cc FROM ce c JOIN lab l USING (sample, barcode) WHERE c.value >= {LR_MIN_EXPR}),
kk AS (SELECT cc, lr, count(*) AS n_a FROM pres WHERE side = 'L' GROUP BY 1, 2),
nn AS (SELECT cc, lr, count(*) AS n_b FROM pres WHERE side = 'R' GROUP BY 1, 2),
bo AS (SELECT x.cc, x.lr, count(*) AS k FROM pres x JOIN pres y ON x.sample = y.sample AND x.barcode = y.barcode
       AND x.lr = y.lr AND x.side = 'L' AND y.side = 'R' GROUP BY 1, 2),
t AS (SELECT kk.cc, kk.lr, kk.n_a, nn.n_b, coalesce(bo.k, 0) AS k, n_cc.n_total FROM kk JOIN nn USING (cc, lr) JOIN n_cc USING (cc)
      LEFT JOIN bo ON bo.cc = kk.cc AND bo.lr = kk.lr),
enr AS (SELECT *, {hyper_upper_sql('k', 'n_total', 'n_a', 'n_b')} AS p_ge FROM t)"""
V_LR = ["spots", "expr_coarse", "lr_db"]


def _enriched(spark, d):
    f = LRFlow(spark, d)
    lab = f.spots.select(*KEYS, F.col("cluster").alias("cc"))
    return f, en.enriched_lrs(f.ce(), lab, LR_MIN_EXPR, LR_MAX_P)


@register("enriched_lrs", with_views(ENR_SQL + f"""
SELECT cc, lr, n_a, n_b, k, n_total, round(p_ge, 6) AS p_ge FROM enr WHERE p_ge < {LR_MAX_P}""", V_LR))
def enriched_lrs(spark, d):
    """K5: LRs whose ligand and receptor (level >= 1) co-occur in a cluster's spots, P(>=) < 0.2."""
    _, e = _enriched(spark, d)
    return finish(e.select("cc", "lr", "n_a", "n_b", "k", "n_total", "p_ge"))


@register("lr_subset_cooccurrence", with_views(ENR_SQL + f""",
few AS (SELECT lr FROM lr_db ORDER BY md5(lr), lr LIMIT {LR_SUBSET}),
named AS (SELECT DISTINCT t.cc, array_to_string(d.ligand, '+') AS a, array_to_string(d.receptor, '+') AS b,
                 CAST(t.k AS BIGINT) AS k, CAST(t.n_a AS BIGINT) AS n_a, CAST(t.n_b AS BIGINT) AS n_b, n_total
          FROM t JOIN lr_db d USING (lr) SEMI JOIN few USING (lr)),
h AS (SELECT *, n_a * n_b / n_total::DOUBLE AS expected, {hyper_lower_sql('k', 'n_total', 'n_a', 'n_b')} AS p_le,
             {hyper_upper_sql('k', 'n_total', 'n_a', 'n_b')} AS p_ge FROM named)
SELECT cc, a, b, k, n_a, n_b, n_total, round(expected, 6) AS expected, round(p_le, 6) AS p_le, round(p_ge, 6) AS p_ge,
       CASE WHEN p_ge < 0.05 THEN 'positive' WHEN p_le < 0.05 THEN 'negative' ELSE 'random' END AS call FROM h""", V_LR))
def lr_subset_cooccurrence(spark, d):
    """K8 -> K4: ligands and receptors of a hashed sample of 500 LRs (all, where there are fewer), by presence bitmaps."""
    db = hash_sample(adapter.lr_db(spark, d), ["lr"], LR_SUBSET)
    ce = lrop.complex_expression(adapter.expr_coarse(spark, d), db).filter(F.col("value") >= LR_MIN_EXPR)
    names = db.select("lr", F.array_join("ligand", "+").alias("a"), F.array_join("receptor", "+").alias("b"))
    sides = names.select("lr", F.explode(F.map_from_arrays(F.array(F.lit("L"), F.lit("R")), F.array("a", "b"))).alias("side", "item"))
    present = ce.join(F.broadcast(sides), ["lr", "side"]).select(*KEYS, "item")       # at most 2 x 500 rows
    lab = adapter.spots(spark, d).select(*KEYS, F.col("cluster").alias("cc"))
    return finish(en.cooccurrence_of(present, lab, names, "item"))


@register("diff_lrs", with_views(ENR_SQL + f""",
e AS (SELECT * FROM enr WHERE p_ge < {LR_MAX_P}),
ea AS (SELECT lr, p_ge AS p_a FROM e WHERE cc = '{CLUSTER_A}'),
eb AS (SELECT lr, p_ge AS p_b FROM e WHERE cc = '{CLUSTER_B}'),
j AS (SELECT coalesce(ea.lr, eb.lr) AS lr, ea.p_a, eb.p_b FROM ea FULL JOIN eb ON ea.lr = eb.lr),
s AS (SELECT *, CASE WHEN p_a < 0.05 AND NOT coalesce(p_b < 0.1, false) THEN '{CLUSTER_A}'
                     WHEN p_b < 0.05 AND NOT coalesce(p_a < 0.1, false) THEN '{CLUSTER_B}' END AS side FROM j)
SELECT lr, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, side FROM s WHERE side IS NOT NULL""", V_LR))
def diff_lrs(spark, d):
    """K6: cluster-specific LRs (p < 0.05 in one cluster and not p < 0.1 in the other)."""
    _, e = _enriched(spark, d)
    return finish(en.diff_lrs(e, CLUSTER_A, CLUSTER_B, 0.05, 0.1).select("lr", "p_a", "p_b", "side"))


@register("sankey_table", with_views(ENR_SQL + f""",
e AS (SELECT * FROM enr WHERE p_ge < {LR_MAX_P}),
f AS (SELECT DISTINCT lr, '{CLUSTER_A}' AS side FROM e WHERE cc = '{CLUSTER_A}'
      UNION ALL SELECT DISTINCT lr, '{CLUSTER_B}' FROM e WHERE cc = '{CLUSTER_B}')
SELECT f.side, array_to_string(d.ligand, '+') AS ligand, array_to_string(d.receptor, '+') AS receptor, count(*) AS n
FROM f JOIN lr_db d USING (lr) GROUP BY 1, 2, 3""", V_LR))
def sankey_table(spark, d):
    """K7: ligand -> receptor flows of the enriched LRs of two clusters (Sankey data)."""
    f, e = _enriched(spark, d)
    return en.sankey_table(e.filter(F.col("cc") == CLUSTER_A), e.filter(F.col("cc") == CLUSTER_B), f.lr_db,
                           CLUSTER_A, CLUSTER_B)
