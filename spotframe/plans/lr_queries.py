"""Ligand-receptor neighbourhood scores, null p-values, FDR, summaries and cell-cell interaction.

Driver parameters (FIXTURES.md): coarse counts (gene = part name), hexagonal
neighbours, 2000 random pairs, 10 expression bins, BH within spot with cut-off 0.2,
cell-type presence > 0.2, at least 5 scoring / 3 significant spots, 1000 permutations.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spotframe.functions.stats import lcg_sql
from spotframe.operators import lr as lrop
from spotframe.operators.ranking import first_k
from spotframe.operators.slide import spot_neighbors
from spotframe.plans.catalog import finish, register
from spotframe.session import stage
from spotframe.plans.oracle_views import with_views
from spotframe.sources import adapter

KEYS = ["sample", "barcode"]
MIN_SPOTS = 5
N_PAIRS = 2000
N_BINS = 10
CUTOFF = 0.2
TYPE_CUTOFF = 0.2
CCI_MIN_SPOTS = 3
N_PERMS = 1000
MIN_PCT = 0.05

V = ["spots", "expr_coarse", "lr_db"]
V_C = ["spots", "expr_coarse", "lr_db", "composition"]


class LRFlow:
    """The LR flow for one data directory; hub tables are materialised once (``stage``)
    and reused by every later step instead of re-running their lineage."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.spots = adapter.spots(spark, d)
        self.expr = stage(adapter.expr_coarse(spark, d))
        self.lr_db = stage(adapter.lr_db(spark, d))
        self._memo = {}

    @property
    def edges(self):
        return self._get("edges", lambda: spot_neighbors(self.spots))

    def _get(self, name, build):
        if name not in self._memo:
            self._memo[name] = stage(build())
        return self._memo[name]

    def ce(self):
        return self._get("ce", lambda: lrop.complex_expression(self.expr, self.lr_db))

    # tables of a row per spot and LR keep the columns that a later step or a result reads
    def scores(self):
        return self._get("scores", lambda: lrop.lr_scores(self.expr, self.edges, self.lr_db, MIN_SPOTS, ce=self.ce())
                         .select(*KEYS, "lr", "score"))

    def pvalues(self):
        return self._get("pvalues", lambda: lrop.lr_null_p(self.expr, self.edges, self.lr_db, self.scores(),
                                                           N_PAIRS, N_BINS, ce=self.ce())
                         .select(*KEYS, "lr", "score", "p"))

    def stats(self):
        def build():
            pv = self.pvalues()
            m = pv.groupBy("sample").agg(F.countDistinct("lr").alias("m"))
            return lrop.lr_significance(pv, m, CUTOFF)
        return self._get("stats", build)

    def composition(self):
        return self._get("composition", lambda: adapter.composition(self.spark, self.d))

    def cci(self):
        return self._get("cci", lambda: lrop.cci_counts(self.stats(), self.expr, self.edges, self.lr_db,
                                                        self.composition(), TYPE_CUTOFF, CCI_MIN_SPOTS, ce=self.ce()))


def _score_sql(L, R, mL, mR):
    ind = lambda c: f"(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END)"
    return f"(0.5 * ({L} * {ind(mR)} + {ind(L)} * {mR} + {R} * {ind(mL)} + {ind(R)} * {mL}))"


LR_BASE = f"""
edges AS (SELECT a.sample, a.barcode AS src, b.barcode AS dst FROM spots a JOIN spots b ON a.sample = b.sample
          AND ((b.array_row = a.array_row AND abs(b.array_col - a.array_col) = 2)
            OR (abs(b.array_row - a.array_row) = 1 AND abs(b.array_col - a.array_col) = 1))),
deg AS (SELECT sample, src, count(*) AS deg FROM edges GROUP BY 1, 2),
lrg AS (SELECT lr, 'L' AS side, unnest(ligand) AS gene, len(ligand) AS n_sub FROM lr_db
        UNION ALL SELECT lr, 'R' AS side, unnest(receptor) AS gene, len(receptor) AS n_sub FROM lr_db),
ce AS (SELECT e.sample, e.barcode, g.lr, g.side, min(e.value) AS value FROM expr_coarse e JOIN lrg g USING (gene)
       WHERE e.value > 0 GROUP BY 1, 2, 3, 4 HAVING count(*) = max(g.n_sub)),
cenb AS (SELECT ed.sample, ed.src AS barcode, c.lr, c.side, sum(c.value) / max(d.deg) AS nbr_mean
         FROM edges ed JOIN ce c ON c.sample = ed.sample AND c.barcode = ed.dst
         JOIN deg d ON d.sample = ed.sample AND d.src = ed.src GROUP BY 1, 2, 3, 4),
cev AS (SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.barcode, b.barcode) AS barcode,
               coalesce(a.lr, b.lr) AS lr, coalesce(a.side, b.side) AS side,
               coalesce(a.value, 0.0) AS value, coalesce(b.nbr_mean, 0.0) AS nbr_mean
        FROM ce a FULL JOIN cenb b ON a.sample = b.sample AND a.barcode = b.barcode AND a.lr = b.lr AND a.side = b.side),
lw AS (SELECT sample, barcode, lr,
              coalesce(max(CASE WHEN side = 'L' THEN value END), 0.0) AS L,
              coalesce(max(CASE WHEN side = 'R' THEN value END), 0.0) AS R,
              coalesce(max(CASE WHEN side = 'L' THEN nbr_mean END), 0.0) AS mL,
              coalesce(max(CASE WHEN side = 'R' THEN nbr_mean END), 0.0) AS mR
       FROM cev GROUP BY 1, 2, 3),
sc0 AS (SELECT sample, barcode, lr, L, R, mL, mR, {_score_sql('L', 'R', 'mL', 'mR')} AS score FROM lw),
sc1 AS (SELECT * FROM sc0 WHERE score > 0),
scores AS (SELECT s.* FROM sc1 s SEMI JOIN (SELECT sample, lr FROM sc1 GROUP BY 1, 2 HAVING count(*) >= {MIN_SPOTS}) k
           USING (sample, lr))"""

_PROBS = ", ".join(repr(i / N_BINS) for i in range(1, N_BINS))
_CID = f"(bl * {N_BINS} + br)"

NULL_SQL = LR_BASE + f""",
nsp AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr_coarse) t),
gm AS (SELECT gene, sum(value) / max(nsp.n) AS mean FROM expr_coarse CROSS JOIN nsp GROUP BY gene),
bnd AS (SELECT quantile_disc(mean, [{_PROBS}]) AS b FROM gm),
gmb AS (SELECT gm.gene, len(list_filter(bnd.b, lambda x: x < gm.mean)) AS bin FROM gm CROSS JOIN bnd),
cand AS (SELECT gene, bin, row_number() OVER (PARTITION BY bin ORDER BY gene) - 1 AS j,
                count(*) OVER (PARTITION BY bin) AS n_b
         FROM gmb WHERE gene NOT IN (SELECT gene FROM lrg)),
cnts AS (SELECT DISTINCT bin, n_b FROM cand),
smean AS (SELECT lr, side, sum(value) / max(nsp.n) AS mean FROM ce CROSS JOIN nsp GROUP BY 1, 2),
sbin AS (SELECT s.lr, s.side, len(list_filter(bnd.b, lambda x: x < s.mean)) AS bin FROM smean s CROSS JOIN bnd),
lrb AS (SELECT lr, max(CASE WHEN side = 'L' THEN bin END) AS bl, max(CASE WHEN side = 'R' THEN bin END) AS br
        FROM sbin GROUP BY lr),
combos AS (SELECT x.bl, x.br, cl.n_b AS n_l, cr.n_b AS n_r FROM (SELECT DISTINCT bl, br FROM lrb) x
           JOIN cnts cl ON cl.bin = x.bl JOIN cnts cr ON cr.bin = x.br),
pairs0 AS (SELECT c.bl, c.br, c.n_l, c.n_r, t.k FROM combos c CROSS JOIN (SELECT range AS k FROM range(0, {N_PAIRS})) t),
pairs1 AS (SELECT bl, br, k, {lcg_sql('k', f'{_CID} * 2')} % n_l AS jl, {lcg_sql('k', f'{_CID} * 2 + 1')} % n_r AS jr
           FROM pairs0),
pairs AS (SELECT p.bl, p.br, a.gene AS gl, b.gene AS gr, count(*) AS mult FROM pairs1 p
          JOIN cand a ON a.bin = p.bl AND a.j = p.jl JOIN cand b ON b.bin = p.br AND b.j = p.jr
          WHERE a.gene <> b.gene GROUP BY 1, 2, 3, 4),
ngn AS (SELECT gl AS gene FROM pairs UNION SELECT gr FROM pairs),
gv0 AS (SELECT sample, barcode, gene, value FROM expr_coarse WHERE value > 0 AND gene IN (SELECT gene FROM ngn)),
gvnb AS (SELECT ed.sample, ed.src AS barcode, g.gene, sum(g.value) / max(d.deg) AS nbr_mean
         FROM edges ed JOIN gv0 g ON g.sample = ed.sample AND g.barcode = ed.dst
         JOIN deg d ON d.sample = ed.sample AND d.src = ed.src GROUP BY 1, 2, 3),
gv AS (SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.barcode, b.barcode) AS barcode,
              coalesce(a.gene, b.gene) AS gene, coalesce(a.value, 0.0) AS value, coalesce(b.nbr_mean, 0.0) AS nbr_mean
       FROM gv0 a FULL JOIN gvnb b ON a.sample = b.sample AND a.barcode = b.barcode AND a.gene = b.gene),
sl AS (SELECT g.sample, g.barcode, p.bl, p.br, p.gl, p.gr, p.mult, g.value AS L, g.nbr_mean AS mL FROM pairs p JOIN gv g ON g.gene = p.gl),
sr AS (SELECT g.sample, g.barcode, p.bl, p.br, p.gl, p.gr, p.mult, g.value AS R, g.nbr_mean AS mR FROM pairs p JOIN gv g ON g.gene = p.gr),
nl AS (SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.barcode, b.barcode) AS barcode,
              coalesce(a.bl, b.bl) AS bl, coalesce(a.br, b.br) AS br, coalesce(a.mult, b.mult) AS mult,
              coalesce(a.L, 0.0) AS L, coalesce(a.mL, 0.0) AS mL, coalesce(b.R, 0.0) AS R, coalesce(b.mR, 0.0) AS mR
       FROM sl a FULL JOIN sr b ON a.sample = b.sample AND a.barcode = b.barcode AND a.bl = b.bl AND a.br = b.br
                                AND a.gl = b.gl AND a.gr = b.gr),
nulls AS (SELECT sample, barcode, bl, br, mult, {_score_sql('L', 'R', 'mL', 'mR')} AS score FROM nl),
obs AS (SELECT s.*, b.bl, b.br FROM scores s JOIN lrb b USING (lr)),
nge AS (SELECT o.sample, o.barcode, o.lr, coalesce(sum(n.mult), 0) AS n_ge FROM obs o
        LEFT JOIN nulls n ON n.sample = o.sample AND n.barcode = o.barcode AND n.bl = o.bl AND n.br = o.br
                         AND n.score > 0 AND n.score >= o.score GROUP BY 1, 2, 3),
nn AS (SELECT bl, br, sum(mult) AS n_null FROM pairs GROUP BY 1, 2),
pv AS (SELECT o.sample, o.barcode, o.lr, o.score,
              CASE WHEN coalesce(nn.n_null, 0) > 0 THEN (1.0 + g.n_ge) / (1.0 + nn.n_null) ELSE 1.0 END AS p
       FROM obs o JOIN nge g USING (sample, barcode, lr) LEFT JOIN nn USING (bl, br)),
mm AS (SELECT sample, count(DISTINCT lr) AS m FROM pv GROUP BY sample),
bh0 AS (SELECT pv.*, mm.m, row_number() OVER (PARTITION BY sample, barcode ORDER BY p) AS r FROM pv JOIN mm USING (sample)),
bh1 AS (SELECT *, p * m / r AS q FROM bh0),
bh AS (SELECT sample, barcode, lr, score, p,
              least(1.0, min(q) OVER (PARTITION BY sample, barcode ORDER BY r DESC
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj FROM bh1)"""

CCI_SQL = NULL_SQL + f""",
lig AS (SELECT sample, barcode, lr FROM ce WHERE side = 'L'),
rec AS (SELECT sample, barcode AS dst, lr FROM ce WHERE side = 'R'),
sig AS (SELECT b.sample, b.barcode, b.lr FROM bh b SEMI JOIN lig USING (sample, barcode, lr) WHERE b.p_adj < {CUTOFF}),
nb AS (SELECT sample, src AS barcode, dst FROM edges UNION ALL SELECT DISTINCT sample, barcode, barcode AS dst FROM sig),
pr AS (SELECT s.sample, s.lr, s.barcode, n.dst FROM sig s JOIN nb n USING (sample, barcode)
       JOIN rec r ON r.sample = s.sample AND r.dst = n.dst AND r.lr = s.lr),
ty AS (SELECT sample, barcode, cell_type FROM composition WHERE score > {TYPE_CUTOFF}),
cc0 AS (SELECT p.sample, p.lr, a.cell_type AS sender, b.cell_type AS receiver, count(DISTINCT p.barcode) AS n
        FROM pr p JOIN ty a ON a.sample = p.sample AND a.barcode = p.barcode
        JOIN ty b ON b.sample = p.sample AND b.barcode = p.dst GROUP BY 1, 2, 3, 4),
cci AS (SELECT * FROM cc0 SEMI JOIN (SELECT sample, lr FROM bh WHERE p_adj < {CUTOFF} GROUP BY 1, 2
                                     HAVING count(*) >= {CCI_MIN_SPOTS}) k USING (sample, lr))"""


@register("lr_complex_expression", with_views(LR_BASE + """
SELECT sample, barcode, lr, side, value FROM ce""", V))
def lr_complex_expression(spark, d):
    """Complex level = min over subunits (absent subunit -> no row)."""
    f = LRFlow(spark, d)
    return finish(f.ce())


@register("lr_filter_pct", with_views(f"""
lrg AS (SELECT lr, unnest(ligand || receptor) AS gene FROM lr_db),
nsp AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr_coarse) t),
sh AS (SELECT gene, count(*) / max(nsp.n) AS share FROM expr_coarse CROSS JOIN nsp WHERE value > 0 GROUP BY gene),
ok AS (SELECT lr FROM lrg LEFT JOIN sh USING (gene) GROUP BY lr HAVING bool_and(coalesce(share, 0.0) >= {MIN_PCT}))
SELECT lr, pathway FROM lr_db SEMI JOIN ok USING (lr)""", ["expr_coarse", "lr_db"]))
def lr_filter_pct(spark, d):
    """LRs whose every subunit is expressed in >= 5 % of spots."""
    f = LRFlow(spark, d)
    n = f.expr.select(*KEYS).distinct().count()
    return lrop.lr_filter_pct(f.expr, f.lr_db, n, MIN_PCT).select("lr", "pathway")


@register("lr_scores", with_views(LR_BASE + """
SELECT sample, barcode, lr, round(score, 6) AS score FROM scores""", V))
def lr_scores(spark, d):
    """H1: neighbourhood LR score per spot (hexagonal neighbours), LRs with >= 5 scoring spots."""
    return finish(LRFlow(spark, d).scores().select(*KEYS, "lr", "score"))


@register("lr_null_p", with_views(NULL_SQL + """
SELECT sample, barcode, lr, round(score, 6) AS score, round(p, 6) AS p FROM pv""", V))
def lr_null_p(spark, d):
    """H2: p from 2000 expression-matched random gene pairs per bin combination."""
    return finish(LRFlow(spark, d).pvalues().select(*KEYS, "lr", "score", "p"))


@register("lr_significance", with_views(NULL_SQL + f"""
SELECT sample, barcode, lr, round(score, 6) AS score, round(p, 6) AS p, round(p_adj, 6) AS p_adj,
       round(-log10(p_adj), 6) AS neg_log10_p_adj, p_adj < {CUTOFF} AS sig FROM bh""", V))
def lr_significance(spark, d):
    """H3: BH within spot across LRs, -log10 p_adj, significance flag."""
    s = LRFlow(spark, d).stats()
    return finish(s.select(*KEYS, "lr", "score", "p", "p_adj", "neg_log10_p_adj", "sig"))


@register("lr_matrix", with_views(NULL_SQL + f"""
SELECT sample, barcode, lr, round(score, 6) AS score, round(p_adj, 6) AS p_adj FROM bh WHERE p_adj < {CUTOFF}""", V))
def lr_matrix(spark, d):
    """H4: spot x LR table of significant scores with adjusted p (long form)."""
    s = LRFlow(spark, d).stats().filter("sig")
    return finish(s.select(*KEYS, "lr", "score", "p_adj"))


SUMMARY_SQL = NULL_SQL + f""",
summ AS (SELECT sample, lr, count(*) AS n_spots, count(CASE WHEN p_adj < {CUTOFF} THEN 1 END) AS n_spots_sig,
                count(CASE WHEN p < {CUTOFF} THEN 1 END) AS n_spots_sig_pval, sum(score) AS interaction_score
         FROM bh GROUP BY 1, 2)"""


@register("lr_summary", with_views(SUMMARY_SQL + """
SELECT sample, lr, n_spots, n_spots_sig, n_spots_sig_pval, round(interaction_score, 6) AS interaction_score,
       CAST(row_number() OVER (PARTITION BY sample ORDER BY n_spots_sig DESC, n_spots_sig_pval DESC, lr) AS INTEGER) AS rank
FROM summ""", V))
def lr_summary(spark, d):
    """H6 + D11 + E7: per-LR spot counts, interaction score and rank by significant spots."""
    return finish(lrop.lr_summary(LRFlow(spark, d).stats(), CUTOFF))


@register("best_lr", with_views(SUMMARY_SQL + """,
tot AS (SELECT lr, sum(n_spots_sig) AS n_spots_sig, sum(interaction_score) AS interaction_score FROM summ GROUP BY lr)
SELECT lr, CAST(n_spots_sig AS BIGINT) AS n_spots_sig, round(interaction_score, 6) AS interaction_score FROM tot
ORDER BY n_spots_sig DESC, interaction_score DESC, lr LIMIT 20""", V))
def best_lr(spark, d):
    """Top-20 LRs by significant spots then interaction score (over all samples)."""
    s = lrop.lr_summary(LRFlow(spark, d).stats(), CUTOFF)
    t = s.groupBy("lr").agg(F.sum("n_spots_sig").alias("n_spots_sig"), F.sum("interaction_score").alias("interaction_score"))
    return finish(first_k(t, [F.desc("n_spots_sig"), F.desc("interaction_score"), "lr"], 20))


@register("lr_diagnostics", with_views(LR_BASE + """,
nsp AS (SELECT count(*)::DOUBLE AS n FROM (SELECT DISTINCT sample, barcode FROM expr_coarse) t),
sd AS (SELECT lr, side, median(value) AS med, count(*) AS nnz FROM ce GROUP BY 1, 2),
full_sd AS (SELECT DISTINCT g.lr, g.side, coalesce(s.med, 0.0) AS med, coalesce(1.0 - s.nnz / nsp.n, 1.0) AS zero_share
            FROM lrg g CROSS JOIN nsp LEFT JOIN sd s ON s.lr = g.lr AND s.side = g.side)
SELECT lr, round(avg(med), 6) AS expr_level, round(avg(zero_share), 6) AS zero_freq FROM full_sd GROUP BY lr""", V))
def lr_diagnostics(spark, d):
    """H5: per LR expression level (mean of non-zero medians) and zero frequency."""
    f = LRFlow(spark, d)
    n = f.expr.select(*KEYS).distinct().count()
    return finish(lrop.lr_diagnostics(f.expr, f.lr_db, n, ce=f.ce()))


@register("cci_counts", with_views(CCI_SQL + "\nSELECT sample, lr, sender, receiver, n FROM cci", V_C))
def cci_counts(spark, d):
    """H7: sender x receiver cell-type counts around significant spots, per LR."""
    return LRFlow(spark, d).cci()


@register("cci_network", with_views(CCI_SQL + """
SELECT sample, sender, receiver, CAST(sum(n) AS BIGINT) AS n FROM cci GROUP BY 1, 2, 3 HAVING sum(n) >= 2""", V_C))
def cci_network(spark, d):
    """H9: CCI network edges over all LRs, count >= 2."""
    return lrop.cci_network(LRFlow(spark, d).cci(), 2)


@register("cci_network_by_lr", with_views(CCI_SQL + """
SELECT sample, lr, sender, receiver, CAST(sum(n) AS BIGINT) AS n FROM cci GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 2""", V_C))
def cci_network_by_lr(spark, d):
    """H9: one CCI network per LR, count >= 2."""
    return lrop.cci_network(LRFlow(spark, d).cci(), 2, by_lr=True)


@register("lr_cci_map", with_views(CCI_SQL + """,
t AS (SELECT lr, sender, receiver, CAST(sum(n) AS BIGINT) AS n FROM cci GROUP BY 1, 2, 3)
SELECT lr, sender, receiver, n FROM t WHERE lr IN (SELECT lr FROM t GROUP BY lr HAVING sum(n) >= 5)""", V_C))
def lr_cci_map(spark, d):
    """LR x (sender, receiver) counts for LRs with total >= 5."""
    return lrop.cci_map(LRFlow(spark, d).cci(), by_lr=True, min_total=5)


@register("cci_map", with_views(CCI_SQL + """
SELECT sender, receiver, CAST(sum(n) AS BIGINT) AS n FROM cci GROUP BY 1, 2""", V_C))
def cci_map(spark, d):
    """Cell type x cell type interaction counts over all LRs."""
    return lrop.cci_map(LRFlow(spark, d).cci())


@register("cci_check", with_views(CCI_SQL + f""",
fr AS (SELECT cell_type, count(*) AS n_spots FROM composition WHERE score > {TYPE_CUTOFF} GROUP BY 1),
ia AS (SELECT cell_type, sum(n) AS n_int FROM (SELECT sender AS cell_type, n FROM cci UNION ALL
                                               SELECT receiver, n FROM cci) GROUP BY 1),
j AS (SELECT fr.cell_type, fr.n_spots, coalesce(ia.n_int, 0) AS n_int FROM fr LEFT JOIN ia USING (cell_type))
SELECT cell_type, n_spots, CAST(n_int AS BIGINT) AS n_interactions,
       round(corr(n_spots::DOUBLE, n_int::DOUBLE) OVER (), 6) AS r FROM j""", V_C))
def cci_check(spark, d):
    """Per cell type: spots present vs interactions involved in, with their correlation."""
    f = LRFlow(spark, d)
    c = f.cci()
    comp = f.composition()
    fr = comp.filter(F.col("score") > TYPE_CUTOFF).groupBy("cell_type").agg(F.count("*").alias("n_spots"))
    ia = (c.select(F.col("sender").alias("cell_type"), "n").unionByName(c.select(F.col("receiver").alias("cell_type"), "n"))
          .groupBy("cell_type").agg(F.sum("n").alias("n_interactions")))
    j = fr.join(ia, "cell_type", "left").fillna(0, ["n_interactions"])
    # cell types are few: the correlation runs over one small window
    r = F.corr(F.col("n_spots").cast("double"), F.col("n_interactions").cast("double")).over(Window.partitionBy())
    return finish(j.select("cell_type", "n_spots", "n_interactions", r.alias("r")))


@register("cci_permutation", with_views(CCI_SQL + f""",
idx AS (SELECT sample, barcode, row_number() OVER (PARTITION BY sample ORDER BY array_row, array_col, barcode) - 1 AS i
        FROM spots),
reps AS (SELECT x.sample, x.barcode, t.rep FROM idx x CROSS JOIN (SELECT range AS rep FROM range(0, {N_PERMS})) t),
perm AS (SELECT sample, rep, barcode,
                row_number() OVER (PARTITION BY sample, rep ORDER BY md5(rep || '/' || barcode), barcode) - 1 AS j FROM reps),
pty AS (SELECT p.sample, p.rep, p.barcode, t.cell_type FROM perm p JOIN idx x ON x.sample = p.sample AND x.i = p.j
        JOIN ty t ON t.sample = x.sample AND t.barcode = x.barcode),
tn AS (SELECT cell_type, CAST(1 << (row_number() OVER (ORDER BY cell_type) - 1) AS BIGINT) AS bit FROM (SELECT DISTINCT cell_type FROM ty) t),
pm AS (SELECT p.sample, p.rep, p.barcode, sum(tn.bit)::BIGINT AS mask FROM pty p JOIN tn USING (cell_type) GROUP BY 1, 2, 3),
pn AS (SELECT p.sample, b.rep, p.lr, p.barcode, bit_or(b.mask) AS near FROM pr p
       JOIN pm b ON b.sample = p.sample AND b.barcode = p.dst GROUP BY 1, 2, 3, 4),
pg AS (SELECT n.sample, n.rep, n.lr, m.mask, n.near, count(*) AS n FROM pn n
       JOIN pm m ON m.sample = n.sample AND m.rep = n.rep AND m.barcode = n.barcode GROUP BY 1, 2, 3, 4, 5),
pc AS (SELECT g.sample, g.rep, g.lr, a.cell_type AS sender, b.cell_type AS receiver, sum(g.n) AS n_rep
       FROM pg g JOIN tn a ON (g.mask & a.bit) <> 0 JOIN tn b ON (g.near & b.bit) <> 0 GROUP BY 1, 2, 3, 4, 5)
SELECT c.sample, c.lr, c.sender, c.receiver, c.n, round((1.0 + count(pc.n_rep)) / {1.0 + N_PERMS!r}, 6) AS p
FROM cci c LEFT JOIN pc ON pc.sample = c.sample AND pc.lr = c.lr AND pc.sender = c.sender AND pc.receiver = c.receiver
                       AND pc.n_rep >= c.n
GROUP BY 1, 2, 3, 4, 5""", V_C))
def cci_permutation(spark, d):
    """H8: CCI p from 1000 within-sample permutations of the cell-type rows."""
    f = LRFlow(spark, d)
    obs = f.cci()
    res = lrop.cci_permutation(f.stats(), f.expr, f.edges, f.lr_db, f.composition(), f.spots, TYPE_CUTOFF, N_PERMS,
                               obs, ce=f.ce())
    return finish(res.select("sample", "lr", "sender", "receiver", "n", "p"))


@register("lr_spot_category", with_views(LR_BASE + """,
w AS (SELECT sample, barcode, lr, coalesce(max(CASE WHEN side = 'L' THEN value END), 0.0) AS lv,
             coalesce(max(CASE WHEN side = 'R' THEN value END), 0.0) AS rv FROM ce GROUP BY 1, 2, 3),
c AS (SELECT sample, lr, CASE WHEN lv > 0 AND rv > 0 THEN 'both' WHEN lv > 0 THEN 'ligand' ELSE 'receptor' END AS category
      FROM w),
cnt AS (SELECT sample, lr, category, count(*) AS n_spots FROM c GROUP BY 1, 2, 3),
ns AS (SELECT sample, count(*) AS n FROM spots GROUP BY 1)
SELECT sample, lr, category, n_spots FROM cnt
UNION ALL
SELECT s.sample, s.lr, 'neither', CAST(ns.n - s.seen AS BIGINT) FROM (SELECT sample, lr, sum(n_spots) AS seen FROM cnt GROUP BY 1, 2) s
JOIN ns USING (sample)""", V))
def lr_spot_category(spark, d):
    """Spots per LR in ligand-only / receptor-only / both / neither."""
    f = LRFlow(spark, d)
    return lrop.lr_category_counts(lrop.lr_spot_category(f.expr, f.lr_db, ce=f.ce()), f.spots)


@register("lr_significant_levels", with_views(NULL_SQL + f""",
w AS (SELECT sample, barcode, lr, coalesce(max(CASE WHEN side = 'L' THEN value END), 0.0) AS lv,
             coalesce(max(CASE WHEN side = 'R' THEN value END), 0.0) AS rv FROM ce GROUP BY 1, 2, 3)
SELECT sample, barcode, lr, round(lv, 6) AS ligand_value, round(rv, 6) AS receptor_value,
       CASE WHEN lv > 0 AND rv > 0 THEN 'both' WHEN lv > 0 THEN 'ligand' ELSE 'receptor' END AS category
FROM w SEMI JOIN (SELECT sample, barcode, lr FROM bh WHERE p_adj < {CUTOFF}) s USING (sample, barcode, lr)""", V))
def lr_significant_levels(spark, d):
    """Ligand and receptor level and category at the significant spots of every LR."""
    f = LRFlow(spark, d)
    sig = f.stats().filter("sig").select(*KEYS, "lr")
    w = lrop.lr_spot_category(f.expr, f.lr_db, ce=f.ce()).join(sig, KEYS + ["lr"], "left_semi")
    return finish(w.select(*KEYS, "lr", "ligand_value", "receptor_value", "category"))


@register("lr_measured", with_views("""
g AS (SELECT DISTINCT gene FROM expr_coarse WHERE value > 0)
SELECT lr FROM lr_db WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(ligand || receptor) AS gene) u
                                       WHERE u.gene NOT IN (SELECT gene FROM g))""", ["expr_coarse", "lr_db"]))
def lr_measured(spark, d):
    """LRs whose every ligand and receptor gene is measured."""
    f = LRFlow(spark, d)
    g = f.expr.filter(F.col("value") > 0).select("gene").distinct().withColumn("_m", F.lit(1))
    sub = lrop.lr_genes(f.lr_db).join(g, "gene", "left")
    ok = sub.groupBy("lr").agg(F.bool_and(F.col("_m").isNotNull()).alias("ok")).filter("ok")
    return ok.select("lr")


@register("lr_genes_distinct", with_views("""
SELECT DISTINCT gene FROM (SELECT unnest(ligand) AS gene FROM lr_db_all UNION ALL SELECT unnest(receptor) FROM lr_db_all) t""",
                                          ["lr_db_all"]))
def lr_genes_distinct(spark, d):
    """distinct genes over the ligand and receptor columns of every pairing."""
    return lrop.lr_genes(adapter.lr_db(spark, d, adapter.PAIRINGS)).select("gene").distinct()


@register("pathways_distinct", with_views("SELECT DISTINCT pathway FROM lr_db", ["lr_db"]))
def pathways_distinct(spark, d):
    """distinct pathways."""
    return adapter.lr_db(spark, d).select("pathway").distinct()


@register("lr_ids", with_views("""
SELECT lr, array_to_string(ligand, '_') || '_' || array_to_string(receptor, '_') AS lr_id FROM lr_db""", ["lr_db"]))
def lr_ids(spark, d):
    """K8: '_'-joined LR id column."""
    db = adapter.lr_db(spark, d)
    return db.select("lr", F.concat_ws("_", F.array_join("ligand", "_"), F.array_join("receptor", "_")).alias("lr_id"))
