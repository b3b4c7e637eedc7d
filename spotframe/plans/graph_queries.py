"""Neighbour graphs, graph clustering, label transfer, anchors, PCA and subsampling.

Embeddings: the driver's ``embeddings`` table (64-d), batch B0 / B1 = vec_id % 2;
B0 is the labelled reference, B1 the query.  k = 10 (20 for anchors).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spotframe.operators import composition as cp
from spotframe.operators import embed as em
from spotframe.operators import graph as gr
from spotframe.operators import normalize as nm
from spotframe.operators import transfer as tf
from spotframe.operators import views as vw
from spotframe.plans.catalog import finish, register
from spotframe.plans.marker_queries import prepared
from spotframe.plans.model_queries import ViewFlow
from spotframe.plans.oracle_views import with_views
from spotframe.session import stage
from spotframe.sources import adapter

K = 10
K_ANCHOR = 20
PRUNE = 1.0 / 15
RESOLUTION = 0.8
SWEEPS = 4
N_HVG = 3000
N_PCS = 100
V_E = ["embedding"]

KNN_SQL = f"""
e AS (SELECT barcode, vec FROM embedding),
pairs AS (SELECT a.barcode AS src, b.barcode AS dst, list_distance(a.vec, b.vec) AS dist
          FROM e a JOIN e b ON a.barcode <> b.barcode),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs)
       WHERE rank <= {K})"""


def _emb(spark, d):
    return stage(adapter.embedding(spark, d))


@register("knn_graph", with_views(KNN_SQL + """
SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM kn""", V_E))
def knn_graph(spark, d):
    """Exact 10-nearest-neighbour graph of all embedded cells (projection-pruned band join)."""
    return finish(gr.knn(_emb(spark, d), K))


@register("knn_graph_cosine", with_views(f"""
e AS (SELECT barcode, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM embedding),
pairs AS (SELECT a.barcode AS src, b.barcode AS dst, 1 - list_dot_product(a.vec, b.vec) / (a.norm * b.norm) AS dist
          FROM e a JOIN e b ON a.barcode <> b.barcode WHERE a.norm > 0 AND b.norm > 0)
SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs) WHERE rank <= {K}""", V_E))
def knn_graph_cosine(spark, d):
    """Exact 10 nearest neighbours of all embedded cells by the angle between them."""
    return finish(gr.knn(_emb(spark, d), K, metric="cosine"))


SNN_SQL = KNN_SQL + f""",
nb AS (SELECT src, list_distinct(list(dst) || [src]) AS nset FROM kn GROUP BY src),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM kn),
t AS (SELECT u.a, u.b, len(list_intersect(x.nset, y.nset))::DOUBLE AS c FROM und u
      JOIN nb x ON x.src = u.a JOIN nb y ON y.src = u.b),
w AS (SELECT a, b, c / ({2.0 * K!r} - c) AS weight FROM t WHERE c / ({2.0 * K!r} - c) >= {PRUNE!r}),
snn AS (SELECT a AS src, b AS dst, weight FROM w UNION ALL SELECT b, a, weight FROM w)"""


UNIT_EDGES = """,
ge AS (SELECT DISTINCT src, dst, 1.0::DOUBLE AS weight FROM (SELECT src, dst FROM kn UNION ALL SELECT dst, src FROM kn) t)"""
SNN_EDGES = """,
ge AS (SELECT src, dst, weight FROM snn)"""


def _lm_ctes(resolution: float, sweeps: int, ge: str = "ge", p: str = "") -> str:
    """Unrolled SQL twin of graph.local_moving on edges ``ge``; names carry prefix ``p``."""
    parts = [f""",
{p}deg AS (SELECT src AS node, sum(weight) AS kv FROM {ge} GROUP BY 1),
{p}m2 AS (SELECT sum(weight) AS m2 FROM {ge}),
{p}lab0 AS (SELECT node, node AS label FROM {p}deg)"""]
    g = repr(float(resolution))
    for s in range(sweeps):
        parts.append(f""",
{p}kc{s} AS (SELECT l.label, sum(d.kv) AS kc FROM {p}lab{s} l JOIN {p}deg d USING (node) GROUP BY 1),
{p}wvc{s} AS (SELECT e.src AS node, l.label AS c, sum(e.weight) AS w FROM {ge} e JOIN {p}lab{s} l ON l.node = e.dst
              WHERE e.src <> e.dst GROUP BY 1, 2),
{p}cand{s} AS (SELECT w.node, w.c, cur.label AS own,
                   w.w - {g} * d.kv * (CASE WHEN w.c = cur.label THEN k.kc - d.kv ELSE k.kc END) / m2.m2 AS gain
            FROM {p}wvc{s} w JOIN {p}lab{s} cur ON cur.node = w.node JOIN {p}deg d ON d.node = w.node
            JOIN {p}kc{s} k ON k.label = w.c CROSS JOIN {p}m2 m2),
{p}best{s} AS (SELECT node, c AS c_best, gain AS g_best FROM
            (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, c) AS r FROM {p}cand{s}) WHERE r = 1),
{p}og{s} AS (SELECT node, gain AS g_own FROM {p}cand{s} WHERE c = own),
{p}al{s} AS (SELECT l.node, -{g} * d.kv * (k.kc - d.kv) / m2.m2 AS g_alone FROM {p}lab{s} l JOIN {p}deg d USING (node)
          JOIN {p}kc{s} k ON k.label = l.label CROSS JOIN {p}m2 m2),
{p}lab{s + 1} AS (SELECT l.node,
                 CASE WHEN (instr('0123456789abcdef', substr(md5(l.node || ':{s}'), 1, 1)) - 1) % 2 = 0
                           AND b.c_best IS NOT NULL AND b.g_best > coalesce(o.g_own, a.g_alone) AND b.c_best <> l.label
                      THEN b.c_best ELSE l.label END AS label
               FROM {p}lab{s} l LEFT JOIN {p}best{s} b USING (node) LEFT JOIN {p}og{s} o USING (node) LEFT JOIN {p}al{s} a USING (node))""")
    return "".join(parts)


def _lm_sql(resolution: float, sweeps: int, base: str = None, edges: str = None, node: str = "barcode",
            levels: int = 1) -> str:
    """SQL twin of graph_clusters (default: unit-weight symmetrised kNN graph)."""
    base = KNN_SQL if base is None else base
    edges = UNIT_EDGES if edges is None else edges
    body = base + edges + _lm_ctes(resolution, sweeps) + f""",
final1 AS (SELECT node, label FROM lab{sweeps})"""
    ge = "ge"
    for n in range(2, levels + 1):
        body += f""",
ge{n} AS (SELECT a.label AS src, b.label AS dst, sum(e.weight) AS weight FROM {ge} e
          JOIN {"lab" if n == 2 else f"l{n - 1}_lab"}{sweeps} a ON a.node = e.src
          JOIN {"lab" if n == 2 else f"l{n - 1}_lab"}{sweeps} b ON b.node = e.dst GROUP BY 1, 2)"""
        ge = f"ge{n}"
        body += _lm_ctes(resolution, sweeps, ge, f"l{n}_") + f""",
final{n} AS (SELECT f.node, u.label FROM final{n - 1} f JOIN l{n}_lab{sweeps} u ON u.node = f.label)"""
    return body + f""",
sz AS (SELECT label, count(*) AS n FROM final{levels} GROUP BY 1),
ord AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS VARCHAR) AS cluster FROM sz)
SELECT l.node AS {node}, o.cluster FROM final{levels} l JOIN ord o USING (label)"""


@register("snn_graph", with_views(SNN_SQL + """
SELECT src, dst, round(weight, 6) AS weight FROM snn""", V_E))
def snn_graph(spark, d):
    """G13 -> G14: shared-nearest-neighbour weights on the kNN edges, pruned below 1/15."""
    nn = stage(gr.knn(_emb(spark, d), K))
    return finish(gr.snn(nn, K, PRUNE))


@register("graph_clusters", with_views(_lm_sql(RESOLUTION, SWEEPS, SNN_SQL, SNN_EDGES), V_E))
def graph_clusters(spark, d):
    """G13 -> G14 -> G15: modularity clusters (resolution 0.8, 4 synchronous sweeps)."""
    nn = stage(gr.knn(_emb(spark, d), K))
    s = stage(gr.snn(nn, K, PRUNE))
    return gr.graph_clusters(s, RESOLUTION, SWEEPS).withColumnRenamed("node", "barcode")


@register("graph_clusters_multilevel", with_views(_lm_sql(RESOLUTION, SWEEPS, SNN_SQL, SNN_EDGES, levels=3), V_E))
def graph_clusters_multilevel(spark, d):
    """G13 -> G14 -> G15: modularity clusters over three levels of contracted communities."""
    nn = stage(gr.knn(_emb(spark, d), K))
    s = stage(gr.snn(nn, K, PRUNE))
    return gr.graph_clusters(s, RESOLUTION, SWEEPS, levels=3).withColumnRenamed("node", "barcode")


def _ref_qry(spark, d):
    e = _emb(spark, d)
    return e.filter(F.col("sample") == "B0"), e.filter(F.col("sample") == "B1")


TRANSFER_SQL = f"""
ref AS (SELECT barcode, vec, label FROM embedding WHERE sample = 'B0'),
qry AS (SELECT barcode, vec FROM embedding WHERE sample = 'B1'),
pairs AS (SELECT q.barcode AS src, r.barcode AS dst, r.label, list_distance(q.vec, r.vec) AS dist FROM qry q CROSS JOIN ref r),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rk FROM pairs) WHERE rk <= {K}),
sg AS (SELECT src, max(dist) AS sigma FROM nn GROUP BY src),
w AS (SELECT nn.src, nn.label, CASE WHEN sg.sigma > 0 THEN exp(-(dist * dist) / (2.0 * sigma * sigma)) ELSE 1.0 END AS w
      FROM nn JOIN sg USING (src)),
tot AS (SELECT src, sum(w) AS t FROM w GROUP BY src),
sc AS (SELECT w.src AS barcode, w.label, sum(w.w) / max(tot.t) AS score FROM w JOIN tot USING (src) GROUP BY 1, 2)"""


@register("transfer_scores", with_views(TRANSFER_SQL + """
SELECT barcode, label, round(score, 6) AS score FROM sc""", V_E))
def transfer_scores(spark, d):
    """Per query cell and reference class, Gaussian-weighted share of its 10 nearest reference cells."""
    ref, qry = _ref_qry(spark, d)
    sc, _ = tf.transfer_labels(ref, ref, qry, K)
    return finish(sc)


@register("transfer_predictions", with_views(TRANSFER_SQL + """
SELECT barcode, label AS predicted, round(score, 6) AS max_score FROM
  (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY score DESC, label) AS r FROM sc) WHERE r = 1""", V_E))
def transfer_predictions(spark, d):
    """Predicted class and its score ('max') per query cell."""
    ref, qry = _ref_qry(spark, d)
    _, pred = tf.transfer_labels(ref, ref, qry, K)
    return finish(pred)


@register("mnn_pairs", with_views(f"""
a AS (SELECT barcode, vec FROM embedding WHERE sample = 'B0'),
b AS (SELECT barcode, vec FROM embedding WHERE sample = 'B1'),
ab AS (SELECT * FROM (SELECT a.barcode AS a_id, b.barcode AS b_id,
                             row_number() OVER (PARTITION BY a.barcode ORDER BY list_distance(a.vec, b.vec), b.barcode) AS r
                      FROM a CROSS JOIN b) WHERE r <= {K_ANCHOR}),
ba AS (SELECT * FROM (SELECT a.barcode AS a_id, b.barcode AS b_id,
                             row_number() OVER (PARTITION BY b.barcode ORDER BY list_distance(a.vec, b.vec), a.barcode) AS r
                      FROM a CROSS JOIN b) WHERE r <= {K_ANCHOR})
SELECT ab.a_id, ab.b_id FROM ab JOIN ba USING (a_id, b_id)""", V_E))
def mnn_pairs(spark, d):
    """Mutual 20-nearest-neighbour anchor pairs between batches B0 and B1."""
    ref, qry = _ref_qry(spark, d)
    return tf.mnn_pairs(ref, qry, K_ANCHOR)


@register("integrate_batches")
def integrate_batches(spark, d):
    """Batch B1 corrected toward B0 by Gaussian-weighted anchor corrections (vector norms)."""
    ref, qry = _ref_qry(spark, d)
    anchors = stage(tf.mnn_pairs(ref, qry, K_ANCHOR))
    fixed = tf.integrate(ref, qry, anchors, 50)
    return finish(fixed.select("barcode", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")))


@register("set_identity", with_views("""
anno AS (SELECT 'S' || CAST(c_custkey % 6 AS VARCHAR) AS sample, CAST(c_custkey AS VARCHAR) AS barcode,
                'T' || CAST(c_nationkey % 5 AS VARCHAR) AS cluster FROM customer WHERE c_custkey % 2 = 0)
SELECT s.sample, s.barcode, a.cluster FROM spots s JOIN anno a USING (sample, barcode)""", ["spots"]))
def set_identity(spark, d):
    """Clusters replaced by a supplied annotation (inner join on the annotated spots)."""
    c = adapter.table(spark, d, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.concat(F.lit("S"), (F.col("c_custkey") % 6).cast("string")).alias("sample"),
        F.col("c_custkey").cast("string").alias("barcode"),
        F.concat(F.lit("T"), (F.col("c_nationkey") % 5).cast("string")).alias("cluster"))
    return tf.set_identity(adapter.spots(spark, d), c).select("sample", "barcode", "cluster")


@register("hash_sample", with_views("""
SELECT sample, barcode, cluster FROM spots ORDER BY md5(sample || '/' || barcode), sample, barcode LIMIT 300""", ["spots"]))
def hash_sample(spark, d):
    """Deterministic 300-spot subsample (smallest md5 of the key)."""
    return tf.hash_sample(adapter.spots(spark, d).select("sample", "barcode", "cluster"), ["sample", "barcode"], 300)


def _pca(spark, d):
    norm, labels = prepared(spark, d)
    n = labels.count()
    hv = [r["gene"] for r in nm.hvg_vst(norm, n, N_HVG).collect()]   # bounded: N_HVG genes
    z, absent = nm.scale_genes(norm, n, genes=F.broadcast(spark.createDataFrame([(g,) for g in hv], "gene string")))
    return em.pca(z, sorted(hv), N_PCS, cells=labels, absent=absent), labels


@register("pca_stdev")
def pca_stdev(spark, d):
    """G5 -> G7 -> G8: standard deviation of the first 100 principal components (3000 variable genes)."""
    res, _ = _pca(spark, d)
    return finish(res["stdev"])


@register("choose_pcs")
def choose_pcs(spark, d):
    """G8 -> G9: power-law fit of the PC stdevs and the chosen PC count in [5, 20]."""
    res, _ = _pca(spark, d)
    return finish(em.choose_pcs(stage(res["stdev"])))


@register("top_loadings")
def top_loadings(spark, d):
    """G8 -> G10: top-10 genes per principal component by |loading|."""
    res, _ = _pca(spark, d)
    return finish(em.top_loadings(res["loadings"], 10))


@register("pca_clusters")
def pca_clusters(spark, d):
    """G8 -> G9 -> G13 -> G14 -> G15: spot clusters from the chosen components of the PCA embedding."""
    res, _ = _pca(spark, d)
    chosen = em.choose_pcs(res["stdev"]).first()["n_chosen"]         # one number
    emb = stage(res["embedding"].select(F.concat_ws("/", "sample", "barcode").alias("barcode"),
                                        F.slice("vec", 1, chosen).alias("vec")))
    nn = stage(gr.knn(emb, K))
    return gr.graph_clusters(stage(gr.snn(nn, K, PRUNE)), RESOLUTION, SWEEPS).withColumnRenamed("node", "spot")


REGION_BASE = f"""
ty AS (SELECT DISTINCT cell_type FROM composition),
sp AS (SELECT DISTINCT sample, barcode FROM composition),
dv AS (SELECT s.sample || '/' || s.barcode AS barcode, list(coalesce(c.score, 0.0) ORDER BY t.cell_type) AS vec
       FROM sp s CROSS JOIN ty t LEFT JOIN composition c
         ON c.sample = s.sample AND c.barcode = s.barcode AND c.cell_type = t.cell_type GROUP BY 1),
pairs AS (SELECT a.barcode AS src, b.barcode AS dst, list_distance(a.vec, b.vec) AS dist
          FROM dv a JOIN dv b ON a.barcode <> b.barcode),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pairs)
       WHERE rank <= {K}),
nb AS (SELECT src, list_distinct(list(dst) || [src]) AS nset FROM kn GROUP BY src),
und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM kn),
t AS (SELECT u.a, u.b, len(list_intersect(x.nset, y.nset))::DOUBLE AS c FROM und u
      JOIN nb x ON x.src = u.a JOIN nb y ON y.src = u.b),
w AS (SELECT a, b, c / ({2.0 * K!r} - c) AS weight FROM t WHERE c / ({2.0 * K!r} - c) >= {PRUNE!r}),
snn AS (SELECT a AS src, b AS dst, weight FROM w UNION ALL SELECT b, a, weight FROM w)"""


def _regions_sql() -> str:
    q = _lm_sql(RESOLUTION, SWEEPS, REGION_BASE, SNN_EDGES, node="spot")
    # cluster names carry the region prefix
    return q.replace("CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS VARCHAR) AS cluster",
                     "'R' || CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS VARCHAR) AS cluster")


@register("regions", with_views(_regions_sql(), ["composition"]))
def regions(spark, d):
    """regions = kNN graph + clustering on the spot abundance (composition) vectors."""
    return gr.graph_clusters(_region_graph(spark, d, K), RESOLUTION, SWEEPS, prefix="R").withColumnRenamed("node", "spot")


def _region_graph(spark, d, k):
    comp = stage(adapter.composition(spark, d))
    types = sorted(r[0] for r in comp.select("cell_type").distinct().collect())
    v = em.dense_vectors(comp.select("sample", "barcode", F.col("cell_type").alias("gene"), F.col("score").alias("value")),
                         types)
    emb = stage(v.select(F.concat_ws("/", "sample", "barcode").alias("barcode"), "vec"))
    nn = stage(gr.knn(emb, k))
    return stage(gr.snn(nn, k, PRUNE))


@register("interaction_communities")
def interaction_communities(spark, d):
    """J5 -> J6: communities of the predictor-target graph with standardised importance >= 0.5 (per view)."""
    imp = ViewFlow(spark, d).results()["importance"]
    z = vw.interactions(imp, 0.5)
    agg = vw.collect_results(z, ["block", "target", "feature"], "z")
    e = agg.select("block", F.col("feature").alias("src"), F.col("target").alias("dst"), F.col("z").alias("weight"))
    und = e.unionByName(e.select("block", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    und = stage(und.groupBy("block", "src", "dst").agg(F.sum("weight").alias("weight")))
    return gr.graph_clusters(und, 1.0, SWEEPS, by=["block"])


@register("knn_graph_clusters", with_views(_lm_sql(1.0, SWEEPS), V_E))
def knn_graph_clusters(spark, d):
    """G13 -> G15: modularity clusters (resolution 1, 4 sweeps) of the unit-weight symmetrised 10-NN graph."""
    nn = gr.knn(_emb(spark, d), K)
    und = nn.select("src", "dst").unionByName(nn.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = stage(und.distinct().withColumn("weight", F.lit(1.0)))
    return gr.graph_clusters(e, 1.0, SWEEPS).withColumnRenamed("node", "barcode")


@register("harmonize_batches")
def harmonize_batches(spark, d):
    """Soft-cluster batch correction of the embeddings (k = 5 centroids, 3 iterations);
    per-batch mean of each corrected coordinate."""
    e = _emb(spark, d)
    h = tf.harmonize(e.select("barcode", "sample", "vec"), "sample", 5, 3, sigma=1.0, theta=2.0)
    return finish(h.select("sample", F.posexplode("vec").alias("dim", "v")).groupBy("sample", "dim").agg(
        F.avg("v").alias("mean")))
