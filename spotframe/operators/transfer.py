"""Label transfer, mutual nearest neighbours, identity override and deterministic subsampling
(SURVEY G11, G16, G17, G18).

G16 score(q, class) = sum over q's k nearest reference cells of class of w / sum of w,
    w = exp(-d^2 / (2 sigma^2)), sigma = distance to the k-th neighbour (sigma = 0 -> equal weights);
    predicted = best class (ties -> smallest name), max = its score.
G11 anchors = mutual k-nearest-neighbour pairs between two batches; the correction of a query
    cell is the Gaussian-weighted mean of (reference - query) anchor vectors over its nearest
    anchors (width = distance to the farthest of them).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.operators.graph import knn


def transfer_labels(ref: DataFrame, ref_labels: DataFrame, qry: DataFrame, k: int,
                    id_col: str = "barcode", vec: str = "vec", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Returns (scores (barcode, label, score), predictions (barcode, predicted, max_score))."""
    nn = knn(qry, k, id_col, vec, ref=ref)
    sig = nn.groupBy("src").agg(F.max("dist").alias("sigma"))
    w = F.when(F.col("sigma") > 0, F.exp(-(F.col("dist") * F.col("dist")) / (F.lit(2.0) * F.col("sigma") * F.col("sigma")))) \
        .otherwise(F.lit(1.0))
    lab = ref_labels.select(F.col(id_col).alias("dst"), F.col(label).alias("label"))
    t = nn.join(sig, "src").join(lab, "dst").withColumn("w", w)
    tot = t.groupBy("src").agg(F.sum("w").alias("_t"))
    sc = t.groupBy("src", "label").agg(F.sum("w").alias("_w")).join(tot, "src").select(
        F.col("src").alias(id_col), "label", (F.col("_w") / F.col("_t")).alias("score"))
    best = sc.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("ns"), F.col("label"))).alias("_b"))
    pred = best.select(id_col, F.col("_b.label").alias("predicted"), (-F.col("_b.ns")).alias("max_score"))
    return sc, pred


def mnn_pairs(a: DataFrame, b: DataFrame, k: int, id_col: str = "barcode", vec: str = "vec") -> DataFrame:
    """(a_id, b_id) pairs that are within each other's k nearest neighbours across batches."""
    ab = knn(a, k, id_col, vec, ref=b).select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"))
    ba = knn(b, k, id_col, vec, ref=a).select(F.col("dst").alias("a_id"), F.col("src").alias("b_id"))
    return ab.join(ba, ["a_id", "b_id"])


def integrate(ref: DataFrame, qry: DataFrame, anchors: DataFrame, n_anchor: int = 50,
              id_col: str = "barcode", vec: str = "vec") -> DataFrame:
    """Corrected query vectors = vec + Gaussian-weighted mean anchor correction."""
    rv = ref.select(F.col(id_col).alias("a_id"), F.col(vec).alias("ra"))
    qv = qry.select(F.col(id_col).alias("b_id"), F.col(vec).alias("qb"))
    diff = anchors.join(rv, "a_id").join(qv, "b_id").select(
        "b_id", F.zip_with("ra", "qb", lambda x, y: x - y).alias("delta"))
    per_anchor = diff.groupBy("b_id").agg(F.collect_list("delta").alias("_ds"))   # anchors of one cell: <= k
    dim = len(qry.select(vec).first()[0])
    mean_delta = per_anchor.select("b_id", F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.aggregate("_ds", F.lit(0.0), lambda acc, d: acc + d[i]) / F.size("_ds")).alias("delta"))
    anchor_cells = qry.join(mean_delta.select(F.col("b_id").alias(id_col)), id_col, "left_semi")
    nn = knn(qry, n_anchor, id_col, vec, ref=anchor_cells)
    width = nn.groupBy("src").agg(F.max("dist").alias("width"))
    w = F.when(F.col("width") > 0, F.exp(-(F.col("dist") / F.col("width")) * (F.col("dist") / F.col("width")))).otherwise(F.lit(1.0))
    t = nn.join(width, "src").join(mean_delta.withColumnRenamed("b_id", "dst"), "dst").withColumn("w", w)
    moved = array_to_vector(F.transform("delta", lambda d: F.col("w") * d))
    cv = t.groupBy("src").agg(vector_to_array(Summarizer.sum(moved)).alias("_s"), F.sum("w").alias("_w"))
    cv = cv.select("src", F.transform("_s", lambda s: s / F.col("_w")).alias("_c"))
    out = qry.select(F.col(id_col).alias("src"), F.col(vec).alias("v")).join(cv, "src", "left")
    fixed = F.when(F.col("_c").isNull(), F.col("v")).otherwise(
        F.zip_with("v", "_c", lambda x, y: x + y))
    return out.select(F.col("src").alias(id_col), fixed.alias(vec))


def set_identity(spots: DataFrame, anno: DataFrame | None, col: str = "cluster", keys=("sample", "barcode")) -> DataFrame:
    """Replace clusters with a supplied annotation (inner join) when given, else keep own."""
    if anno is None:
        return spots
    return spots.drop(col).join(anno.select(*keys, col), list(keys), "inner")


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Deterministic subsample of ``n`` rows: smallest md5 of the key (a distributed top-k)."""
    h = F.md5(F.concat_ws("/", *keys))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def harmonize(emb: DataFrame, batch: str, k: int, iters: int, sigma: float = 1.0, theta: float = 2.0,
              id_col: str = "barcode", vec: str = "vec") -> DataFrame:
    """Soft-cluster batch correction, fixed iterations.

    Responsibilities r_ck ~ exp(-|z_c - mu_k|^2 / sigma) * (E_kb / O_kb)^theta (diversity penalty from
    the previous responsibilities; E_kb = total_k * n_b / N), normalised per cell; then
    z_c <- z_c - sum_k r_ck (mu_{k,b(c)} - mu_k).  Start centroids: the k cells first in md5 order.
    Centroid tables are k x dims (broadcast); every other table is per cell or per (cell, k)."""
    from spotframe.session import cut_lineage
    e = emb.select(F.col(id_col).alias("id"), F.col(batch).alias("b"), F.col(vec).alias("z"))
    e = cut_lineage(e)
    n_all = e.count()
    nb = e.groupBy("b").agg((F.count("*") / F.lit(float(n_all))).alias("share"))
    first = e.withColumn("_h", F.md5("id")).orderBy("_h").limit(k)
    mu = first.withColumn("k", F.row_number().over(Window.orderBy("_h")) - 1).select("k", F.col("z").alias("mu"))
    ks = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")
    resp = None
    for _ in range(iters):
        mu = cut_lineage(mu)
        ck = e.select("id", "b", "z", ks).join(F.broadcast(mu), "k")
        d2 = F.aggregate(F.zip_with("z", "mu", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)
        ck = ck.withColumn("logit", -d2 / F.lit(sigma))
        if resp is not None:
            o = resp.groupBy("k", "b").agg(F.sum("r").alias("o"))
            tot = resp.groupBy("k").agg(F.sum("r").alias("t"))
            pen = o.join(tot, "k").join(F.broadcast(nb), "b").select(
                "k", "b", (F.lit(theta) * F.log((F.col("t") * F.col("share") + F.lit(1e-12)) / (F.col("o") + F.lit(1e-12)))).alias("pen"))
            ck = ck.join(F.broadcast(pen), ["k", "b"], "left").withColumn("logit", F.col("logit") + F.coalesce("pen", F.lit(0.0)))
        w = Window.partitionBy("id")
        ck = ck.withColumn("r", F.exp(F.col("logit") - F.max("logit").over(w)))
        ck = ck.withColumn("r", F.col("r") / F.sum("r").over(w))
        resp = cut_lineage(ck.select("id", "b", "k", "r", "z"))
        dims = F.posexplode("z").alias("j", "v")
        rz = resp.select("k", "b", "r", dims)
        mk = rz.groupBy("k", "j").agg((F.sum(F.col("r") * F.col("v")) / F.sum("r")).alias("m"))
        mkb = rz.groupBy("k", "b", "j").agg((F.sum(F.col("r") * F.col("v")) / F.sum("r")).alias("mb"))
        off = mkb.join(mk, ["k", "j"]).select("k", "b", "j", (F.col("mb") - F.col("m")).alias("off"))
        corr = (resp.select("id", "b", "k", "r").join(off, ["k", "b"])
                .groupBy("id", "j").agg(F.sum(F.col("r") * F.col("off")).alias("c")))
        cv = corr.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "c"))).alias("_c"))
        e = cut_lineage(e.join(cv, "id", "left").select(
            "id", "b", F.when(F.col("_c").isNull(), F.col("z")).otherwise(
                F.zip_with("z", F.transform("_c", lambda s: s["c"]), lambda x, y: x - y)).alias("z")))
        mu = mk.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("j", "m"))).alias("_m")).select(
            "k", F.transform("_m", lambda s: s["m"]).alias("mu"))
    return e.select(F.col("id").alias(id_col), F.col("b").alias(batch), F.col("z").alias(vec))
