"""Overlap enrichment, composition-cluster enrichment and co-occurrence statistics
(SURVEY I1, I2, K3-K8).

Hypergeometric tails are Column expressions (``spotframe.functions.stats``):
P(X >= k) and P(X <= k) for X ~ Hypergeometric(N, K, n); expected = K n / N.
All pair tables are joins of small per-group lists (group x group or type x type
inside one cluster), never a product over spots or genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.stats import hyper_lower, hyper_upper
from spotframe.operators.tables import levels
from spotframe.session import stage

KEYS = ["sample", "barcode"]


def prepare_marker_list(markers: DataFrame, prefix: str, group: str = "cluster", min_fc: float | None = None,
                        max_padj: float | None = None, min_d: float | None = None,
                        max_p: float | None = None) -> DataFrame:
    """Filter (fc, p_adj or raw p, d = pct_1 - pct_2) and prefix the group name; returns
    (group, gene, avg_log2fc): sort by the last two where the list is written out (E2)."""
    cond = F.lit(True)
    if max_p is not None:
        cond = cond & (F.col("p_val") < max_p)
    if min_fc is not None:
        cond = cond & (F.col("avg_log2fc") > min_fc)
    if max_padj is not None:
        cond = cond & (F.col("p_val_adj") < max_padj)
    if min_d is not None:
        cond = cond & ((F.col("pct_1") - F.col("pct_2")) > min_d)
    m = markers.filter(cond)
    return m.select(F.concat(F.lit(prefix), F.col(group).cast("string")).alias("group"), "gene", "avg_log2fc")


def marker_overlap(region: DataFrame, ctype: DataFrame, n_genes: int) -> DataFrame:
    """Every (region, cell type) pair with overlap size k (0 kept), set sizes, expected,
    upper / lower hypergeometric tails, -log10 p and a signed score (negative = depletion)."""
    r = region.select(F.col("group").alias("region"), "gene").distinct()
    t = ctype.select(F.col("group").alias("cell_type"), "gene").distinct()
    rs = r.groupBy("region").agg(F.count("*").alias("n_a"))
    types = t.groupBy("cell_type").agg(F.count("*").alias("n_b"))
    # the result has a row per (region, cell type): the types travel to the regions as one array
    one = types.agg(F.collect_list(F.struct("cell_type", "n_b")).alias("_t")).withColumn("_one", F.lit(0))
    grid = rs.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").select("region", "n_a", F.explode("_t").alias("t"))
    grid = grid.select("region", "n_a", "t.cell_type", "t.n_b")
    ov = r.join(t, "gene").groupBy("region", "cell_type").agg(F.count("*").alias("k"))
    g = grid.join(ov, ["region", "cell_type"], "left").fillna(0, ["k"])
    N = F.lit(int(n_genes))
    up = hyper_upper(F.col("k"), N, F.col("n_a"), F.col("n_b"))
    low = hyper_lower(F.col("k"), N, F.col("n_a"), F.col("n_b"))
    g = g.select("region", "cell_type", "k", "n_a", "n_b",
                 (F.col("n_a") * F.col("n_b") / F.lit(float(n_genes))).alias("expected"),
                 up.alias("p_upper"), low.alias("p_lower"))
    score = F.when(F.col("p_lower") < F.col("p_upper"), F.log10("p_lower")).otherwise(-F.log10("p_upper"))
    return g.withColumn("neg_log10_p", -F.log10("p_upper")).withColumn("score", score)


def cc_enrichment(composition: DataFrame, labels: DataFrame, group: str = "cc") -> DataFrame:
    """K3: mean share of each cell type inside each composition cluster vs overall,
    log2((in + 1e-9) / (all + 1e-9)), enriched when > 0, ranked within the cluster."""
    lab = labels.select(*KEYS, F.col(group).alias("cc"))
    n_cc = lab.groupBy("cc").agg(F.count("*").alias("n_cc"))
    n_all = lab.count()
    c = composition.join(lab, KEYS)
    s_in = c.groupBy("cc", "cell_type").agg(F.sum("score").alias("_s"))
    s_all = c.groupBy("cell_type").agg((F.sum("score") / F.lit(float(n_all))).alias("mean_all"))
    t = s_in.join(n_cc, "cc").join(s_all, "cell_type")
    t = t.select("cc", "cell_type", (F.col("_s") / F.col("n_cc")).alias("mean_in"), "mean_all")
    t = t.withColumn("log2_ratio", F.log2((F.col("mean_in") + F.lit(1e-9)) / (F.col("mean_all") + F.lit(1e-9))))
    w = Window.partitionBy("cc").orderBy(F.desc("log2_ratio"), "cell_type")
    return t.withColumn("enriched", F.col("log2_ratio") > 0).withColumn("rank", F.row_number().over(w))


def _pairs_stats(present: DataFrame, lab: DataFrame, item: str, sig: float) -> DataFrame:
    """Co-occurrence of item pairs a < b within each cluster."""
    p = present.join(lab, KEYS).select(*KEYS, "cc", F.col(item).alias("item"))
    n_cc = lab.groupBy("cc").agg(F.count("*").alias("n_total"))
    cnt = p.groupBy("cc", "item").agg(F.count("*").alias("c"))
    a = cnt.select("cc", F.col("item").alias("a"), F.col("c").alias("n_a"))
    b = cnt.select("cc", F.col("item").alias("b"), F.col("c").alias("n_b"))
    pairs = a.join(b, "cc").filter(F.col("a") < F.col("b"))
    pa = p.select(*KEYS, "cc", F.col("item").alias("a"))
    pb = p.select(*KEYS, "cc", F.col("item").alias("b"))
    both = pa.join(pb, KEYS + ["cc"]).filter(F.col("a") < F.col("b")).groupBy("cc", "a", "b").agg(
        F.count("*").alias("k"))
    t = pairs.join(both, ["cc", "a", "b"], "left").fillna(0, ["k"]).join(n_cc, "cc")
    return _with_tails(t, sig)


def _with_tails(t: DataFrame, sig: float) -> DataFrame:
    t = t.select("cc", "a", "b", "k", "n_a", "n_b", "n_total",
                 (F.col("n_a") * F.col("n_b") / F.col("n_total")).alias("expected"),
                 hyper_lower(F.col("k"), F.col("n_total"), F.col("n_a"), F.col("n_b")).alias("p_le"),
                 hyper_upper(F.col("k"), F.col("n_total"), F.col("n_a"), F.col("n_b")).alias("p_ge"))
    call = (F.when(F.col("p_ge") < sig, F.lit("positive"))
            .when(F.col("p_le") < sig, F.lit("negative")).otherwise(F.lit("random")))
    return t.withColumn("call", call)


def cooccurrence(composition: DataFrame, labels: DataFrame, threshold: float, group: str = "cc",
                 sig: float = 0.05) -> DataFrame:
    """K4: cell-type co-occurrence per composition cluster; presence = share > ``threshold``."""
    lab = labels.select(*KEYS, F.col(group).alias("cc"))
    present = composition.filter(F.col("score") > F.lit(threshold)).select(*KEYS, "cell_type")
    return _pairs_stats(present, lab, "cell_type", sig)


#: tasks that share the tails of ``enriched_lrs``
TAIL_TASKS = 64


def enriched_lrs(ce: DataFrame, labels: DataFrame, min_expr: float = 1.0, max_p: float = 0.2,
                 group: str = "cc") -> DataFrame:
    """K5: per cluster and LR, co-occurrence of ligand (complex level >= min_expr) and receptor
    presence in the cluster's spots; LRs kept at P(X >= k) < max_p.  ``ce`` is the complex
    expression table (sample, barcode, lr, side, value)."""
    lab = labels.select(*KEYS, F.col(group).alias("cc"))
    n_cc = lab.groupBy("cc").agg(F.count("*").alias("n_total"))
    pres = ce.filter(F.col("value") >= F.lit(min_expr)).join(lab, KEYS)
    lig = pres.filter(F.col("side") == "L").select(*KEYS, "cc", "lr")
    rec = pres.filter(F.col("side") == "R").select(*KEYS, "cc", "lr")
    na = lig.groupBy("cc", "lr").agg(F.count("*").alias("n_a"))
    nb = rec.groupBy("cc", "lr").agg(F.count("*").alias("n_b"))
    k = lig.join(rec, KEYS + ["cc", "lr"]).groupBy("cc", "lr").agg(F.count("*").alias("k"))
    t = na.join(nb, ["cc", "lr"]).join(k, ["cc", "lr"], "left").fillna(0, ["k"]).join(n_cc, "cc")
    t = t.repartition(TAIL_TASKS).withColumn(
        "p_ge", hyper_upper(F.col("k"), F.col("n_total"), F.col("n_a"), F.col("n_b")))
    # one row per cluster and LR, dealt out since each is a long sum; written out so that no filter repeats it
    return stage(t).filter(F.col("p_ge") < F.lit(max_p))


SPOTS_PER_BUCKET = 1 << 18


def presence_bitmaps(present: DataFrame, labels: DataFrame, item: str, group: str = "cc") -> DataFrame:
    """(cc, item, bucket, word, bits): the spots of every cluster that hold an item, 64 to a word.

    Spots are numbered within hash buckets of about ``SPOTS_PER_BUCKET``, so that no task
    numbers a whole cluster; repeated rows of a spot and item set the same bit."""
    lab = labels.select(*KEYS, F.col(group).alias("cc")).distinct()
    buckets = lab.count() // SPOTS_PER_BUCKET + 1
    lab = lab.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("cc", "bucket").orderBy(*KEYS)) - 1
    lab = lab.withColumn("place", place).select(
        *KEYS, "cc", "bucket", F.expr("place div 64").cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    rows = present.select(*KEYS, F.col(item).alias("item")).join(lab, KEYS)
    return rows.groupBy("cc", "item", "bucket", "word").agg(F.bit_or("bit").alias("bits"))


def cooccurrence_of(present: DataFrame, labels: DataFrame, pairs: DataFrame, item: str, group: str = "cc",
                    sig: float = 0.05) -> DataFrame:
    """K8 -> K4 for stated ``pairs(a, b)`` of items: (cc, a, b, k, n_a, n_b, n_total, expected, p_le, p_ge,
    call) wherever both occur in the cluster.  Intersections are popcounts of and-ed words, so a
    pair costs a row for 64 spots, and only stated pairs are met, never all pairs of items."""
    pairs = pairs.select("a", "b").distinct()
    items = pairs.select(F.explode(F.array("a", "b")).alias(item)).distinct()
    bits = stage(presence_bitmaps(present.join(items, item, "left_semi"), labels, item, group))
    count = bits.groupBy("cc", "item").agg(F.sum(F.bit_count("bits")).alias("c"))
    n_cc = labels.select(*KEYS, F.col(group).alias("cc")).distinct().groupBy("cc").agg(F.count("*").alias("n_total"))
    side = lambda t, name, *cols: t.select("cc", F.col("item").alias(name), *cols)
    k = (side(bits, "a", "bucket", "word", F.col("bits").alias("bits_a")).join(pairs, "a")
         .join(side(bits, "b", "bucket", "word", F.col("bits").alias("bits_b")), ["cc", "b", "bucket", "word"])
         .groupBy("cc", "a", "b").agg(F.sum(F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b")))).alias("k")))
    t = (side(count, "a", F.col("c").alias("n_a")).join(pairs, "a").join(side(count, "b", F.col("c").alias("n_b")), ["cc", "b"])
         .join(k, ["cc", "a", "b"], "left").fillna(0, ["k"]).join(n_cc, "cc"))
    return _with_tails(t, sig)


def diff_lrs(enr: DataFrame, a: str, b: str, p_in: float = 0.05, p_out: float = 0.1) -> DataFrame:
    """K6: LRs with p < p_in in cluster a and not p < p_out in cluster b (side 'a'), and the reverse."""
    ea = enr.filter(F.col("cc") == a).select("lr", F.col("p_ge").alias("p_a"))
    eb = enr.filter(F.col("cc") == b).select("lr", F.col("p_ge").alias("p_b"))
    j = ea.join(eb, "lr", "full")
    only_a = (F.col("p_a") < p_in) & ~F.coalesce(F.col("p_b") < p_out, F.lit(False))
    only_b = (F.col("p_b") < p_in) & ~F.coalesce(F.col("p_a") < p_out, F.lit(False))
    return (j.withColumn("side", F.when(only_a, F.lit(a)).when(only_b, F.lit(b)))
             .filter(F.col("side").isNotNull()))


def chord_table(pairs: DataFrame, n: int = 20) -> DataFrame:
    """K7: top-n co-occurring pairs (k desc, p_ge asc, names) for a chord diagram."""
    return pairs.orderBy(F.desc("k"), F.asc("p_ge"), "cc", "a", "b").limit(n)


def sankey_table(enr_a: DataFrame, enr_b: DataFrame, lr_db: DataFrame, a: str, b: str) -> DataFrame:
    """K7: ligand -> receptor flows of two clusters' enriched LRs, tagged with the side."""
    names = lr_db.select("lr", F.array_join("ligand", "+").alias("ligand"), F.array_join("receptor", "+").alias("receptor"))
    fa = enr_a.select("lr").distinct().withColumn("side", F.lit(a))
    fb = enr_b.select("lr").distinct().withColumn("side", F.lit(b))
    return fa.unionByName(fb).join(names, "lr").groupBy("side", "ligand", "receptor").agg(F.count("*").alias("n"))


def cluster_names(labels: DataFrame, col: str) -> list:
    return levels(labels, col)
