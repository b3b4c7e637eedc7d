"""Ligand-receptor neighbourhood analysis.

Definitions (SURVEY 2.12-5, -20, -21):
  complex level      min over subunits; an absent subunit makes the complex 0
  score(i)           1/2 [L_i 1(mR_i>0) + 1(L_i>0) mR_i + R_i 1(mL_i>0) + 1(R_i>0) mL_i]
                     with mX_i the mean of X over the neighbours of i (self excluded)
  null               random gene pairs: genes outside the catalogue binned by mean expression
                     (exact deciles), pair k of bin combination (bl, br) picks its genes with a
                     portable LCG; p = (1 + #{null >= observed}) / (1 + n_null) per spot and LR
  CCI                significant spot i with L_i > 0, j in N(i) u {i} with R_j > 0: count distinct i
                     per (sender type of i, receiver type of j), types with share > cut-off

Everything stays sparse: only spots with a non-zero score are tested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from spotframe.functions.ranks import exact_percentile
from spotframe.functions.stats import lcg
from spotframe.operators.ranking import bh_adjust
from spotframe.session import cut_lineage, ship_library

KEYS = ["sample", "barcode"]


def lr_genes(lr_db: DataFrame) -> DataFrame:
    """(lr, side, gene, n_sub): one row per subunit."""
    lig = lr_db.select("lr", F.lit("L").alias("side"), F.explode("ligand").alias("gene"),
                       F.size("ligand").alias("n_sub"))
    rec = lr_db.select("lr", F.lit("R").alias("side"), F.explode("receptor").alias("gene"),
                       F.size("receptor").alias("n_sub"))
    return lig.unionByName(rec)


def _lr_sides(lr_db: DataFrame) -> DataFrame:
    """(lr, side, subunits): two rows per LR."""
    return (lr_db.select("lr", F.lit("L").alias("side"), F.col("ligand").alias("subunits"))
            .unionByName(lr_db.select("lr", F.lit("R").alias("side"), F.col("receptor").alias("subunits"))))


def complex_expression(expr: DataFrame, lr_db: DataFrame) -> DataFrame:
    """(sample, barcode, lr, side, value) = min over subunits; rows only where every subunit > 0."""
    # sides recur in many LRs: each distinct list of subunits is evaluated once, then named
    sides = _lr_sides(lr_db)
    g = sides.select("subunits", F.explode("subunits").alias("gene")).distinct()
    j = expr.filter(F.col("value") > 0).join(F.broadcast(g), "gene")      # subunits of the catalogue
    per = j.groupBy(*KEYS, "subunits").agg(F.count("*").alias("_n"), F.min("value").alias("value"))
    per = per.filter(F.col("_n") == F.size(F.array_distinct("subunits")))
    return per.join(F.broadcast(sides), "subunits").select(*KEYS, "lr", "side", "value")


def lr_filter_pct(expr: DataFrame, lr_db: DataFrame, n_spots: int, min_pct: float = 0.05) -> DataFrame:
    """Keep LRs whose every subunit is expressed in at least ``min_pct`` of the spots."""
    g = lr_genes(lr_db)
    share = expr.filter(F.col("value") > 0).groupBy("gene").agg(
        (F.count("*") / F.lit(float(n_spots))).alias("share"))
    t = g.join(share, "gene", "left").fillna(0.0, ["share"])
    ok = t.groupBy("lr").agg(F.bool_and(F.col("share") >= F.lit(min_pct)).alias("ok")).filter("ok")
    return lr_db.join(ok.select("lr"), "lr", "left_semi")


def _score(L: Column, R: Column, mL: Column, mR: Column) -> Column:
    ind = lambda c: F.when(c > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.lit(0.5) * (L * ind(mR) + ind(L) * mR + R * ind(mL) + ind(R) * mL)


def own_and_neighbors(values: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per spot with its own entries of ``values`` (sample, barcode, i, value), arrays i and
    value, and those of all its neighbours one after another, arrays near_i and near_value; deg
    is the number of neighbours.  Only whole spots are shuffled."""
    own = values.groupBy(*KEYS).agg(F.collect_list(F.struct("i", "value")).alias("_e")).select(*KEYS, "_e.i", "_e.value")
    entries = F.when(F.col("i").isNotNull(), F.struct("i", "value"))
    near = (edges.select("sample", "src", "dst").join(own.withColumnRenamed("barcode", "dst").hint("merge"), ["sample", "dst"], "left")
            .groupBy("sample", F.col("src").alias("barcode")).agg(F.count("*").alias("deg"), F.collect_list(entries).alias("_n")))
    near = near.select(*KEYS, "deg", F.flatten("_n.i").alias("near_i"), F.flatten("_n.value").alias("near_value"))
    return own.join(near.hint("merge"), KEYS, "full")


def lr_scores(expr: DataFrame, edges: DataFrame, lr_db: DataFrame, min_spots: int = 5,
              ce: DataFrame | None = None) -> DataFrame:
    """H1: (sample, barcode, lr, score) for spots with score > 0; LRs with fewer than
    ``min_spots`` scoring spots in a sample are dropped.  ``ce``: precomputed H13 output."""
    ce = ce if ce is not None else complex_expression(expr, lr_db)
    # one LR speaks for every distinct list of subunits: neighbours are averaged once for each list
    sides = _lr_sides(lr_db)
    lists = sides.groupBy("subunits").agg(F.min(F.struct("lr", "side")).alias("_f")).select("subunits", "_f.lr", "_f.side")
    lists = cut_lineage(lists.withColumn("i", F.row_number().over(Window.orderBy("lr", "side"))))     # the catalogue's lists
    own = ce.join(F.broadcast(lists), ["lr", "side"]).select(*KEYS, "i", "value")
    v = own_and_neighbors(own, edges)
    near = v.select(*KEYS, "deg", F.explode(F.arrays_zip("near_i", "near_value")).alias("_n"))
    near = near.groupBy(*KEYS, F.col("_n.near_i").alias("i")).agg((F.sum("_n.near_value") / F.max("deg")).alias("nbr_mean"))
    near = near.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("i", "nbr_mean"))).alias("_near"))
    spot = v.select(*KEYS, F.map_from_arrays("i", "value").alias("_own")).join(near.hint("merge"), KEYS, "left")
    place = lists.select("subunits", "i")
    pairs = cut_lineage(lr_db.select("lr", "ligand", "receptor")
                        .join(place.select(F.col("subunits").alias("ligand"), F.col("i").alias("_l")), "ligand")
                        .join(place.select(F.col("subunits").alias("receptor"), F.col("i").alias("_r")), "receptor").select("lr", "_l", "_r"))
    at = lambda side, m: F.coalesce(F.col(m)[F.col(side)], F.lit(0.0)).alias
    w = spot.crossJoin(F.broadcast(pairs)).select(*KEYS, "lr", at("_l", "_own")("L"), at("_r", "_own")("R"),
                                                  at("_l", "_near")("mL"), at("_r", "_near")("mR"))
    s = w.select(*KEYS, "lr", "L", "R", "mL", "mR",
                 _score(F.col("L"), F.col("R"), F.col("mL"), F.col("mR")).alias("score")).filter(F.col("score") > 0)
    cnt = s.groupBy("sample", "lr").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_spots)
    return s.join(F.broadcast(cnt.select("sample", "lr")), ["sample", "lr"], "left_semi")    # samples x LRs


def _bin(bounds: list[float], c: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < c))


#: numbers in one block of spots x genes (or scores x draws) made dense inside a task
NULL_CELLS = 1 << 20


def _null_hits(spots: pa.RecordBatch, draws: dict, n_genes: int) -> pa.Array:
    """Per spot, for each of its observed scores, the draws of its bin combination that score as much."""
    n = len(spots)

    def dense(i: str, value: str) -> np.ndarray:
        i = spots.column(i)
        spot = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(i), 0).to_numpy())
        at = spot * n_genes + i.flatten().to_numpy()
        return np.bincount(at, spots.column(value).flatten().to_numpy(), n * n_genes).reshape(n, n_genes)

    own = dense("i", "value")
    near = dense("near_i", "near_value") / np.maximum(pc.fill_null(spots.column("deg"), 1).to_numpy(), 1)[:, None]
    score = spots.column("score")
    width = pc.list_value_length(score).to_numpy()
    who, score = np.repeat(np.arange(n), width), score.flatten().to_numpy()
    bl, br = (pc.fill_null(spots.column(c).flatten(), -1).to_numpy() for c in ("bl", "br"))
    hits = np.zeros(len(who), np.int64)
    for (a, b), (left, right, mult) in draws.items():
        asked = np.flatnonzero((bl == a) & (br == b))
        step = max(1, NULL_CELLS // len(mult))
        for some in (asked[k:k + step] for k in range(0, len(asked), step)):
            rows = who[some][:, None]
            L, mL, R, mR = own[rows, left], near[rows, left], own[rows, right], near[rows, right]
            null = 0.5 * (L * (mR > 0) + (L > 0) * mR + R * (mL > 0) + (R > 0) * mL)
            hits[some] = ((null > 0) & (null >= score[some][:, None])) @ mult
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(width)).astype(np.int32), hits)


def lr_null_p(expr: DataFrame, edges: DataFrame, lr_db: DataFrame, scores: DataFrame,
              n_pairs: int = 2000, n_bins: int = 10, ce: DataFrame | None = None) -> DataFrame:
    """H2: permutation-style p for every (spot, LR) with a positive score.

    Draws of one gene as both partners do not count.  Returns scores with columns bl, br
    (expression bins), n_ge, n_null (draws that count), p; n_null is 0 and p is 1 where no
    pair of candidate genes exists in the bins of an LR.
    """
    n_spots = expr.select(*KEYS).distinct().count()
    gm = expr.groupBy("gene").agg((F.sum("value") / F.lit(float(n_spots))).alias("mean"))
    probs = [i / n_bins for i in range(1, n_bins)]
    arr = ", ".join(repr(x) for x in probs)
    # discrete quantiles are actual gene means: no interpolation arithmetic in the bin edges
    bounds = gm.agg(F.expr(f"percentile_disc(array({arr})) WITHIN GROUP (ORDER BY mean)")).first()[0]
    gm = gm.withColumn("bin", _bin(bounds, F.col("mean")))
    cat = lr_genes(lr_db).select("gene").distinct()
    cand = gm.join(cat, "gene", "left_anti")
    cand = cut_lineage(cand.withColumn("j", F.row_number().over(Window.partitionBy("bin").orderBy("gene")) - 1)
                       .withColumn("n_b", F.count("*").over(Window.partitionBy("bin"))))
    counts = cand.select("bin", "n_b").distinct()
    ce = ce if ce is not None else complex_expression(expr, lr_db)
    side_mean = ce.groupBy("lr", "side").agg((F.sum("value") / F.lit(float(n_spots))).alias("mean"))
    side_bin = side_mean.withColumn("bin", _bin(bounds, F.col("mean")))
    lr_bins = cut_lineage(side_bin.groupBy("lr").agg(F.max(F.when(F.col("side") == "L", F.col("bin"))).alias("bl"),
                                                     F.max(F.when(F.col("side") == "R", F.col("bin"))).alias("br")))
    combos = cut_lineage(lr_bins.select("bl", "br").distinct()
                         .join(counts.select(F.col("bin").alias("bl"), F.col("n_b").alias("n_l")), "bl")
                         .join(counts.select(F.col("bin").alias("br"), F.col("n_b").alias("n_r")), "br"))
    combo_id = F.col("bl") * F.lit(n_bins) + F.col("br")
    pairs = combos.select("bl", "br", "n_l", "n_r", F.explode(F.sequence(F.lit(0), F.lit(n_pairs - 1))).alias("k"))
    pairs = pairs.select("bl", "br", "k",
                         F.pmod(lcg(F.col("k"), combo_id * 2), F.col("n_l")).alias("jl"),
                         F.pmod(lcg(F.col("k"), combo_id * 2 + 1), F.col("n_r")).alias("jr"))
    cl = cand.select(F.col("bin").alias("bl"), F.col("j").alias("jl"), F.col("gene").alias("gl"))
    cr = cand.select(F.col("bin").alias("br"), F.col("j").alias("jr"), F.col("gene").alias("gr"))
    # draws repeat the same (gl, gr) when bins are small: score each distinct pair once, keep its multiplicity;
    # a gene is no partner of itself
    pairs = cut_lineage(pairs.join(cl, ["bl", "jl"]).join(cr, ["br", "jr"]).filter(F.col("gl") != F.col("gr"))
                        .groupBy("bl", "br", "gl", "gr").agg(F.count("*").alias("mult")))
    # at most n_bins x n_bins x n_pairs draws, at any number of spots
    drawn = pairs.toArrow().to_pydict()
    index = {g: i for i, g in enumerate(sorted({*drawn["gl"], *drawn["gr"]}))}
    draws: dict = {}
    for bl, br, gl, gr, mult in zip(*(drawn[c] for c in ("bl", "br", "gl", "gr", "mult"))):
        draws.setdefault((bl, br), []).append((index[gl], index[gr], mult))
    draws = {c: np.array(d, np.int64).T for c, d in draws.items()}
    genes = expr.sparkSession.createDataFrame(list(index.items()), "gene string, i int")
    # a spot's genes and observed scores are one row each; null scores never become rows
    gv = own_and_neighbors(expr.filter(F.col("value") > 0).join(F.broadcast(genes), "gene"), edges)
    obs = scores.join(lr_bins, "lr").dropna(subset=KEYS)
    rest = [c for c in obs.columns if c not in KEYS]
    asked = obs.groupBy(*KEYS).agg(F.collect_list(F.struct(*rest)).alias("_o"))
    asked = asked.select(*KEYS, "_o", F.col("_o.bl").alias("bl"), F.col("_o.br").alias("br"), F.col("_o.score").alias("score"))
    t = asked.join(gv.hint("merge"), KEYS, "left").select(*KEYS, "_o", "bl", "br", "score", "i", "value", "deg", "near_i", "near_value")
    n_genes = max(1, len(index))

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, NULL_CELLS // n_genes)
        for batch in table:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                hits = _null_hits(part, draws, n_genes)
                yield pa.RecordBatch.from_arrays([part.column("sample"), part.column("barcode"), part.column("_o"), hits],
                                                 names=["sample", "barcode", "_o", "n_ge"])

    ship_library(expr.sparkSession)
    schema = StructType([*(t.schema[c] for c in (*KEYS, "_o")), StructField("n_ge", ArrayType(LongType()))])
    res = t.mapInArrow(run, schema).select(*KEYS, F.explode(F.arrays_zip("_o", "n_ge")).alias("_z"))
    res = res.select(*KEYS, *[F.col(f"_z._o.{c}").alias(c) for c in rest], F.col("_z.n_ge").alias("n_ge"))
    nn = pairs.groupBy("bl", "br").agg(F.sum("mult").alias("n_null"))
    res = res.join(F.broadcast(nn), ["bl", "br"], "left").fillna(0, ["n_null"])      # one row per bin combination
    p = (F.lit(1.0) + F.col("n_ge")) / (F.lit(1.0) + F.col("n_null"))
    return res.withColumn("p", F.when(F.col("n_null") > 0, p).otherwise(F.lit(1.0)))


def lr_significance(stats: DataFrame, n_lr: DataFrame, cutoff: float) -> DataFrame:
    """H3: BH across LRs within each spot (m = LRs retained in the sample), -log10(p_adj),
    score kept only when significant.  ``n_lr``: (sample, m)."""
    s = stats.join(F.broadcast(n_lr), "sample")      # one row per sample
    s = bh_adjust(s, "p", KEYS, "p_adj", m_col="m")
    return (s.withColumn("neg_log10_p_adj", -F.log10("p_adj"))
             .withColumn("sig", F.col("p_adj") < F.lit(cutoff))
             .withColumn("sig_score", F.when(F.col("sig"), F.col("score")).otherwise(F.lit(0.0))))


def lr_summary(stats: DataFrame, cutoff: float) -> DataFrame:
    """H6 (+ D11, E7): per sample and LR: scoring spots, significant spots (adjusted and raw p),
    interaction score (column total of scores), rank by significant spots."""
    g = stats.groupBy("sample", "lr").agg(
        F.count("*").alias("n_spots"),
        F.count(F.when(F.col("p_adj") < cutoff, 1)).alias("n_spots_sig"),
        F.count(F.when(F.col("p") < cutoff, 1)).alias("n_spots_sig_pval"),
        F.sum("score").alias("interaction_score"))
    w = Window.partitionBy("sample").orderBy(F.desc("n_spots_sig"), F.desc("n_spots_sig_pval"), "lr")
    return g.withColumn("rank", F.row_number().over(w))


def lr_diagnostics(expr: DataFrame, lr_db: DataFrame, n_spots: int, ce: DataFrame | None = None) -> DataFrame:
    """H5: per LR, expression level (mean of the two sides' non-zero medians) and frequency
    (mean of the two sides' zero-spot shares)."""
    ce = ce if ce is not None else complex_expression(expr, lr_db)
    med = exact_percentile(ce, "value", 0.5, ["lr", "side"], out="med")       # distributed exact median
    side = ce.groupBy("lr", "side").agg(F.count("*").alias("nnz")).join(med, ["lr", "side"])
    side = side.withColumn("zero_share", F.lit(1.0) - F.col("nnz") / F.lit(float(n_spots)))
    full = lr_genes(lr_db).select("lr", "side").distinct().join(side, ["lr", "side"], "left").fillna(
        {"med": 0.0, "zero_share": 1.0})
    return full.groupBy("lr").agg(F.avg("med").alias("expr_level"), F.avg("zero_share").alias("zero_freq"))


def cci_counts(stats: DataFrame, expr: DataFrame, edges: DataFrame, lr_db: DataFrame,
               composition: DataFrame, type_cutoff: float, min_spots: int = 3,
               ce: DataFrame | None = None) -> DataFrame:
    """H7: (sample, lr, sender, receiver, n) interaction counts around significant spots."""
    pairs = _cci_pairs(stats, expr, edges, lr_db, ce)
    types = composition.filter(F.col("score") > F.lit(type_cutoff)).select(*KEYS, "cell_type")
    st = types.select(*KEYS, F.col("cell_type").alias("sender"))
    rt = types.select("sample", F.col("barcode").alias("dst"), F.col("cell_type").alias("receiver"))
    t = pairs.join(st.hint("merge"), KEYS).join(rt.hint("merge"), ["sample", "dst"])
    c = t.groupBy("sample", "lr", "sender", "receiver").agg(F.countDistinct("barcode").alias("n"))
    sig = stats.filter("sig")
    keep = sig.groupBy("sample", "lr").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_spots)
    return c.join(F.broadcast(keep.select("sample", "lr")), ["sample", "lr"], "left_semi")


def lr_spot_category(expr: DataFrame, lr_db: DataFrame, ce: DataFrame | None = None) -> DataFrame:
    """Per LR, spots where ligand or receptor is expressed, categorised ligand only /
    receptor only / both, with the two levels (sparse; every other spot is 'neither')."""
    ce = ce if ce is not None else complex_expression(expr, lr_db)
    w = ce.groupBy(*KEYS, "lr").agg(F.max(F.when(F.col("side") == "L", F.col("value"))).alias("ligand_value"),
                                    F.max(F.when(F.col("side") == "R", F.col("value"))).alias("receptor_value"))
    w = w.fillna(0.0, ["ligand_value", "receptor_value"])
    cat = (F.when((F.col("ligand_value") > 0) & (F.col("receptor_value") > 0), F.lit("both"))
           .when(F.col("ligand_value") > 0, F.lit("ligand")).otherwise(F.lit("receptor")))
    return w.withColumn("category", cat)


def lr_category_counts(categories: DataFrame, spots: DataFrame) -> DataFrame:
    """H18 summary: spots per (sample, lr, category) including 'neither' = remaining spots."""
    n = spots.groupBy("sample").agg(F.count("*").alias("_n"))
    c = categories.groupBy("sample", "lr", "category").agg(F.count("*").alias("n_spots"))
    seen = c.groupBy("sample", "lr").agg(F.sum("n_spots").alias("_seen")).join(n, "sample")
    neither = seen.select("sample", "lr", F.lit("neither").alias("category"),
                          (F.col("_n") - F.col("_seen")).alias("n_spots"))
    return c.unionByName(neither)


def spot_index(spots: DataFrame) -> DataFrame:
    """Dense 0-based spot index within sample, by (array_row, array_col, barcode); a sample is
    one slide, so its spots are bounded by the capture array."""
    w = Window.partitionBy("sample").orderBy("array_row", "array_col", "barcode")
    return spots.select(*KEYS, (F.row_number().over(w) - 1).cast("long").alias("i"))


def permuted_types(types: DataFrame, spots: DataFrame, n_perms: int) -> DataFrame:
    """``types`` (sample, barcode, ...) dealt anew within each sample, once per replicate: in
    replicate r the spot at place i of the order of md5(r/barcode) takes the rows of spot i."""
    idx = spot_index(spots)
    reps = idx.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))).alias("rep"))
    draw = F.md5(F.concat(F.col("rep").cast("string"), F.lit("/"), F.col("barcode")))
    w = Window.partitionBy("sample", "rep").orderBy(draw, "barcode")
    reps = reps.select("sample", "rep", "barcode", (F.row_number().over(w) - 1).cast("long").alias("i"))
    src = types.join(idx, KEYS).drop("barcode")
    return reps.join(src, ["sample", "i"]).drop("i")


def _cci_pairs(stats: DataFrame, expr: DataFrame, edges: DataFrame, lr_db: DataFrame,
               ce: DataFrame | None = None) -> DataFrame:
    """(sample, lr, barcode, dst): significant spot with ligand, neighbour-or-self with receptor."""
    ce = ce if ce is not None else complex_expression(expr, lr_db)
    lig = ce.filter(F.col("side") == "L").select(*KEYS, "lr")
    rec = ce.filter(F.col("side") == "R").select("sample", F.col("barcode").alias("dst"), "lr")
    # tables of a row per spot and LR look small in their files; as rows they would fill the driver
    sig = stats.filter("sig").select(*KEYS, "lr").join(lig.hint("merge"), KEYS + ["lr"], "left_semi")
    nb = edges.select("sample", F.col("src").alias("barcode"), "dst").unionByName(
        sig.select("sample", "barcode", F.col("barcode").alias("dst")).distinct())
    return (sig.join(nb.hint("merge"), KEYS).join(rec.hint("merge"), ["sample", "dst", "lr"])
            .select("sample", "lr", "barcode", "dst"))


MASK_BITS = 62
#: replicates on one array axis
REPLICATES = 100


def _dealt_masks(barcodes: list[str], masks: np.ndarray, reps: range) -> np.ndarray:
    """(replicates x spots x words): what ``permuted_types`` deals each spot in each replicate."""
    out = np.empty((len(reps), *masks.shape), masks.dtype)
    names = [f"/{b}".encode() for b in barcodes]
    for k, rep in enumerate(reps):
        head = str(rep).encode()
        drawn = np.frombuffer(b"".join(hashlib.md5(head + b).digest() for b in names), ">u8").reshape(-1, 2)
        place = np.empty(len(names), np.int64)
        place[np.lexsort((drawn[:, 1], drawn[:, 0]))] = np.arange(len(names))
        out[k] = masks[place]
    return out


def _written_out(masks: np.ndarray, n_types: int) -> np.ndarray:
    """(replicates x spots x types), 1 where a mask has the type."""
    bits = np.arange(n_types)
    return (masks[:, :, bits // MASK_BITS] >> (bits % MASK_BITS) & 1).astype(np.float32)


def _replicate_counts(dealt: np.ndarray, src: np.ndarray, dst: np.ndarray, n_types: int) -> np.ndarray:
    """(replicates x sender types x receiver types) interactions of pairs sorted by src: masks
    of the receiving spots are or-ed per sending spot, then counted."""
    first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
    near = np.bitwise_or.reduceat(dealt[:, dst], first, axis=1)
    return np.swapaxes(_written_out(dealt[:, src[first]], n_types), 1, 2) @ _written_out(near, n_types)


def cci_permutation(stats: DataFrame, expr: DataFrame, edges: DataFrame, lr_db: DataFrame,
                    composition: DataFrame, spots: DataFrame, type_cutoff: float, n_perms: int = 1000,
                    observed: DataFrame | None = None, ce: DataFrame | None = None) -> DataFrame:
    """H8: p = (1 + #{replicates with count >= observed}) / (1 + n_perms) for every observed
    (sample, lr, sender, receiver) of ``observed`` (output of ``cci_counts``, made here if
    not given).

    Replicates never become rows: a task takes ``REPLICATES`` of them for one sample, deals the
    spots' type masks (words of ``MASK_BITS`` types) on an array axis, and meets the
    sample's LRs one after another, each with its pairs of spots and observed counts.  A
    sample is one slide, so its spots and their pairs are bounded by the capture array.
    """
    if observed is None:
        observed = cci_counts(stats, expr, edges, lr_db, composition, type_cutoff, ce=ce)
    types = composition.filter(F.col("score") > F.lit(type_cutoff)).select(*KEYS, "cell_type")
    # one row per cell type
    number = (F.row_number().over(Window.orderBy("cell_type")) - 1).cast("int")
    index = cut_lineage(types.select("cell_type").distinct().select("cell_type", number.alias("t")))
    n_types, batches = index.count(), -(-n_perms // REPLICATES)
    words = max(1, -(-n_types // MASK_BITS))
    bit = F.expr(f"shiftleft(1L, t % {MASK_BITS})")
    per_word = [F.coalesce(F.bit_or(F.when(F.floor(F.col("t") / MASK_BITS) == w, bit)), F.lit(0).cast("long")) for w in range(words)]
    masks = types.join(index, "cell_type").groupBy(*KEYS).agg(F.array(*per_word).alias("mask"))
    place = cut_lineage(spot_index(spots))
    blank = F.array(*[F.lit(0).cast("long")] * words)
    slides = (place.join(masks.hint("merge"), KEYS, "left").groupBy("sample")
              .agg(F.sort_array(F.collect_list(F.struct("i", "barcode", F.coalesce("mask", blank).alias("mask")))).alias("s"))
              .select("sample", F.lit(0).alias("kind"), F.lit("").alias("lr"), F.col("s.barcode").alias("barcodes"),
                      F.flatten("s.mask").alias("numbers"), F.array().cast("array<long>").alias("dst")))
    pairs = _cci_pairs(stats, expr, edges, lr_db, ce)
    pairs = (pairs.join(place.withColumnRenamed("i", "src").hint("merge"), KEYS)
             .join(place.select("sample", F.col("barcode").alias("dst"), F.col("i").alias("to")).hint("merge"), ["sample", "dst"])
             .groupBy("sample", "lr").agg(F.sort_array(F.collect_list(F.struct("src", "to"))).alias("p")))
    named = lambda c: index.select(F.col("cell_type").alias(c), F.col("t").alias(f"t_{c}"))
    seen = (observed.join(named("sender"), "sender").join(named("receiver"), "receiver").groupBy("sample", "lr")
            .agg(F.flatten(F.collect_list(F.array(F.col("t_sender").cast("long"), F.col("t_receiver").cast("long"), F.col("n").cast("long"))))
                 .alias("seen")))
    tested = pairs.join(seen, ["sample", "lr"]).select(
        "sample", F.lit(1).alias("kind"), "lr", F.array().cast("array<string>").alias("barcodes"),
        F.concat(F.array(F.size("p").cast("long")), "p.src", "seen").alias("numbers"), F.col("p.to").alias("dst"))

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, dealt = None, None
        for batch in table:
            found = []
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("sample", "batch", "kind", "lr", "barcodes", "numbers", "dst")}
                key = (row["sample"].as_py(), row["batch"].as_py())
                numbers = row["numbers"].values.to_numpy()
                if row["kind"].as_py() == 0:
                    first = key[1] * REPLICATES
                    at, dealt = key, _dealt_masks(row["barcodes"].as_py(), numbers.reshape(-1, words),
                                                  range(first, min(n_perms, first + REPLICATES)))
                elif key == at:
                    n = int(numbers[0])
                    senders, receivers, least = numbers[n + 1:].reshape(-1, 3).T
                    counts = _replicate_counts(dealt, numbers[1:n + 1], row["dst"].values.to_numpy(), n_types)
                    reached = (counts[:, senders, receivers] >= least).sum(0)
                    found += [(key[0], row["lr"].as_py(), int(a), int(b), int(c)) for a, b, c in zip(senders, receivers, reached)]
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["sample", "lr", "t_sender", "t_receiver", "n_ge"])

    ship_library(spots.sparkSession)
    groups = max(1, place.select("sample").distinct().count() * batches)
    every = F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")
    dealt = slides.unionByName(tested).select("*", every).repartition(groups, "sample", "batch").sortWithinPartitions("sample", "batch", "kind", "lr")
    ge = (dealt.mapInArrow(run, "sample string, lr string, t_sender int, t_receiver int, n_ge long")
          .groupBy("sample", "lr", "t_sender", "t_receiver").agg(F.sum("n_ge").alias("n_ge"))
          .join(named("sender"), "t_sender").join(named("receiver"), "t_receiver")
          .select("sample", "lr", "sender", "receiver", "n_ge"))
    res = observed.join(ge, ["sample", "lr", "sender", "receiver"], "left").fillna(0, ["n_ge"])
    return res.withColumn("p", (F.lit(1.0) + F.col("n_ge")) / F.lit(1.0 + n_perms))


def cci_network(cci: DataFrame, min_count: int = 2, by_lr: bool = False) -> DataFrame:
    """H9: edges sender -> receiver with their count, over all LRs or one network per LR; edges
    under ``min_count`` are left out."""
    keys = ["sample", *(["lr"] if by_lr else []), "sender", "receiver"]
    return cci.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def cci_map(cci: DataFrame, by_lr: bool = False, min_total: int = 0) -> DataFrame:
    """Sender x receiver counts over all samples, over all LRs or per LR; LRs with a total
    under ``min_total`` are left out."""
    keys = [*(["lr"] if by_lr else []), "sender", "receiver"]
    t = cci.groupBy(*keys).agg(F.sum("n").alias("n"))
    if not by_lr:
        return t
    total = t.groupBy("lr").agg(F.sum("n").alias("_t")).filter(F.col("_t") >= min_total)
    return t.join(total.select("lr"), "lr", "left_semi")
