"""Reference signatures, spot deconvolution and factorisation.

The same tables that Bayesian models give come from closed-form
aggregations and fixed-iteration multiplicative updates written as joins and
group-bys, with a reliable checkpoint after every iteration:

  N1 signature g_ft = mean over cells of type t of v / (batch mean depth / overall mean depth)
  N2 Poisson (KL) updates  w_sf <- w_sf * (sum_g g_fg d_sg / mu_sg) / (sum_g g_fg),
     mu_sg = sum_f w_sf g_fg; the numerator runs over non-zero d only; w0 = depth_s / (F sum_g g_fg)
  N3 replicates of N2 on LCG gene subsets (keep g when lcg(g, r) mod 10 < 8): q05 / mean / q95 / sd
  N5 X ~ W H (Frobenius multiplicative updates) on the spot x type table, LCG start in (0, 1];
     ``nmf_models`` fits a range of ranks with several restarts in the same passes
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.stats import lcg_unit, md5_unit
from spotframe.session import cut_lineage, ship_library, stage

KEYS = ["sample", "barcode"]


def signatures(expr: DataFrame, labels: DataFrame, label: str = "cell_type", batch: str | None = "sample") -> DataFrame:
    """(gene, cell_type, sig) batch-depth-scaled mean expression over all cells of the type."""
    lab = labels.select(*KEYS, F.col(label).alias("cell_type"))
    depth = expr.groupBy(*KEYS).agg(F.sum("value").alias("depth")).join(lab.select(*KEYS), KEYS)
    if batch:
        # a row per batch
        bm = cut_lineage(depth.groupBy(batch).agg(F.avg("depth").alias("_bm"), F.sum("depth").alias("_d"), F.count("depth").alias("_k")))
        om = bm.agg(F.try_divide(F.sum("_d"), F.sum("_k"))).first()[0]            # one scalar
        f = bm.select(batch, (F.col("_bm") / F.lit(float(om))).alias("_f"))
        e = expr.join(F.broadcast(f), batch)                  # one row per batch
        v = F.col("value") / F.col("_f")
    else:
        e = expr
        v = F.col("value")
    n_t = lab.groupBy("cell_type").agg(F.count("*").alias("_n"))
    s = e.join(lab, KEYS).groupBy("gene", "cell_type").agg(F.sum(v).alias("_s"))
    return s.join(F.broadcast(n_t), "cell_type").select("gene", "cell_type", (F.col("_s") / F.col("_n")).alias("sig"))


def deconvolve(expr: DataFrame, sig: DataFrame, iters: int, by: list[str] | None = None) -> DataFrame:
    """(*by, sample, barcode, cell_type, w) non-negative abundances by KL multiplicative updates.

    Genes are the intersection of the spot genes and the signature genes (F2), per ``by`` group
    (``by`` carries e.g. a replicate id so many fits run as one set of joins).  A spot's counts
    and the signature rows of its genes form one row (bounded by the genes), and all
    iterations run inside it: one shuffle, whatever their number."""
    by = list(by or [])
    genes = sig.select(*by, "gene").distinct().join(expr.select(*by, "gene").distinct(), by + ["gene"])
    sig = sig.join(genes, by + ["gene"], "left_semi")
    d = expr.join(genes, by + ["gene"], "left_semi").select(*by, *KEYS, "gene", "value")
    one = F.lit(0).alias("_all")
    # per by group: the types in order and their column sums
    sums = (sig.groupBy(*by, "cell_type").agg(F.sum("sig").alias("gsum")).groupBy(*by, one)
            .agg(F.sort_array(F.collect_list(F.struct("cell_type", "gsum"))).alias("types")))
    per_gene = (sig.groupBy(*by, one, "gene").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "sig"))).alias("_m"))
                .join(sums, by + ["_all"])
                .select(*by, "gene", F.transform("types", lambda t: F.coalesce(F.col("_m")[t["cell_type"]], F.lit(0.0))).alias("sig")))
    spots = (d.join(per_gene, by + ["gene"]).groupBy(*by, one, *KEYS)
             .agg(F.collect_list(F.struct("value", "sig")).alias("genes"), F.sum("value").alias("depth"))
             .join(sums, by + ["_all"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    start = F.transform("types", lambda t: F.col("depth") / (F.size("types") * t["gsum"]))

    def update(w: Column) -> Column:
        # value / mu of every gene, then its sum with the signature per type
        ratios = F.transform("genes", lambda g: F.struct(
            F.coalesce(F.try_divide(g["value"], dot(g["sig"], w)), F.lit(0.0)).alias("q"), g["sig"].alias("sig")))
        zero = F.transform("types", lambda t: F.lit(0.0))
        num = F.aggregate(ratios, zero, lambda acc, g: F.zip_with(acc, g["sig"], lambda x, y: x + g["q"] * y))
        return F.zip_with(F.zip_with(w, num, lambda x, y: x * y), F.col("types"), lambda x, t: x / t["gsum"])

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iters)), start, lambda w, _: update(w)) if iters else start
    out = spots.select(*by, *KEYS, F.explode(F.arrays_zip(F.col("types.cell_type").alias("cell_type"), fitted.alias("w"))).alias("_t"))
    return out.select(*by, *KEYS, "_t.cell_type", "_t.w")


# bits of a replicate mask's word; numbers of one fit that a task holds at once
WORD_BITS = 62
FIT_CELLS = 1 << 22


def _kl_fit(value: np.ndarray, sig: np.ndarray, first: np.ndarray, gsum: np.ndarray, iters: int) -> tuple[np.ndarray, np.ndarray]:
    """N2 for spots whose entries lie one after another (``first``: where each begins): ``value``
    with nan for null, ``sig`` types x entries.  Returns weights (types x spots) and whether a spot has any value."""
    n = np.diff(np.append(first, len(value)))
    known = np.add.reduceat((~np.isnan(value)).astype(np.int64), first) > 0
    value = np.nan_to_num(value, nan=0.0)
    depth = np.add.reduceat(value, first)
    w = depth[None, :] / (len(gsum) * gsum[:, None])
    for _ in range(iters):
        mu = np.zeros(len(value))
        for s, v in zip(sig, w):
            mu += s * np.repeat(v, n)
        q = np.divide(value, mu, out=np.zeros(len(value)), where=mu != 0)
        for t, s in enumerate(sig):
            w[t] *= np.add.reduceat(s * q, first)
            w[t] /= gsum[t]
    return w, known


def _summary(w: np.ndarray) -> dict[str, np.ndarray]:
    """q05 / mean / q95 / sd over the last axis, nan values passed over; nan where undefined."""
    n = (~np.isnan(w)).sum(-1)
    ordered = np.sort(w, axis=-1)                       # nan last
    some = np.maximum(n, 1)

    def quantile(p: float) -> np.ndarray:
        place = (some - 1) * p
        low = np.floor(place).astype(np.int64)
        high = np.ceil(place).astype(np.int64)
        a = np.take_along_axis(ordered, low[..., None], -1)[..., 0]
        b = np.take_along_axis(ordered, high[..., None], -1)[..., 0]
        return np.where(low == high, a, (high - place) * a + (place - low) * b)

    mean = np.where(n > 0, np.nansum(w, axis=-1) / some, np.nan)
    square = np.nansum((w - mean[..., None]) ** 2, axis=-1)
    sd = np.where(n > 1, np.sqrt(square / np.maximum(n - 1, 1)), np.nan)
    return {"q05": quantile(0.05), "mean": mean, "q95": quantile(0.95), "sd": sd}


def abundance_summary(expr: DataFrame, sig: DataFrame, iters: int, reps: int = 20, keep: float = 0.8) -> DataFrame:
    """``reps`` replicates of N2 on gene subsets (gene kept in replicate r when its md5 uniform of
    'gene/r' is at most ``keep``), then exact q05 / mean / q95 / sd of the abundance per spot and type.

    Replicates never become rows: a gene carries its signature row and the bits of the replicates
    that keep it, a spot's counts go once to the spot, and all fits of a spot run inside its task.
    Genes are the intersection of the spot genes and the signature genes (F2)."""
    spark = expr.sparkSession
    types = sorted(r[0] for r in sig.select("cell_type").distinct().collect())        # bounded: type catalogue
    words = -(-reps // WORD_BITS)
    kept = F.filter(F.sequence(F.lit(0), F.lit(reps - 1)),
                    lambda r: md5_unit(F.concat("gene", F.lit("/"), r.cast("string"))) <= keep)
    word = lambda k: F.aggregate(
        F.filter("kept", lambda r: F.floor(r / WORD_BITS) == k), F.lit(0).cast("long"),
        lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), r % WORD_BITS)))
    per_gene = (sig.filter(F.col("gene").isNotNull()).groupBy("gene")
                .agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "sig"))).alias("_m"))
                .join(expr.select("gene").distinct(), "gene", "left_semi").withColumn("kept", kept)
                .select("gene", "kept", F.array(*[word(k) for k in range(words)]).alias("mask"),
                        F.array(*[F.col("_m")[F.lit(t)] for t in types]).alias("sig")))
    per_gene = stage(per_gene)
    # one row per replicate: the column sums of the types it has
    sums = per_gene.select(F.explode("kept").alias("rep"), "sig").groupBy("rep").agg(
        F.array(*[F.sum(F.col("sig")[i]) for i in range(len(types))]).alias("gsum")).collect()
    gsum = {r["rep"]: np.array([np.nan if g is None else g for g in r["gsum"]]) for r in sums}
    if any((g == 0).any() for g in gsum.values()):
        raise ZeroDivisionError("a type's signature adds up to 0")
    width = len(types)
    spots = (expr.join(per_gene.select("gene", "mask", "sig").hint("merge"), "gene").groupBy(*KEYS)
             .agg(F.collect_list(F.struct("value", "mask", F.transform("sig", lambda s: F.coalesce(s, F.lit(0.0))).alias("sig"))).alias("g"))
             .select(*KEYS, F.col("g.value").cast("array<double>").alias("value"), F.flatten("g.mask").alias("mask"),
                     F.flatten("g.sig").alias("sig")))

    def fit(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(part):
            n = pc.list_value_length(part.column("value")).to_numpy()
            value = part.column("value").flatten().to_numpy(zero_copy_only=False).astype(float)
            mask = part.column("mask").flatten().to_numpy().reshape(-1, words)
            table_sig = np.ascontiguousarray(part.column("sig").flatten().to_numpy().reshape(-1, width).T)
            owner = np.repeat(np.arange(len(n)), n)
            w = np.full((len(n), width, reps), np.nan)
            met = np.zeros((len(n), width), bool)
            for rep, total in gsum.items():
                at = np.flatnonzero(mask[:, rep // WORD_BITS] >> (rep % WORD_BITS) & 1)
                has = np.flatnonzero(~np.isnan(total))
                if not len(at) or not len(has):
                    continue
                first = np.flatnonzero(np.append(True, np.diff(owner[at]) != 0))
                who = owner[at][first]
                got, known = _kl_fit(value[at], table_sig[has][:, at], first, total[has], iters)
                w[np.ix_(who, has, [rep])] = np.where(known, got, np.nan).T[..., None]
                met[np.ix_(who, has)] = True
            spot, t = np.nonzero(met)
            out = {c: pa.array(v[spot, t], pa.float64(), from_pandas=True) for c, v in _summary(w).items()}
            return pa.RecordBatch.from_arrays([part.column("sample").take(pa.array(spot)), part.column("barcode").take(pa.array(spot)),
                                               pa.array(t.astype(np.int32)), *out.values()], ["sample", "barcode", "t", *out])

        for batch in table:
            ends = np.cumsum(pc.list_value_length(batch.column("value")).to_numpy() * max(1, width) + width * reps)
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + FIT_CELLS, "right")))
                yield rows(batch.slice(start, stop - start))
                start = stop

    ship_library(spark)
    kinds = [f"`{c}` {expr.schema[c].dataType.simpleString()}" for c in KEYS]
    out = spots.mapInArrow(fit, ", ".join([*kinds, "t int", "q05 double", "mean double", "q95 double", "sd double"]))
    name = F.element_at(F.array(*[F.lit(t) for t in types]), F.col("t") + 1) if types else F.lit(None).cast(sig.schema["cell_type"].dataType)
    return out.select(*KEYS, name.alias("cell_type"), "q05", "mean", "q95", "sd")


def to_fractions(w: DataFrame) -> DataFrame:
    """Abundances -> per-spot shares."""
    return w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*KEYS)))


def nmf(x: DataFrame, rank: int, iters: int, restart: int = 0, key: str = "cell_type",
        value: str = "score") -> tuple[DataFrame, DataFrame]:
    """X (spots x types, long) ~ W (spots x rank) H (rank x types), Frobenius multiplicative
    updates.  H is small (rank x types) and broadcast; W is distributed by spot.
      H <- H * (W^T X) / (W^T W H),   W <- W * (X H^T) / (W H H^T)
    Gram matrices are group-by sums; start in (0, 1] from an LCG of the type index (H) and the md5 of
    spot, factor and restart (W)."""
    xs = x.select(*KEYS, F.col(key).alias("t"), F.col(value).alias("x"))
    tl = sorted(r[0] for r in xs.select("t").distinct().collect())               # bounded: type catalogue
    types = xs.sparkSession.createDataFrame([(t, i + 1) for i, t in enumerate(tl)], "t string, _ti int")
    spots = xs.select(*KEYS).distinct()
    fac = F.explode(F.sequence(F.lit(0), F.lit(rank - 1))).alias("f")
    H = types.select("t", "_ti", fac).select("f", "t", lcg_unit(F.col("_ti") * 131 + F.col("f"), restart).alias("h"))
    name = F.concat_ws("/", "sample", "barcode", F.col("f").cast("string"), F.lit(str(restart)))
    W = spots.select(*KEYS, fac).withColumn("w", md5_unit(name))
    eps = F.lit(1e-12)
    for _ in range(iters):
        wtx = W.join(xs, KEYS).groupBy("f", "t").agg(F.sum(F.col("w") * F.col("x")).alias("num"))
        wtw = (W.alias("a").join(W.alias("b"), KEYS)
               .groupBy(F.col("a.f").alias("f"), F.col("b.f").alias("g")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("ww")))
        den = wtw.join(H.withColumnRenamed("f", "g"), "g").groupBy("f", "t").agg(F.sum(F.col("ww") * F.col("h")).alias("den"))
        H = (H.join(wtx, ["f", "t"], "left").join(den, ["f", "t"])
             .select("f", "t", (F.col("h") * F.coalesce("num", F.lit(0.0)) / (F.col("den") + eps)).alias("h")))
        H = cut_lineage(H)
        xht = xs.join(F.broadcast(H), "t").groupBy(*KEYS, "f").agg(F.sum(F.col("x") * F.col("h")).alias("num"))
        hht = (H.alias("a").join(H.alias("b"), "t")
               .groupBy(F.col("a.f").alias("f"), F.col("b.f").alias("g")).agg(F.sum(F.col("a.h") * F.col("b.h")).alias("hh")))
        den = W.withColumnRenamed("f", "g").join(F.broadcast(hht), "g").groupBy(*KEYS, "f").agg(
            F.sum(F.col("w") * F.col("hh")).alias("den"))
        W = (W.join(xht, KEYS + ["f"], "left").join(den, KEYS + ["f"])
             .select(*KEYS, "f", (F.col("w") * F.coalesce("num", F.lit(0.0)) / (F.col("den") + eps)).alias("w")))
        W = cut_lineage(W)
    return W, H


def nmf_tables(x: DataFrame, W: DataFrame, H: DataFrame, key: str = "cell_type", value: str = "score",
               top: int = 10) -> dict[str, DataFrame]:
    """Type fractions per factor, top types per factor, spot weights, reconstruction accuracy."""
    frac = H.withColumn("fraction", F.col("h") / F.sum("h").over(Window.partitionBy("t")))
    topt = frac.withColumn("_r", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("fraction"), "t"))).filter(
        F.col("_r") <= top).drop("_r")
    xs = x.select(*KEYS, F.col(key).alias("t"), F.col(value).alias("x"))
    rec = W.join(F.broadcast(H), "f").groupBy(*KEYS, "t").agg(F.sum(F.col("w") * F.col("h")).alias("xhat"))
    j = rec.join(xs, KEYS + ["t"], "left").fillna(0.0, ["x"])
    acc = j.agg(F.corr("x", "xhat").alias("accuracy"))
    return {"fractions": frac, "top_types": topt, "weights": W, "accuracy": acc}


def restart_stability(hs: list[DataFrame]) -> DataFrame:
    """Mean over factors of restart 0 of the best cosine similarity with any factor of each
    other restart (factor profiles over cell types; H tables are rank x types)."""
    base = hs[0].select("f", "t", F.col("h").alias("h0"))
    n0 = base.groupBy("f").agg(F.sqrt(F.sum(F.col("h0") * F.col("h0"))).alias("n0"))
    outs = []
    for r, h in enumerate(hs[1:], start=1):
        o = h.select(F.col("f").alias("g"), "t", F.col("h").alias("h1"))
        n1 = o.groupBy("g").agg(F.sqrt(F.sum(F.col("h1") * F.col("h1"))).alias("n1"))
        cos = (base.join(o, "t").groupBy("f", "g").agg(F.sum(F.col("h0") * F.col("h1")).alias("dot"))
               .join(n0, "f").join(n1, "g").select("f", "g", (F.col("dot") / (F.col("n0") * F.col("n1"))).alias("cos")))
        best = cos.groupBy("f").agg(F.max("cos").alias("best"))
        outs.append(best.agg(F.lit(r).alias("restart"), F.avg("best").alias("stability")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


# Factor tables of all models together may hold this many numbers (8 MB): they travel to every task.
MAX_FACTOR_ENTRIES = 1 << 20
SPOT_SWEEPS, FACTOR_SWEEPS = 60, 10


# rows of a descent at once (they stay in the processor's cache), and factors that share one product
FIT_ROWS, FIT_FACTORS = 1 << 14, 4


def _fit_rows(b: np.ndarray, gram: np.ndarray, w: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative least squares of every row of ``w`` by cyclic coordinate descent:
    min |x - w H|^2 with b = x H^T and gram = H H^T.  Factors without weight stay 0.

    A factor's rows lie one after another.  What a block of ``FIT_FACTORS`` factors takes from weights
    that are known before it is one product; inside the block they follow each other."""
    n, rank = w.shape
    diag = np.diag(gram)
    inv = np.divide(1.0, diag, out=np.zeros(rank), where=diag > 0)
    pull = -(gram * inv[:, None])
    np.fill_diagonal(pull, 0.0)
    blocks = []
    for start in range(0, rank, FIT_FACTORS):
        stop = min(rank, start + FIT_FACTORS)
        before = pull[start:stop].copy()
        for f in range(start, stop):
            before[f - start, start:f] = 0.0            # these are renewed first
        blocks.append((start, stop, before))
    out = np.empty((n, rank))
    for rows in np.array_split(np.arange(n), -(-n // FIT_ROWS)) if n else []:
        part = slice(rows[0], rows[-1] + 1)
        free, now = np.ascontiguousarray((b[part] * inv).T), np.ascontiguousarray(w[part].T)
        room, step = np.empty((FIT_FACTORS, len(rows))), np.empty(len(rows))
        for _ in range(sweeps):
            for start, stop, before in blocks:
                to = room[:stop - start]
                np.matmul(before, now, out=to)
                to += free[start:stop]
                for f in range(start, stop):
                    if f > start:
                        to[f - start] += np.dot(pull[f, start:f], now[start:f], out=step)
                    np.maximum(to[f - start], 0.0, out=now[f])
        out[part] = now.T
    return out


def spot_weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Weights (spots x rank) of the rows of ``x`` for the factors ``h`` (rank x types)."""
    gram, b = h @ h.T, x @ h.T
    scale = np.where(np.diag(gram) > 0, np.diag(gram), 1.0)
    return _fit_rows(b, gram, np.maximum(b, 0.0) / scale / len(h), SPOT_SWEEPS)


def _matrix(batch, width: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class NmfModels:
    """Fitted factorisations: ``spots`` (sample, barcode, x: scores in the order of ``types``),
    ``factors`` by (rank, restart) as rank x types matrices whose rows sum to 1, ``fits`` with
    a dict per model: rank, restart, iterations, loss, accuracy, stability, best."""

    spots: DataFrame
    types: list
    factors: dict
    fits: list

    def table(self) -> DataFrame:
        """One row per (rank, restart)."""
        return self.spots.sparkSession.createDataFrame(
            [tuple(f.values()) for f in self.fits],
            "rank int, restart int, iterations int, loss double, accuracy double, stability double, best boolean")

    def best(self) -> list:
        """(rank, restart) of the restart with the smallest loss of every rank."""
        return [(f["rank"], f["restart"]) for f in self.fits if f["best"]]

    def profiles(self, models: list | None = None) -> DataFrame:
        """(rank, restart, f, t, h, fraction): factor profiles and each factor's share of a type."""
        out = []
        for m in models if models is not None else sorted(self.factors):
            h = self.factors[m]
            total = h.sum(axis=0)
            out += [(*m, f, t, float(h[f, j]), float(h[f, j] / total[j]) if total[j] > 0 else 0.0)
                    for f in range(len(h)) for j, t in enumerate(self.types)]
        return self.spots.sparkSession.createDataFrame(
            out, "rank int, restart int, f int, t string, h double, fraction double")

    def weights(self, models: list | None = None) -> DataFrame:
        """(sample, barcode, rank, restart, f, w) of every spot, computed where the spot lies."""
        wanted = [(m, self.factors[m]) for m in (models if models is not None else sorted(self.factors))]
        width = len(self.types)

        def weigh(batches):
            import pyarrow as pa
            for batch in batches:
                x = _matrix(batch, width)
                for (rank, restart), h in wanted:
                    w = spot_weights(x, h)
                    offsets = np.arange(0, w.size + 1, rank, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.array(np.full(len(x), rank, np.int32)),
                         pa.array(np.full(len(x), restart, np.int32)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))],
                        ["sample", "barcode", "rank", "restart", "w"])

        rows = self.spots.select(*KEYS, "x").mapInArrow(
            weigh, "sample string, barcode string, rank int, restart int, w array<double>")
        return rows.select(*KEYS, "rank", "restart", F.posexplode("w").alias("f", "w"))


def nmf_models(x: DataFrame, ranks=(11, 12), restarts: int = 3, max_iters: int = 100, tol: float = 1e-6,
               key: str = "cell_type", value: str = "score") -> NmfModels:
    """N5 over a range of ranks with restarts: X (spots x types) ~ W H, all models in the same passes.

    A pass reads the spots once.  Each task solves the weights of its spots for the current
    factors of every model that still moves (a convex problem per spot, so no weights are kept
    between passes) and sums W^T X, W^T W and W^T 1; sums of sums give one small matrix a
    model, from which the factors are renewed and the loss is read off in closed form:
    |X|^2 - 2 tr(H (W^T X)^T) + tr(W^T W H H^T).  A model stops when a pass lowers its loss by
    no more than ``tol`` |X|^2, or after ``max_iters`` passes.

    Only factors travel (ranks x restarts x types numbers; beyond ``MAX_FACTOR_ENTRIES`` the
    call raises).  Scores are non-negative; rows of one spot and type add up, null scores count
    as 0, rows without a type are passed over.  Without any row the table of fits is empty."""
    spark = x.sparkSession
    ranks = sorted(set(int(r) for r in ranks))
    models = [(r, s) for r in ranks for s in range(restarts)]
    cells = (x.filter(F.col(key).isNotNull()).groupBy(*KEYS, F.col(key).alias("t"))
             .agg(F.sum(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("v")))
    cells = stage(cells)
    most = MAX_FACTOR_ENTRIES // max(1, sum(ranks) * restarts)
    types = sorted(r[0] for r in cells.select("t").distinct().limit(most + 1).collect())     # bounded by ``most``
    if len(types) > most:
        raise ValueError(f"more than {most} types: the factors of all models would not stay small")
    order = F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")
    spots = stage(cells.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))
                  .select(*KEYS, F.transform(order, lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("x")))
    if not types:
        return NmfModels(spots, types, {}, [])
    ship_library(spark)
    width = len(types)
    factors = {}
    for r, s in models:
        h = np.random.default_rng([r, s]).uniform(0.01, 1.0, (r, width))
        factors[r, s] = h / h.sum(axis=1, keepdims=True)
    fits = {m: None for m in models}
    loss: dict = {m: np.inf for m in models}
    moving = list(models)
    for iteration in range(1, max_iters + 1):
        wtx, wtw, w1, x0 = _gram_pass(spots, [factors[m] for m in moving], width)
        still = []
        for k, m in enumerate(moving):
            h = factors[m]
            cross, recon = float((h * wtx[k]).sum()), float((wtw[k] * (h @ h.T)).sum())
            now = max(0.0, x0["xx"] - 2.0 * cross + recon)
            xhat = float(w1[k] @ h.sum(axis=1))
            cells_n = x0["n"] * width
            spread = (x0["xx"] - x0["x"] ** 2 / cells_n) * (recon - xhat ** 2 / cells_n)
            fits[m] = {"rank": m[0], "restart": m[1], "iterations": iteration, "loss": now,
                       "accuracy": (cross - x0["x"] * xhat / cells_n) / spread ** 0.5 if spread > 0 else None}
            if loss[m] - now > tol * x0["xx"] and iteration < max_iters:
                still.append((k, m))
            loss[m] = now
        if not still:
            break
        for k, m in still:
            # the same descent by types: rows of H^T with gram W^T W
            h = _fit_rows(wtx[k].T, wtw[k], factors[m].T, FACTOR_SWEEPS).T
            total = h.sum(axis=1, keepdims=True)
            factors[m] = np.where(total > 0, h / np.where(total > 0, total, 1.0), 0.0)
        moving = [m for _, m in still]
    for r, s in models:
        others = [best_cosine(factors[r, s], factors[r, o]) for o in range(restarts) if o != s]
        fits[r, s]["stability"] = float(np.mean(others)) if others else None
        fits[r, s]["best"] = (loss[r, s], s) == min((loss[r, o], o) for o in range(restarts))
    return NmfModels(spots, types, factors, [fits[m] for m in models])


def best_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the factors of ``a`` of the largest cosine with a factor of ``b``."""
    def unit(h):
        n = np.linalg.norm(h, axis=1, keepdims=True)
        return h / np.where(n > 0, n, 1.0)
    return float((unit(a) @ unit(b).T).max(axis=1).mean())


def _gram_pass(spots: DataFrame, factors: list, width: int):
    """W^T X, W^T W and W^T 1 of every model, and n, sum and sum of squares of X.  Tasks send
    one partial sum per entry; Spark adds them up."""

    def partial(batches):
        import pyarrow as pa
        sums = [np.zeros((len(h), width + len(h) + 1)) for h in factors]
        whole = np.zeros(3)
        for batch in batches:
            x = _matrix(batch, width)
            whole += [len(x), x.sum(), (x * x).sum()]
            for h, s in zip(factors, sums):
                w = spot_weights(x, h)
                s[:, :width] += w.T @ x
                s[:, width:-1] += w.T @ w
                s[:, -1] += w.sum(axis=0)
        if whole[0] == 0:
            return
        flat = [whole] + [s.ravel() for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(v), k - 1, np.int32) for k, v in enumerate(flat)])),
             pa.array(np.concatenate([np.arange(len(v), dtype=np.int32) for v in flat])),
             pa.array(np.concatenate(flat))], ["m", "i", "v"])

    rows = (spots.select("x").mapInArrow(partial, "m int, i int, v double")
            .groupBy("m", "i").agg(F.sum("v").alias("v")).collect())          # entries of the Gram matrices
    flat = {k: np.zeros(len(h) * (width + len(h) + 1)) for k, h in enumerate(factors)}
    flat[-1] = np.zeros(3)
    for m, i, v in rows:
        flat[m][i] = v
    both = [flat[k].reshape(len(h), -1) for k, h in enumerate(factors)]
    return ([b[:, :width] for b in both], [b[:, width:-1] for b in both], [b[:, -1] for b in both],
            dict(zip(("n", "x", "xx"), flat[-1].tolist())))
