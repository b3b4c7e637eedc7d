import hashlib

import numpy as np
from pyspark.sql import functions as F

from spotframe.operators import deconv as dc
from spotframe.operators import views as vw


def test_kl_updates_do_not_increase_loss(spark):
    rng = np.random.default_rng(4)
    sig = rng.uniform(0.1, 2.0, size=(12, 3))
    w_true = rng.uniform(0, 5, size=(10, 3))
    counts = rng.poisson(w_true @ sig.T)
    e = spark.createDataFrame([("S", f"s{i}", f"g{g}", float(counts[i, g])) for i in range(10) for g in range(12)
                               if counts[i, g] > 0], "sample string, barcode string, gene string, value double")
    s = spark.createDataFrame([(f"g{g}", f"t{t}", float(sig[g, t])) for g in range(12) for t in range(3)],
                              "gene string, cell_type string, sig double")

    def loss(iters):
        w = dc.deconvolve(e, s, iters).collect()
        W = np.zeros((10, 3))
        for r in w:
            W[int(r["barcode"][1:]), int(r["cell_type"][1:])] = r["w"]
        mu = W @ sig.T
        mask = counts > 0
        return float((mu - counts * np.log(np.where(mask, mu, 1.0))).sum())

    ls = [loss(i) for i in (0, 1, 3, 6)]
    assert all(b <= a + 1e-9 for a, b in zip(ls, ls[1:]))


def test_abundance_replicates_are_no_rows(spark):
    rng = np.random.default_rng(9)
    counts = rng.poisson(1.5, (7, 15))
    rows = [("S", f"s{i}" if i else None, f"g{g}", float(counts[i, g])) for i in range(7) for g in range(15) if counts[i, g] > 0]
    rows += [("S", "s1", "g3", 2.0), ("S", "s1", "g3", 2.0), ("S", "s2", "g4", None), ("S", "s3", None, 1.0), ("S", "s9", "other", 4.0)]
    e = spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")
    s = spark.createDataFrame([(f"g{g}", f"t{t}", float(rng.uniform(0.1, 2.0))) for g in range(16) for t in range(3) if t < 2 or g in (2, 5)]
                              + [(None, "t0", 1.0)], "gene string, cell_type string, sig double")
    reps, keep = 5, 0.5
    out = dc.abundance_summary(e, s, 3, reps, keep)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "rep#" not in plan
    # each replicate alone, by N2
    fits = {}
    for rep in range(reps):
        kept = [f"g{g}" for g in range(16) if (int(hashlib.md5(f"g{g}/{rep}".encode()).hexdigest()[:13], 16) + 1) / 2 ** 52 <= keep]
        for r in dc.deconvolve(e.filter(F.col("gene").isin(kept)), s.filter(F.col("gene").isin(kept)), 3).collect():
            fits.setdefault((r["barcode"], r["cell_type"]), []).append(r["w"])
    got = {(r["barcode"], r["cell_type"]): r for r in out.collect()}
    assert got.keys() == fits.keys() and (None, "t0") in got and {len(w) for w in fits.values()} != {reps}
    for k, w in fits.items():
        sd = np.std(w, ddof=1) if len(w) > 1 else None
        want = [np.quantile(w, 0.05), np.mean(w), np.quantile(w, 0.95)] + [sd] * (sd is not None)
        assert np.allclose([got[k][c] for c in ("q05", "mean", "q95", "sd")[:len(want)]], want), k
        assert (got[k]["sd"] is None) == (sd is None)
    # more replicates than a word has bits
    assert dc.abundance_summary(e, s, 1, 130, keep).count() == 3 * 7


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(7)
    n, p = 200, 3
    X = rng.normal(size=(n, p))
    y = X @ np.array([1.0, -2.0, 0.5]) + rng.normal(scale=0.1, size=n)
    xs = spark.createDataFrame([("S", f"s{i}", "blk", f"f{j}", float(X[i, j])) for i in range(n) for j in range(p)],
                               "sample string, barcode string, block string, feature string, x double")
    ys = spark.createDataFrame([("S", f"s{i}", "y", float(y[i])) for i in range(n)],
                               "sample string, barcode string, target string, y double")
    betas, pred = vw.ridge_cv(xs, ys, lam=1.0, n_folds=5, exclude_same_blocks=())
    folds = {r["barcode"]: r["fold"] for r in xs.select("barcode", vw.spot_fold(5).alias("fold")).distinct().collect()}
    b = {(r["fold"], r["feature"]): r["beta"] for r in betas.collect()}
    for f in range(5):
        tr = np.array([folds[f"s{i}"] != f for i in range(n)])
        if not tr.any() or tr.all():
            continue
        Xt, yt = X[tr], y[tr]
        mx, my = Xt.mean(0), yt.mean()
        beta = np.linalg.solve((Xt - mx).T @ (Xt - mx) + np.eye(p), (Xt - mx).T @ (yt - my))
        for j in range(p):
            assert abs(b[(f, f"f{j}")] - beta[j]) < 1e-8
    r2 = vw.r2(pred, ["sample", "block", "target"]).collect()[0]["r2"]
    assert r2 > 0.99


def test_descent_works_on_blocks_of_factors(monkeypatch):
    rng = np.random.default_rng(3)
    h = rng.uniform(0.01, 1.0, (11, 6))
    h[4] = 0.0
    x = rng.dirichlet(np.ones(6), 53)

    def one_by_one(b, gram, w, sweeps):
        w = w.copy()
        for _ in range(sweeps):
            for f in range(w.shape[1]):
                w[:, f] = np.maximum(0.0, w[:, f] + (b[:, f] - w @ gram[:, f]) / gram[f, f]) if gram[f, f] > 0 else 0.0
        return w

    b, gram, start = x @ h.T, h @ h.T, rng.uniform(0, 1, (53, 11))
    assert np.allclose(dc._fit_rows(b, gram, start, 25), one_by_one(b, gram, start, 25), atol=1e-12)
    monkeypatch.setattr(dc, "FIT_ROWS", 10)
    assert np.allclose(dc._fit_rows(b, gram, start, 25), one_by_one(b, gram, start, 25), atol=1e-12)
    assert dc._fit_rows(b[:0], gram, start[:0], 2).shape == (0, 11)
    products, real = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: products.append(1) or real(*a, **k))
    monkeypatch.setattr(dc, "FIT_ROWS", 1 << 14)
    dc._fit_rows(b, gram, start, 1)
    assert len(products) == 3                                   # 11 factors in blocks of 4


def test_nmf_reconstruction_improves(spark):
    rng = np.random.default_rng(12)
    W = rng.uniform(0, 1, (30, 2))
    H = rng.uniform(0, 1, (2, 5))
    X = W @ H
    comp = spark.createDataFrame([("S", f"s{i}", f"t{j}", float(X[i, j])) for i in range(30) for j in range(5)],
                                 "sample string, barcode string, cell_type string, score double")

    def acc(iters):
        w, h = dc.nmf(comp, 2, iters)
        t = dc.nmf_tables(comp, w, h)
        assert all(r["h"] >= 0 for r in h.collect()) and all(r["w"] >= 0 for r in w.collect())
        return t["accuracy"].collect()[0]["accuracy"]

    a1, a20 = acc(1), acc(20)
    assert a20 >= a1 - 1e-9 and a20 > 0.95


def test_size_estimate_stays_flat_over_iterations(spark):
    rng = np.random.default_rng(3)
    X = rng.uniform(0, 1, size=(20, 4))
    x = spark.createDataFrame([("S", f"s{i}", f"t{j}", float(X[i, j])) for i in range(20) for j in range(4)],
                              "sample string, barcode string, cell_type string, score double")
    sizes = []
    for iters in (1, 3, 6):
        W, _ = dc.nmf(x, 2, iters)
        sizes.append(int(W._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert max(sizes) < 100_000 and max(sizes) <= 2 * min(sizes)


def test_integrate_matches_numpy(spark):
    from spotframe.operators import transfer as tf
    rng = np.random.default_rng(12)
    ref, qry = rng.normal(size=(25, 3)), rng.normal(size=(20, 3)) + 0.7
    frame = lambda x, p: spark.createDataFrame([(f"{p}{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)],
                                               "barcode string, vec array<double>")
    a, b = frame(ref, "a"), frame(qry, "b")
    pairs = [(r["a_id"], r["b_id"]) for r in tf.mnn_pairs(a, b, 4).collect()]
    d = np.linalg.norm(ref[:, None] - qry[None], axis=2)
    near_b, near_a = np.argsort(d, 1)[:, :4], np.argsort(d, 0)[:4]
    assert set(pairs) == {(f"a{i:02d}", f"b{j:02d}") for i in range(25) for j in near_b[i] if i in near_a[:, j]}
    anchors = spark.createDataFrame(pairs, "a_id string, b_id string")
    got = {r["barcode"]: np.array(r["vec"]) for r in tf.integrate(a, b, anchors, 3).collect()}
    delta = {}
    for i, j in pairs:
        delta.setdefault(int(j[1:]), []).append(ref[int(i[1:])] - qry[int(j[1:])])
    cells = sorted(delta)
    delta = {j: np.mean(v, 0) for j, v in delta.items()}
    for q in range(20):
        # the cell itself counts among its nearest anchor cells
        dist = sorted((np.linalg.norm(qry[q] - qry[c]), c) for c in cells)[:3]
        width = dist[-1][0]
        w = [np.exp(-(x / width) ** 2) if width > 0 else 1.0 for x, _ in dist]
        want = qry[q] + sum(wi * delta[c] for wi, (_, c) in zip(w, dist)) / sum(w)
        assert np.abs(got[f"b{q:02d}"] - want).max() < 1e-9


def test_interactions_and_slide_means(spark):
    imp = spark.createDataFrame([("S", "intra", "T", f"p{i}", float(v)) for i, v in enumerate([1.0, 2.0, 6.0])] +
                                [("R", "intra", "T", "p0", 3.0)],
                                "sample string, block string, target string, feature string, importance double")
    z = {(r["sample"], r["feature"]): r["z"] for r in vw.interactions(imp, -9.0).collect()}
    x = np.array([1.0, 2.0, 6.0])
    for i in range(3):
        assert abs(z["S", f"p{i}"] - (x[i] - x.mean()) / x.std(ddof=1)) < 1e-12
    assert z["R", "p0"] == 0.0
    assert {r["feature"] for r in vw.interactions(imp, 0.5).collect()} == {"p2"}
    m = {r["feature"]: (r["importance"], r["n_samples"]) for r in vw.collect_results(imp, ["feature"], "importance").collect()}
    assert m == {"p0": (2.0, 2), "p1": (2.0, 1), "p2": (6.0, 1)}


def _planted(spark, n=120, seed=5):
    rng = np.random.default_rng(seed)
    H = np.zeros((3, 9))
    for f in range(3):
        H[f, 3 * f:3 * f + 3] = [0.5, 0.3, 0.2]
    W = rng.uniform(0, 1, (n, 3)) * (rng.uniform(size=(n, 3)) < 0.6)
    X = W @ H
    rows = [("S", f"s{i:03d}", f"t{j}", float(X[i, j])) for i in range(n) for j in range(9) if X[i, j] > 0 or j == 0]
    return X, H, spark.createDataFrame(rows, "sample string, barcode string, cell_type string, score double")


def test_nmf_models_find_the_planted_rank(spark):
    X, H, comp = _planted(spark)
    fit = dc.nmf_models(comp, ranks=(2, 3), restarts=3, max_iters=60)
    table = {(r["rank"], r["restart"]): r for r in fit.table().collect()}
    assert sorted(table) == [(r, s) for r in (2, 3) for s in range(3)]
    best = dict(fit.best())
    xx = float((X * X).sum())
    assert table[3, best[3]]["loss"] < 1e-3 * xx < 0.05 * xx < table[2, best[2]]["loss"]
    assert dc.best_cosine(H, fit.factors[3, best[3]]) > 0.99
    # the numbers of the table against the weights and factors themselves
    for m in fit.factors:
        h = fit.factors[m]
        W = np.zeros((len(X), m[0]))
        for r in fit.weights([m]).collect():
            W[int(r["barcode"][1:]), r["f"]] = r["w"]
        assert W.min() >= 0 and h.min() >= 0
        assert abs(((X - W @ h) ** 2).sum() - table[m]["loss"]) < 1e-9 * xx
        assert abs(np.corrcoef(X.ravel(), (W @ h).ravel())[0, 1] - table[m]["accuracy"]) < 1e-9
        # weights solve the convex problem of their spot: gradient 0 where positive, not negative elsewhere
        grad = (W @ h - X) @ h.T
        assert np.abs(grad[W > 1e-9]).max() < 1e-6 and grad.min() > -1e-6
        others = [dc.best_cosine(h, fit.factors[m[0], o]) for o in range(3) if o != m[1]]
        assert abs(table[m]["stability"] - np.mean(others)) < 1e-12
    total = {}
    for r in fit.profiles([(3, best[3])]).collect():
        total[r["t"]] = total.get(r["t"], 0.0) + r["fraction"]
    assert all(abs(v - 1.0) < 1e-9 for v in total.values())


def test_nmf_models_partitions_repeats_and_empty(spark):
    X, _, comp = _planted(spark, 40)
    a = dc.nmf_models(comp.repartition(7), ranks=(3,), restarts=1, max_iters=5)
    halves = comp.withColumn("score", F.col("score") / 2)
    odd = spark.createDataFrame([("S", "s000", None, 3.0), ("S", "s001", "t0", None)], comp.schema)
    b = dc.nmf_models(halves.unionByName(halves).unionByName(odd), ranks=(3,), restarts=1, max_iters=5)
    assert np.abs(a.factors[3, 0] - b.factors[3, 0]).max() < 1e-9
    none = dc.nmf_models(comp.limit(0), ranks=(3,), restarts=2)
    assert none.table().count() == none.profiles().count() == none.weights().count() == 0


def _planted_views(spark):
    """T0 follows its juxta view, T1 its own intra neighbour type T2; 120 spots of one slide."""
    rng = np.random.default_rng(12)
    intra, juxta, para = (rng.normal(size=(120, 3)) for _ in range(3))
    intra[:, 0] = 2.0 * juxta[:, 0] + 0.1 * rng.normal(size=120)
    intra[:, 1] = -1.5 * intra[:, 2] + 0.1 * rng.normal(size=120)
    rows = [("S", f"b{i}", v, f"T{j}", float(x[i, j])) for v, x in (("intra", intra), ("juxta", juxta), ("para", para))
            for i in range(120) for j in range(3)]
    views = spark.createDataFrame(rows, "sample string, barcode string, view string, cell_type string, value double")
    spots = views.select("sample", "barcode").distinct()
    return intra, vw.view_models(views, spots, ["T0", "T1", "T2"], n_folds=5)


def test_contributions_and_gain_of_planted_views(spark):
    intra, got = _planted_views(spark)
    share = {(r["target"], r["view"]): r["contribution"] for r in got["contributions"].collect()}
    for t in ("T0", "T1", "T2"):
        assert abs(sum(share[t, v] for v in ("intra", "juxta", "para")) - 1) < 1e-9
        assert all(share[t, v] >= 0 for v in ("intra", "juxta", "para"))
    r2 = {(r["target"], r["block"]): r["r2"] for r in got["view_r2"].collect()}
    meta = {r["target"]: r["r2"] for r in got["meta_r2"].collect()}
    gain = {r["target"]: r for r in got["gain"].collect()}
    for t in ("T0", "T1", "T2"):
        assert abs(gain[t]["r2_intra"] - r2[t, "intra"]) < 1e-12 and abs(gain[t]["r2_multi"] - meta[t]) < 1e-12
        assert abs(gain[t]["gain"] - (meta[t] - r2[t, "intra"])) < 1e-12
    # T0 is known from its neighbours only: the other views add what intra cannot say
    assert r2["T0", "intra"] < 0.3 < 0.9 < r2["T0", "juxta"] and gain["T0"]["gain"] > 0.6
    # T1 is known inside the spot: nothing to gain
    assert r2["T1", "intra"] > 0.9 and abs(gain["T1"]["gain"]) < 0.05 and share["T1", "intra"] > 0.8


def test_interaction_communities_of_planted_importances(spark):
    from spotframe.operators import graph as gr
    pairs = [("v", a, b, 1.0) for g in (["A", "B", "C"], ["D", "E", "F"]) for a in g for b in g if a < b] + [("v", "C", "D", 0.1)]
    pairs += [("w", a, b, 1.0) for a, b in (("A", "D"), ("B", "E"))]
    rows = pairs + [(v, b, a, z) for v, a, b, z in pairs]
    e = spark.createDataFrame(rows, "block string, src string, dst string, weight double")
    got = {(r["block"], r["node"]): r["cluster"] for r in gr.graph_clusters(e, 1.0, 8, by=["block"]).collect()}
    parts = {v: {frozenset(n for (b, n), c in got.items() if b == v and c == x) for (b, _), x in got.items() if b == v} for v in "vw"}
    assert parts["v"] == {frozenset("ABC"), frozenset("DEF")}
    assert parts["w"] == {frozenset("AD"), frozenset("BE")}
