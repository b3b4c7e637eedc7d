import itertools

import numpy as np

from spotframe.operators import enrich as en
from spotframe.operators import normalize as nm


def _counts(rng, cells, genes, noisy=()):
    depth = rng.uniform(0.5, 2.0, cells)
    mean = np.exp(rng.uniform(-1.0, 2.0, genes))
    shape = np.where(np.isin(np.arange(genes), list(noisy)), 0.15, 5.0)
    return rng.poisson(rng.gamma(np.broadcast_to(shape, (cells, genes)), np.outer(depth, mean / shape))).astype(float)


def _expr(spark, tables):
    rows = [(s, f"c{i:03d}", f"g{j:02d}", float(x[i, j])) for s, x in tables.items()
            for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")


def _trend(x, y, at):
    return 10 ** np.polyval(np.polyfit(x, y, 2), at)


def _standardised(x):
    x = x[x.sum(1) > 0]
    n, mean, var = len(x), x.mean(0), x.var(0, ddof=1)
    ok = (mean > 0) & (var > 0)
    sd = np.sqrt(_trend(np.log10(mean[ok]), np.log10(var[ok]), np.log10(np.where(mean > 0, mean, 1.0))))
    z = np.minimum((x - mean) / sd, np.sqrt(n))
    return {f"g{j:02d}": (z[:, j] ** 2).sum() / (n - 1) for j in range(x.shape[1]) if mean[j] > 0}


def test_variable_genes_by_sample_and_their_union(spark):
    rng = np.random.default_rng(8)
    tables = {"A": _counts(rng, 60, 25, noisy=(3, 7)), "B": _counts(rng, 45, 25, noisy=(3,)),
              "C": _counts(rng, 50, 25, noisy=(3, 7))}
    tables["B"][:, 9] = 0.0                                     # a gene one sample lacks
    hvgs = nm.hvg_vst_by(_expr(spark, tables), n=6)
    got = {(r["sample"], r["gene"]): (r["rank"], r["variance_standardized"]) for r in hvgs.collect()}
    chosen = {}
    for s, x in tables.items():
        want = _standardised(x)
        first = sorted(want, key=lambda g: (-round(want[g], 6), g))[:6]
        assert [g for g in sorted((g for t, g in got if t == s), key=lambda g: got[s, g][0])] == first
        assert all(abs(got[s, g][1] - want[g]) < 1e-5 for g in first)
        for i, g in enumerate(first, 1):
            chosen.setdefault(g, []).append(i)
    order = sorted(chosen, key=lambda g: (-len(chosen[g]), np.median(chosen[g]), g))
    union = nm.integration_features(hvgs, 8).orderBy("rank").collect()
    assert [(r["gene"], r["n_samples"], r["median_rank"], r["rank"]) for r in union] == \
        [(g, len(chosen[g]), float(np.median(chosen[g])), i) for i, g in enumerate(order[:8], 1)]
    assert union[0]["gene"] == "g03"


def test_variable_genes_of_degenerate_samples(spark):
    e = spark.createDataFrame([("A", "c1", "x", 1.0), ("A", "c2", "y", 1.0), ("B", "c1", "x", 2.0)],
                              "sample string, barcode string, gene string, value double")
    got = {(r["sample"], r["gene"]): (r["variance_standardized"], r["rank"]) for r in nm.hvg_vst_by(e).collect()}
    assert got == {("A", "x"): (None, 1), ("A", "y"): (None, 2)}     # no trend through one mean; one cell has no variance
    assert nm.hvg_vst_by(e.limit(0)).count() == 0
    assert nm.pearson_hvgs(e.limit(0), nm.depth(e.limit(0))).count() == 0


def test_pearson_selection_fits_theta_and_finds_planted_genes(spark):
    rng = np.random.default_rng(21)
    noisy = (2, 11, 17)
    x = _counts(rng, 150, 30, noisy)
    x = x[x.sum(1) > 0]
    e = _expr(spark, {"A": x})
    theta = {r["gene"]: r["theta"] for r in nm.fit_theta(e, nm.depth(e)).collect()}
    depth, total = x.sum(1), x.sum(0)
    mu = np.outer(depth, total) / depth.sum()
    excess = ((x - mu) ** 2).sum(0) - total
    ok = excess > 0
    at = np.log10(total / len(x))
    want = np.clip(_trend(at[ok], np.log10((mu ** 2).sum(0)[ok] / excess[ok]), at), *nm.THETA_RANGE)
    assert all(abs(theta[f"g{j:02d}"] / want[j] - 1) < 1e-6 for j in range(30))
    r = np.clip((x - mu) / np.sqrt(mu + mu ** 2 / want), -np.sqrt(len(x)), np.sqrt(len(x)))
    var = r.var(0, ddof=1)
    top = nm.pearson_hvgs(e, nm.depth(e), 5).orderBy("rank").collect()
    assert all(abs(t["var"] - var[int(t["gene"][1:])]) < 1e-5 for t in top)
    assert {t["gene"] for t in top[:3]} == {f"g{j:02d}" for j in noisy}


def test_bitmaps_count_as_cooccurrence_does(spark, monkeypatch):
    monkeypatch.setattr(en, "SPOTS_PER_BUCKET", 40)
    rng = np.random.default_rng(2)
    share = rng.dirichlet(np.full(5, 0.4), 300)
    comp = spark.createDataFrame([("S", f"s{i}", f"t{j}", float(share[i, j])) for i in range(300) for j in range(5)],
                                 "sample string, barcode string, cell_type string, score double")
    lab = spark.createDataFrame([("S", f"s{i}", "big" if i % 10 else "small") for i in range(300)],
                                "sample string, barcode string, cc string")
    cols = ["cc", "a", "b", "k", "n_a", "n_b", "n_total", "expected", "p_le", "p_ge", "call"]
    want = sorted(tuple(r) for r in en.cooccurrence(comp, lab, 0.2).select(cols).collect())
    pairs = spark.createDataFrame(list(itertools.combinations([f"t{j}" for j in range(5)], 2)) + [("t0", "t1"), ("t0", "none")],
                                  "a string, b string")
    present = comp.filter("score > 0.2").select("sample", "barcode", "cell_type")
    got = en.cooccurrence_of(present.unionByName(present), lab, pairs, "cell_type").select(cols)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 20
    assert en.cooccurrence_of(present.limit(0), lab, pairs, "cell_type").count() == 0
