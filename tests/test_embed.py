import time

import numpy as np
from pyspark.sql import functions as F

from spotframe.operators import embed as em
from spotframe.operators import normalize as nm


def _counts(seed, cells, genes):
    rng = np.random.default_rng(seed)
    x = rng.poisson(rng.uniform(0.2, 3.0, size=genes), size=(cells, genes)).astype(float)
    x[:, 0] += 4.0 * (np.arange(cells) % 2)          # one strong direction
    return x


def _long(spark, x):
    rows = [("S", f"c{i}", f"g{j}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] > 0]
    e = spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")
    cells = spark.createDataFrame([("S", f"c{i}") for i in range(x.shape[0])], "sample string, barcode string")
    return e, cells


def _dense_z(x):
    return np.clip((x - x.mean(0)) / x.std(0, ddof=1), -10, 10)


def test_pca_of_sparse_scaled_values_matches_dense_svd(spark):
    x = _counts(1, 60, 12)
    x[7] = 0                                          # a cell without any entry
    e, cells = _long(spark, x)
    z, absent = nm.scale_genes(e, 60)
    genes = sorted(f"g{j}" for j in range(12))
    got = em.pca(z, genes, 5, cells=cells, absent=absent)
    zd = _dense_z(x)[:, [int(g[1:]) for g in genes]]
    zc = zd - zd.mean(0)
    u, s, vt = np.linalg.svd(zc, full_matrices=False)
    want = s[:5] / np.sqrt(59)
    stdev = [r["stdev"] for r in got["stdev"].orderBy("pc").collect()]
    assert np.abs(np.array(stdev) - want).max() < 1e-8
    load = {(r["gene"], r["pc"]): r["loading"] for r in got["loadings"].collect()}
    for k in range(5):
        v = vt[k] * (1 if vt[k][np.abs(vt[k]).argmax()] > 0 else -1)
        assert np.abs(np.array([load[g, k + 1] for g in genes]) - v).max() < 1e-7
    emb = {r["barcode"]: np.array(r["vec"]) for r in got["embedding"].collect()}
    d = lambda i, j: np.linalg.norm(emb[f"c{i}"] - emb[f"c{j}"])
    full = zc @ vt[:5].T
    for i, j in ((0, 1), (2, 7), (7, 30)):
        assert abs(d(i, j) - np.linalg.norm(full[i] - full[j])) < 1e-7
    top = em.top_loadings(got["loadings"], 2).collect()
    for k in range(5):
        best = sorted(genes, key=lambda g: (-abs(load[g, k + 1]), g))[:2]
        assert [r["gene"] for r in sorted(top, key=lambda r: r["rank"]) if r["pc"] == k + 1] == best


def test_choose_pcs_follows_the_power_law(spark):
    sd = [5.0 * (k + 1) ** -0.7 for k in range(30)]
    df = spark.createDataFrame([(k + 1, s) for k, s in enumerate(sd)], "pc int, stdev double")
    r = em.choose_pcs(df).collect()[0]
    assert abs(r["b"] + 0.7) < 1e-9 and abs(r["a"] - np.log(5.0)) < 1e-9
    drops = -np.diff(sd)
    elbow = int(np.flatnonzero(drops < 0.01 * (max(sd) - min(sd)))[0]) + 1
    assert r["pc_elbow"] == elbow and r["n_chosen"] == min(max(elbow, 5), 20)


def test_pearson_residuals_match_dense(spark):
    x = _counts(3, 40, 8)
    e, cells = _long(spark, x)
    depth = e.groupBy("sample", "barcode").agg(F.sum("value").alias("depth"))
    nz, stats = nm.pearson_residuals(e, depth, theta=100.0)
    mu = np.outer(x.sum(1), x.sum(0)) / x.sum()
    r = np.clip((x - mu) / np.sqrt(mu + mu ** 2 / 100.0), -np.sqrt(40), np.sqrt(40))
    for row in nz.collect():
        assert abs(row["value"] - r[int(row["barcode"][1:]), int(row["gene"][1:])]) < 1e-9
    for row in stats.collect():
        j = int(row["gene"][1:])
        assert abs(row["mean"] - r[:, j].mean()) < 1e-9 and abs(row["var"] - r[:, j].var(ddof=1)) < 1e-9


def test_moments_keep_their_digits(spark):
    rows = [("S", f"c{i}", "g", 1e9 + i) for i in range(5)]
    e = spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")
    r = nm.gene_moments(e, 5).collect()[0]
    assert abs(r["var"] - 2.5) < 1e-6


def test_dense_scaled_fills_absent_entries(spark):
    x = _counts(5, 12, 4)
    e, cells = _long(spark, x)
    z, absent = nm.scale_genes(e, 12)
    got = {(r["barcode"], r["gene"]): r["value"] for r in nm.dense_scaled(z, absent, cells).collect()}
    zd = _dense_z(x)
    assert len(got) == 48
    assert max(abs(got[f"c{i}", f"g{j}"] - zd[i, j]) for i in range(12) for j in range(4)) < 1e-9


def _sparse(spark, rows):
    return spark.createDataFrame([("S", f"c{i}", [int(a) for a in at], [float(v) for v in x]) for i, (at, x) in enumerate(rows)],
                                 "sample string, barcode string, at array<int>, x array<double>")


def test_gram_and_projection_of_cells_with_none_few_and_many_entries(spark, monkeypatch):
    monkeypatch.setattr(em, "PAIRS", 50)                # on the driver, for the direct call below
    rng, p = np.random.default_rng(7), 60
    rows = [(rng.integers(0, p, size=m), rng.normal(size=m)) for m in [0, 1, 2, 45, 2, 0, 60, 3, 1, 30] * 8]   # genes repeat
    dense = np.zeros((len(rows), p + 1))
    for d, (at, x) in zip(dense, rows):
        np.add.at(d, at, x)
    at, x, size = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([len(r[0]) for r in rows])
    for add in (em._add_pairs, em._add_dense):
        total = np.zeros((p + 1, p + 1))
        add(total, at, x, size)
        assert np.abs(total - dense.T @ dense).max() < 1e-9
    dense[:, p] = 1.0
    assert np.abs(em._gram(_sparse(spark, rows), p) - dense.T @ dense).max() < 1e-9
    comp, shift = rng.normal(size=(p, 4)), rng.normal(size=4)
    got = {r["barcode"]: r["vec"] for r in em._project(_sparse(spark, rows), comp, shift).collect()}
    want = dense[:, :p] @ comp - shift
    assert max(np.abs(np.array(got[f"c{i}"]) - want[i]).max() for i in range(len(rows))) < 1e-9


def test_work_of_the_gram_follows_the_entries(spark):
    """60,000 cells of one entry over 3,000 genes: dense blocks took 540 billion products, most of a minute on a core."""
    p, n = 3000, 60_000
    rows = spark.range(0, n, 1, 1).select(F.array((F.col("id") % p).cast("int")).alias("at"), F.array(F.lit(2.0)).alias("x"))
    began = time.monotonic()
    gram = em._gram(rows, p)
    assert time.monotonic() - began < 20
    assert gram[p, p] == n and np.array_equal(np.diag(gram)[:p], np.full(p, 4.0 * n / p)) and gram[:p, p].sum() == 2.0 * n
    assert np.count_nonzero(gram[:p, :p]) == p
