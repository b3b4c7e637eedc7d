import math

import numpy as np
import pandas as pd

from spotframe.functions.ranks import average_rank
from spotframe.operators import markers as mk
from spotframe.operators.ranking import top_n_ties


def _fixture(seed=3, n_cells=40, n_genes=6):
    rng = np.random.default_rng(seed)
    dense = rng.integers(0, 4, size=(n_cells, n_genes)).astype(float)  # many zeros and ties
    dense[:, 0] = 0.0
    dense[0, 0] = 1.0  # nearly all-zero gene
    dense[:, 1] = 2.0  # constant gene
    labels = np.array(["A"] * 10 + ["B"] * 15 + ["C"] * 15)
    return dense, labels


def _brute(dense, labels, grp, n_genes):
    out = {}
    N = len(labels)
    for g in range(dense.shape[1]):
        x = dense[:, g]
        r = pd.Series(x).rank(method="average").to_numpy()
        inn = labels == grp
        n1, n2 = inn.sum(), N - inn.sum()
        u = r[inn].sum() - n1 * (n1 + 1) / 2
        _, counts = np.unique(x, return_counts=True)
        ties = (counts.astype(float) ** 3 - counts).sum()
        var = n1 * n2 / 12 * ((N + 1) - ties / (N * (N - 1)))
        if var <= 0:
            p = 1.0
        else:
            z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / math.sqrt(var)
            p = math.erfc(z / math.sqrt(2))
        lfc = math.log2(np.expm1(x[inn]).mean() + 1) - math.log2(np.expm1(x[~inn]).mean() + 1)
        out[f"g{g}"] = (p, lfc, round((x[inn] > 0).mean(), 3), round((x[~inn] > 0).mean(), 3))
    return out


def test_find_markers_matches_dense_rank_sum(spark):
    dense, labels = _fixture()
    rows = [("S", f"c{i}", f"g{g}", float(dense[i, g])) for i in range(dense.shape[0]) for g in range(dense.shape[1])
            if dense[i, g] != 0]
    expr = spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")
    lab = spark.createDataFrame([("S", f"c{i}", labels[i]) for i in range(len(labels))], "sample string, barcode string, cluster string")
    res = mk.find_markers(expr, lab, "cluster", buckets=4, hot_distinct=3).collect()
    assert len(res) == 3 * dense.shape[1]
    for grp in "ABC":
        want = _brute(dense, labels, grp, dense.shape[1])
        for r in [r for r in res if r["cluster"] == grp]:
            p, lfc, p1, p2 = want[r["gene"]]
            assert abs(r["p_val"] - p) < 1e-6 * max(p, 1e-3), (grp, r["gene"], r["p_val"], p)
            assert abs(r["avg_log2fc"] - lfc) < 1e-9
            assert (r["pct_1"], r["pct_2"]) == (p1, p2)
            assert abs(r["p_val_adj"] - min(1.0, r["p_val"] * dense.shape[1])) < 1e-12


def test_markers_of_small_genes_rank_in_one_window(spark, monkeypatch):
    """Genes under ``hot_distinct`` rows need no sliced ranks, and get what the sliced ranks give."""
    dense, labels = _fixture(5)
    rows = [("S", f"c{i}", f"g{g}", float(dense[i, g])) for i in range(dense.shape[0]) for g in range(dense.shape[1])
            if dense[i, g] != 0] + [("S", "c1", None, 1.0), ("S", "c1", "g9", None)]
    expr = spark.createDataFrame(rows, "sample string, barcode string, gene string, value double")
    lab = spark.createDataFrame([("S", f"c{i}", labels[i]) for i in range(len(labels))], "sample string, barcode string, cluster string")
    got = lambda **k: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                             for r in mk.find_markers(expr, lab, "cluster", **k).collect())
    sliced = got(buckets=4, hot_distinct=3)

    def never(*a, **k):
        raise AssertionError("sliced ranks")

    monkeypatch.setattr(mk, "average_rank", never)
    assert got() == sliced and len(sliced) == 3 * dense.shape[1]


def test_average_rank_matches_pandas(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 30, size=500).astype(float)
    keys = rng.integers(0, 3, size=500)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, vals)], "k int, v double")
    got = {(r["k"], r["v"]): r["rank"] for r in average_rank(df, ["k"], "v", buckets=5, hot_distinct=10).collect()}
    pdf = pd.DataFrame({"k": keys, "v": vals})
    pdf["r"] = pdf.groupby("k")["v"].rank(method="average")
    for (k, v), r in pdf.groupby(["k", "v"])["r"].first().items():
        assert got[(k, v)] == r


def test_top_n_keeps_ties(spark):
    df = spark.createDataFrame([("A", "g1", 3.0), ("A", "g2", 2.0), ("A", "g3", 2.0), ("A", "g4", 1.0), ("A", "g5", 2.0)],
                               "cluster string, gene string, avg_log2fc double")
    got = sorted(r["gene"] for r in top_n_ties(df, "cluster", "avg_log2fc", 2).collect())
    assert got == ["g1", "g2", "g3", "g5"]


def test_average_expression_includes_zeros(spark):
    expr = spark.createDataFrame([("S", "a", "g", float(np.log1p(3.0)))], "sample string, barcode string, gene string, value double")
    lab = spark.createDataFrame([("S", "a", "A"), ("S", "b", "A")], "sample string, barcode string, cluster string")
    r = mk.average_expression(expr, lab).collect()[0]
    assert abs(r["avg_exp"] - 1.5) < 1e-12


def test_exact_percentile_matches_numpy(spark):
    from spotframe.functions.ranks import exact_percentile
    rng = np.random.default_rng(11)
    vals = rng.integers(0, 50, size=301).astype(float)
    keys = rng.integers(0, 3, size=301)
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, vals)], "k int, v double")
    for q in (0.5, 0.05, 0.992):
        got = {r["k"]: r["percentile"] for r in exact_percentile(df, "v", q, ["k"], buckets=7, hot_distinct=5).collect()}
        for k in range(3):
            assert abs(got[k] - float(np.quantile(vals[keys == k], q))) < 1e-9
        g = exact_percentile(df, "v", q, hot_distinct=5).collect()[0]["percentile"]
        assert abs(g - float(np.quantile(vals, q))) < 1e-9
