import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spotframe.operators import composition as cp
from spotframe.operators import graph as gr
from spotframe.operators import transfer as tf


def _emb(spark, pts, prefix="c"):
    return spark.createDataFrame([(f"{prefix}{i:03d}", [float(v) for v in p]) for i, p in enumerate(pts)],
                                 "barcode string, vec array<double>")


def test_knn_exact_vs_numpy(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 1, (60, 8)), rng.normal(6, 1, (60, 8))])
    got = {}
    for r in gr.knn(_emb(spark, pts), 5, bin_occupancy=8).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    for i in range(len(pts)):
        order = sorted((d[i, j], f"c{j:03d}") for j in range(len(pts)) if j != i)[:5]
        assert [x for _, x in sorted(got[f"c{i:03d}"])] == [n for _, n in order]


def test_knn_by_angle_vs_numpy(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([rng.normal(0, 1, (50, 6)) + 1, 40 * rng.normal(0, 1, (50, 6)), np.zeros((1, 6))])
    unit = pts[:-1] / np.linalg.norm(pts[:-1], axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    got = {}
    for r in gr.knn(_emb(spark, pts), 5, bin_occupancy=8, metric="cosine").collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    assert set(got) == {f"c{i:03d}" for i in range(100)}          # the zero vector has no direction
    for i in range(100):
        want = sorted((d[i, j], f"c{j:03d}") for j in range(100) if j != i)[:5]
        assert [x for _, x, _ in sorted(got[f"c{i:03d}"])] == [n for _, n in want]
        assert max(abs(a[2] - b[0]) for a, b in zip(sorted(got[f"c{i:03d}"]), want)) < 1e-12
    q, r = _emb(spark, pts[:3], "q"), _emb(spark, pts[3:])
    near = {x["src"]: x["dst"] for x in gr.knn(q, 1, ref=r, bin_occupancy=8, metric="cosine").collect()}
    assert near == {f"q{i:03d}": f"c{int(d[i, 3:].argmin()):03d}" for i in range(3)}


def test_clustering_recovers_planted_blocks(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 0.3, (40, 4)), rng.normal(5, 0.3, (40, 4))])
    nn = gr.knn(_emb(spark, pts), 8)
    cl = {r["node"]: r["cluster"] for r in gr.graph_clusters(gr.snn(nn, 8), 0.8, 6).collect()}
    a = {cl[f"c{i:03d}"] for i in range(40)}
    b = {cl[f"c{i:03d}"] for i in range(40, 80)}
    assert not (a & b)


def test_transfer_labels_majority(spark):
    rng = np.random.default_rng(9)
    ref = np.vstack([rng.normal(0, 0.2, (20, 3)), rng.normal(4, 0.2, (20, 3))])
    qry = np.array([[0.1, 0.0, 0.0], [3.9, 4.1, 4.0]])
    r = spark.createDataFrame([(f"r{i}", [float(v) for v in p], "X" if i < 20 else "Y") for i, p in enumerate(ref)],
                              "barcode string, vec array<double>, label string")
    _, pred = tf.transfer_labels(r, r, _emb(spark, qry, "q"), 5)
    assert {x["barcode"]: x["predicted"] for x in pred.collect()} == {"q000": "X", "q001": "Y"}


def test_kmeans_planted(spark):
    rows = []
    for i in range(30):
        rows += [("S", f"a{i}", "T1", 0.9), ("S", f"a{i}", "T2", 0.1)]
        rows += [("S", f"b{i}", "T1", 0.1), ("S", f"b{i}", "T2", 0.9)]
    comp = spark.createDataFrame(rows, "sample string, barcode string, cell_type string, score double")
    lab = {r["barcode"]: r["cc"] for r in cp.composition_clusters(comp, 2, 5).collect()}
    assert len({lab[f"a{i}"] for i in range(30)}) == 1 and len({lab[f"b{i}"] for i in range(30)}) == 1
    assert lab["a0"] != lab["b0"]


def test_elbow_by_brute_force_and_in_the_spots_task(spark):
    import hashlib
    rng = np.random.default_rng(4)
    x = rng.dirichlet([0.6] * 4, 60)
    comp = spark.createDataFrame([("S", f"s{i}", f"T{t}", float(v)) for i, r in enumerate(x) for t, v in enumerate(r)],
                                 "sample string, barcode string, cell_type string, score double")
    order = sorted(range(60), key=lambda i: hashlib.md5(f"S/s{i}".encode()).hexdigest())
    want = {}
    for k in range(1, 7):
        c = x[order[:k]]
        for it in range(4):
            d = ((x[:, None] - c) ** 2).sum(2)
            at = d.argmin(1)
            if it < 3:
                c = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
        want[k] = d.min(1).sum()
    got = {r["k"]: r["wcss"] for r in cp.elbow(comp, 6, 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_distances_to_centroids_never_become_rows(spark, monkeypatch):
    """One staged row per spot and model at most: spots x clusters stay inside the tasks."""
    comp = spark.createDataFrame([("S", f"s{i}", f"T{t}", float(i % 7 + t)) for i in range(50) for t in range(3)],
                                 "sample string, barcode string, cell_type string, score double")
    held = []
    monkeypatch.setattr(cp, "cut_lineage", lambda df, f=cp.cut_lineage: held.append(f(df)) or held[-1])
    assert cp.elbow(comp, 5, 2).count() == 5
    assert max(d.count() for d in held) <= 50


def _both_ways(spark, pairs):
    rows = [(a, b, w) for a, b, w in pairs] + [(b, a, w) for a, b, w in pairs]
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def _q(pairs, cl, gamma):
    m2 = 2 * sum(w for *_, w in pairs)
    inner = sum(2 * w for a, b, w in pairs if cl[a] == cl[b]) / m2
    k = {}
    for a, b, w in pairs:
        k[cl[a]] = k.get(cl[a], 0) + w
        k[cl[b]] = k.get(cl[b], 0) + w
    return inner - gamma * sum((v / m2) ** 2 for v in k.values())


def _parts(pairs, nodes):
    left, found = set(nodes), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            v = todo.pop()
            part.add(v)
            near = {b if a == v else a for a, b, _ in pairs if v in (a, b)} & left
            left -= near
            todo += near
        found.append(part)
    return found


def test_settled_clusters_are_connected_and_never_worse(spark):
    rng = np.random.default_rng(31)
    pairs = [(f"n{g}{i}", f"n{g}{j}", float(rng.uniform(0.5, 1))) for g in range(5) for i in range(8) for j in range(i + 1, 8)
             if rng.random() < 0.7] + [(f"n{g}0", f"n{(g + 1) % 5}1", 0.3) for g in range(5)]
    out, trace = gr.settled_clusters(_both_ways(spark, pairs), 1.0)
    cl = {r["node"]: r["cluster"] for r in out.collect()}
    assert set(cl) == {v for a, b, _ in pairs for v in (a, b)}
    assert all(b >= a for a, b in zip(trace, trace[1:])) and abs(_q(pairs, cl, 1.0) - trace[-1]) < 1e-9
    for c in set(cl.values()):
        assert len(_parts(pairs, [v for v in cl if cl[v] == c])) == 1
    planted = {v: v[1] for v in cl}
    assert trace[-1] >= _q(pairs, planted, 1.0) - 1e-9
    assert gr.settled_clusters(_both_ways(spark, pairs).limit(0))[0].count() == 0


def test_connected_parts_of_a_torn_community(spark):
    pairs = [("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0), ("c", "x", 1.0), ("y", "y2", 1.0)]
    lab = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("x", "1"), ("y", "1"), ("y2", "1")], "node string, label string")
    got = {r["node"]: r["label"] for r in gr.connected_parts(_both_ways(spark, pairs), lab).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "x": "x", "y": "x", "y2": "x"}


def test_knn_meets_blocks_without_writing_pairs(spark):
    rng = np.random.default_rng(8)
    pts = rng.integers(0, 3, (90, 3)).astype(float)              # many equal vectors and equal distances
    emb = _emb(spark, np.vstack([pts, pts[:1]]))
    twice = emb.unionByName(emb.filter("barcode = 'c004'")).withColumn("g", F.lit("x"))
    odd = spark.createDataFrame([("n0", None, "x"), (None, [0.0, 0.0, 0.0], "x"), ("n1", [0.0, 0.0, 0.0], None)],
                                "barcode string, vec array<double>, g string")
    got = {}
    for r in gr.knn(twice.unionByName(odd), 4, by=["g"], bin_occupancy=16).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    names = [f"c{i:03d}" for i in range(91)] + ["c004"]
    all_ = np.vstack([pts, pts[:1], pts[4:5]])
    d = np.sqrt(((all_[:, None, :] - all_[None, :, :]) ** 2).sum(-1))
    assert set(got) == set(names)
    for i, src in enumerate(names[:-1]):
        rows = [(d[i, j], dst) for j, dst in enumerate(names) if dst != src] * names.count(src)
        assert [(x, n) for _, n, x in sorted(got[src])] == sorted(rows)[:4]
    plan = gr.knn(emb, 4)._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan


def test_knn_meets_only_blocks_within_reach(spark):
    rng = np.random.default_rng(21)
    pts = np.vstack([c + rng.normal(scale=0.05, size=(64, 4)) for c in rng.uniform(-9, 9, (8, 4))] + [np.zeros((3, 4)), np.full((1, 4), 99.0)])
    emb = _emb(spark, pts)
    names = [f"c{i:03d}" for i in range(len(pts))]
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    got = {}
    for r in gr.knn(emb, 5, bin_occupancy=32).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    for i, src in enumerate(names):
        want = sorted((d[i, j], n) for j, n in enumerate(names) if j != i)[:5]
        assert [n for _, n, _ in sorted(got[src])] == [n for _, n in want]
        assert np.allclose([x for _, _, x in sorted(got[src])], [x for x, _ in want])
    rows = emb.select(F.col("barcode").alias("id"), "vec", F.lit(4).alias("_width"), F.lit(1).cast("long").alias("m"))
    met = gr.block_pairs(rows, rows, ["_width"], 5, True, len(pts), len(pts), 32)
    blocks = met.select("cell", "block").distinct().count()
    assert blocks > 8 and met.count() < blocks * blocks / 3
    far = gr._Nearest(pa.array(["a"]), np.zeros(2), 1, False, np.array([1.0]))
    far.meet(pa.array(["b"]), pa.array([1]), np.array([3.0, 0.0]))
    assert far.rows() is None
    far.meet(pa.array(["c"]), pa.array([1]), np.array([1.0, 0.0]))
    assert far.rows().num_rows == 1
