import math
import re

from spotframe.operators import markers as mk
from spotframe.operators import normalize as nm
from spotframe.operators import qc
from spotframe.plans import graph_queries, marker_queries, slide_queries
from spotframe.sources import adapter


def test_ranks_take_one_shuffle_by_gene(spark):
    rows = spark.createDataFrame([("g", 1.0, "A"), ("g", 1.0, "A"), ("g", 1.0, "B"), ("g", 2.0, "B"), ("h", 5.0, "A")],
                                 "gene string, value double, cluster string")
    t = mk._ranked_by_gene(rows, "cluster")
    got = sorted((r["gene"], r["value"], r["cluster"], r["cnt"], r["tie"], r["rank"]) for r in t.collect())
    assert got == [("g", 1.0, "A", 2, 3, 2.0), ("g", 1.0, "B", 1, 3, 2.0), ("g", 2.0, "B", 1, 1, 4.0), ("h", 5.0, "A", 1, 1, 1.0)]
    first = t._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"Exchange hashpartitioning", first)) == 1


def test_counts_read_many_times_are_joined_once(spark, monkeypatch):
    e = spark.createDataFrame([("S", f"b{i}", f"g{j}", float(1 + (i * j) % 4)) for i in range(30) for j in range(30)],
                              "sample string, barcode string, gene string, value double")
    spots = e.select("sample", "barcode").distinct().selectExpr("sample", "barcode", "'A' as cluster")
    monkeypatch.setattr(adapter, "expr", lambda *_: e)
    monkeypatch.setattr(adapter, "spots", lambda *_: spots)
    seen = []
    for module, name in ((nm, "pearson_hvgs"), (qc, "min_features")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda t, *rest, real=real: seen.append(t) or real(t, *rest))
    assert slide_queries.pearson_hvgs(spark, "").count() == 30
    marker_queries.prepared(spark, "")
    assert len(seen) == 2 and all(hasattr(t, "_stage_path") for t in seen)


def test_depths_and_moments_are_computed_once(spark, monkeypatch):
    e = spark.createDataFrame([("S", f"b{i}", f"g{j}", float(1 + (i * j) % 4)) for i in range(30) for j in range(1 + i)],
                              "sample string, barcode string, gene string, value double")
    written, real = [], nm.stage
    monkeypatch.setattr(nm, "stage", lambda t: written.append(sorted(t.columns)) or real(t))
    calls, depth = [], nm.depth
    monkeypatch.setattr(nm, "depth", lambda t: calls.append(t) or depth(t))
    norm = nm.log_normalize(e)
    assert len(calls) == 1 and ["barcode", "depth", "sample"] in written
    totals = sorted(sum(1 + (i * j) % 4 for j in range(1 + i)) for i in range(30))
    row = norm.filter("barcode = 'b2' and gene = 'g1'").first()
    assert abs(row["value"] - math.log1p(3.0 / 5.0 * (totals[14] + totals[15]) / 2)) < 1e-9        # b2 holds 1 + 3 + 1 counts
    nm.hvg_vst(norm, 30, 5).collect()
    assert ["gene", "mean", "nnz", "var"] in written


def test_selected_genes_go_to_the_counts(spark, monkeypatch):
    e = spark.createDataFrame([("S", f"b{i}", f"g{j}", float(1 + (i * j) % 4)) for i in range(30) for j in range(30)],
                              "sample string, barcode string, gene string, value double")
    monkeypatch.setattr(graph_queries, "prepared", lambda *_: (e, e.select("sample", "barcode").distinct()))
    seen = []
    monkeypatch.setattr(graph_queries.em, "pca", lambda z, *_, **__: seen.append(z))
    graph_queries._pca(spark, "")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert re.search(r"BroadcastHashJoin[^\n]*LeftSemi", plan) and not re.search(r"SortMergeJoin[^\n]*LeftSemi", plan)


def test_counts_are_grouped_by_the_keys_as_they_are(spark, tmp_path):
    orders = [(1, 7), (2, 7), (3, 8), (4, None)]
    lines = [(1, 5, 2.0), (2, 5, 3.0), (3, 5, 1.0), (3, 6, 0.0), (4, 5, 4.0), (9, 5, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = adapter.expr(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == [("S1", "7", "5", 5.0), ("S2", "8", "5", 1.0), (None, None, "5", 4.0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[o_custkey#\d+L, l_partkey#\d+L\]", plan)
