import re

import pytest

from spotframe.operators import lr as lrop


def test_neighbours_meet_whole_spots(spark):
    """One row per spot: entries are shuffled with their spot, not one by one for every neighbour."""
    v = spark.createDataFrame([("S", "a", 0, 1.0), ("S", "a", 2, 2.0), ("S", "b", 0, 4.0), ("S", "lone", 1, 3.0)],
                              "sample string, barcode string, i int, value double")
    edges = spark.createDataFrame([("S", "a", "b"), ("S", "b", "a"), ("S", "b", "none"), ("S", "none", "b")],
                                  "sample string, src string, dst string")
    t = lrop.own_and_neighbors(v, edges)
    got = {r["barcode"]: r for r in t.collect()}
    pairs = lambda r, a, b: sorted(zip(r[a] or [], r[b] or []))
    assert pairs(got["a"], "i", "value") == [(0, 1.0), (2, 2.0)] and pairs(got["a"], "near_i", "near_value") == [(0, 4.0)]
    assert got["b"]["deg"] == 2 and pairs(got["b"], "near_i", "near_value") == [(0, 1.0), (2, 2.0)]
    assert got["none"]["i"] is None and pairs(got["none"], "near_i", "near_value") == [(0, 4.0)]
    assert got["lone"]["deg"] is None and len(got) == 4
    plan = re.sub(r"#\d+", "", t._jdf.queryExecution().executedPlan().toString())
    assert not re.search(r"hashpartitioning\([^)]*\bi\b", plan)


def test_scores_average_each_list_over_all_neighbours(spark):
    e = spark.createDataFrame([("S", "a", "A", 2.0), ("S", "b", "B", 3.0), ("S", "c", "A", 6.0)],
                              "sample string, barcode string, gene string, value double")
    edges = spark.createDataFrame([("S", x, y) for x in "abc" for y in "abc" if x != y], "sample string, src string, dst string")
    db = spark.createDataFrame([("A_B", ["A"], ["B"], "p"), ("B_A", ["B"], ["A"], "p")],
                               "lr string, ligand array<string>, receptor array<string>, pathway string")
    got = {(r["barcode"], r["lr"]): r["score"] for r in lrop.lr_scores(e, edges, db, min_spots=1).collect()}
    # a: L = 2, mR = 3 / 2; b: R = 3, mL = (2 + 6) / 2
    assert got["a", "A_B"] == pytest.approx(0.5 * (2.0 + 1.5)) and got["b", "A_B"] == pytest.approx(0.5 * (3.0 + 4.0))
    assert got["b", "B_A"] == pytest.approx(0.5 * (3.0 + 4.0)) and len(got) == 6
