import math

import numpy as np

from spotframe.operators import slide as sp
from tests.conftest import rows


def hex_patch(spark):
    # 7-spot flower around (2, 4) plus one isolated spot
    cells = [(2, 4), (2, 2), (2, 6), (1, 3), (1, 5), (3, 3), (3, 5), (10, 20)]
    return spark.createDataFrame([("S", f"s{i}", r, c, 50.0 * c, 86.6 * r) for i, (r, c) in enumerate(cells)],
                                 "sample string, barcode string, array_row int, array_col int, x double, y double")


def test_hex_neighbors(spark):
    e = sp.spot_neighbors(hex_patch(spark))
    deg = dict(rows(e.groupBy("src").count(), "src", "count"))
    assert deg["s0"] == 6
    assert "s7" not in deg
    assert e.count() == 6 + 6 * 3  # each petal touches the centre and two petals


def test_pairs_within_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.uniform(0, 1000, size=(120, 2))
    df = spark.createDataFrame([("S", f"p{i}", 0, 0, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "sample string, barcode string, array_row int, array_col int, x double, y double")
    got = {(r["src"], r["dst"]) for r in sp.spot_pairs_within(df, 150.0).collect()}
    want = {(f"p{i}", f"p{j}") for i in range(120) for j in range(120)
            if i != j and math.dist(pts[i], pts[j]) <= 150.0}
    assert got == want


def test_views_juxta_sum(spark):
    spots = hex_patch(spark)
    comp = spark.createDataFrame([("S", f"s{i}", "T", 1.0) for i in range(8)],
                                 "sample string, barcode string, cell_type string, score double")
    v = sp.views(comp, spots, para_l=100.0)
    j = {r["barcode"]: r["value"] for r in v.filter("view = 'juxta'").collect()}
    assert j["s0"] == 6.0 and "s7" not in j


def test_spot_tables_never_go_through_the_driver(spark):
    from spotframe.operators import slide
    spots = spark.createDataFrame([("S", f"s{i}", i // 3, 2 * (i % 3) + i // 3 % 2, 50.0 * (i % 3), 86.6 * (i // 3)) for i in range(9)],
                                  "sample string, barcode string, array_row int, array_col int, x double, y double")
    comp = spots.selectExpr("sample", "barcode", "'T' as cell_type", "1.0D as score")
    joined = slide.views(comp, spots, 100.0)
    assert joined.filter("view = 'intra'").count() == 9
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
