import numpy as np

from spotframe.operators import slide as sp
from spotframe.operators import transfer as tf
from spotframe.operators import transport as tr
from tests.test_slide import hex_patch


def test_sinkhorn_flow_support_and_sign(spark):
    spots = hex_patch(spark)
    ce = spark.createDataFrame([("S", "s0", "lr1", "L", 3.0), ("S", "s1", "lr1", "R", 2.0), ("S", "s2", "lr1", "R", 1.0),
                                ("S", "s7", "lr1", "R", 5.0)],
                               "sample string, barcode string, lr string, side string, value double")
    pairs = sp.spot_pairs_within(spots, 120.0, include_self=True)
    allowed = {(r["src"], r["dst"]) for r in pairs.collect()}
    flow = tr.lr_transport(ce, pairs, 120.0, eps=0.1, lam=1.0, iters=10).collect()
    assert flow and all(r["flow"] >= 0 for r in flow)
    assert {(r["src"], r["dst"]) for r in flow} <= allowed
    assert not any(r["dst"] == "s7" for r in flow)   # the isolated receiver gets nothing


def test_harmonize_shrinks_batch_offset(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, (40, 3))
    b = rng.normal(0, 1, (40, 3)) + np.array([3.0, 0.0, 0.0])
    rows = [(f"a{i}", "A", [float(x) for x in v]) for i, v in enumerate(a)] + \
           [(f"b{i}", "B", [float(x) for x in v]) for i, v in enumerate(b)]
    e = spark.createDataFrame(rows, "barcode string, batch string, vec array<double>")
    out = tf.harmonize(e, "batch", 3, 4, sigma=4.0, theta=2.0).collect()
    ma = np.mean([r["vec"][0] for r in out if r["batch"] == "A"])
    mb = np.mean([r["vec"][0] for r in out if r["batch"] == "B"])
    assert abs(mb - ma) < 3.0 * 0.8
