import re

import numpy as np

from spotframe.operators import slide as sp
from spotframe.operators import transport as tr
from tests.conftest import rows


def strip(spark, n=200, twice=()):
    """A long slide, several tiles at iters = 1; some spots come with two positions."""
    rng = np.random.default_rng(5)
    at = [(f"b{i}", 40.0 * i + float(rng.uniform(-9, 9)), float(rng.uniform(0, 60))) for i in range(n)]
    spots = [("S", b, x, y) for b, x, y in at] + [("S", *at[i]) for i in twice]
    ce = [("S", f"b{i}", lr, side, float(rng.uniform(0.5, 5)))
          for i in range(n) for lr in ("g+h_r", "q_r", "z_s") for side in "LR" if rng.random() < 0.6]
    return (spark.createDataFrame(spots, "sample string, barcode string, x double, y double"),
            spark.createDataFrame(ce, "sample string, barcode string, lr string, side string, value double"))


def brute(pairs, ce, r, eps, lam, iters):
    level = {}
    for c in ce.collect():
        level.setdefault((c["lr"], c["side"]), {})[c["barcode"]] = c["value"]
    rho, out = lam / (lam + eps), []
    for lr in {k[0] for k in level}:
        a, b = ({k: v / sum(level[lr, s].values()) for k, v in level[lr, s].items()} for s in "LR")
        e = [(p["src"], p["dst"], np.exp(-(p["d"] / r) ** 2 / eps)) for p in pairs if p["src"] in a and p["dst"] in b]
        v = {d: 1.0 for _, d, _ in e}
        for _ in range(iters):
            kv, ku = {}, {}
            for s, d, k in e:
                kv[s] = kv.get(s, 0.0) + k * v[d]
            u = {s: (a[s] / x) ** rho for s, x in kv.items()}
            for s, d, k in e:
                ku[d] = ku.get(d, 0.0) + k * u[s]
            v = {d: (b[d] / x) ** rho for d, x in ku.items()}
        out += [(lr, s, d, u[s] * k * v[d]) for s, d, k in e]
    return sorted(out)


def same(got, want):
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert np.allclose([g[-1] for g in got], [w[-1] for w in want], rtol=1e-10, atol=0)


def test_flow_of_tiles_is_the_flow_of_the_slide(spark):
    spots, ce = strip(spark)
    pairs = sp.spot_pairs_within(spots, 100.0, include_self=True)
    flow = tr.lr_transport(ce, pairs, 100.0, iters=2, spots=spots)
    assert flow._tiles.rows.select("sample", "tx", "ty").distinct().count() > 3
    same(rows(flow, "lr", "src", "dst", "flow"), brute(pairs.collect(), ce, 100.0, 0.1, 1.0, 2))


def test_direction_field_of_tiles_shuffles_no_flow(spark):
    spots, ce = strip(spark, twice=(7, 8, 150))
    pairs = sp.spot_pairs_within(spots, 100.0, include_self=True)
    flow = tr.lr_transport(ce, pairs, 100.0, iters=1, spots=spots)
    catalogue = spark.createDataFrame([("g+h_r", "p"), ("q_r", "p"), ("z_s", "t")], "lr string, pathway string")
    for key, f in (("lr", flow), ("pathway", tr.pathway_flow(flow, catalogue))):
        field = tr.direction_field(f, spots, 2, key)
        plan = re.sub(r"#\d+", "", field._jdf.queryExecution().executedPlan().toString())
        assert f"hashpartitioning(sample, {key}, barcode" not in plan and f"hashpartitioning(sample, {key}, src" not in plan
        plain = f.select("*") if key == "lr" else tr.pathway_flow(flow.select("*"), catalogue)
        want = tr.direction_field(plain, spots, 2, key)
        cols = (key, "barcode", "direction")
        for v in ("vx", "vy"):
            got, ref = rows(field, *cols, v), rows(want, *cols, v)
            assert [g[:3] for g in got] == [w[:3] for w in ref]
            assert np.allclose([g[3] for g in got], [w[3] for w in ref], rtol=1e-8, atol=1e-15)
