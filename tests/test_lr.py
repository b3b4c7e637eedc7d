from collections import Counter

from spotframe.functions.stats import LCG_A, LCG_B, LCG_M
from spotframe.operators import lr as lrop
from spotframe.operators import slide as sp
from spotframe.plans import lr_queries
from spotframe.sources import adapter
from tests.test_slide import hex_patch


def _db(spark):
    return spark.createDataFrame([("L1_R1+R2", ["L1"], ["R1", "R2"], "p")],
                                 "lr string, ligand array<string>, receptor array<string>, pathway string")


def test_complex_needs_every_subunit(spark):
    e = spark.createDataFrame([("S", "s0", "L1", 2.0), ("S", "s0", "R1", 3.0), ("S", "s0", "R2", 1.0),
                               ("S", "s1", "R1", 5.0)], "sample string, barcode string, gene string, value double")
    ce = {(r["barcode"], r["side"]): r["value"] for r in lrop.complex_expression(e, _db(spark)).collect()}
    assert ce == {("s0", "L"): 2.0, ("s0", "R"): 1.0}   # s1 lacks R2 -> no receptor complex


def test_lr_score_flower(spark):
    spots = hex_patch(spark)
    edges = sp.spot_neighbors(spots)
    # ligand at the centre (3), receptor complex on two petals (levels 2 and 4); isolated spot has both
    data = [("S", "s0", "L1", 3.0), ("S", "s1", "R1", 2.0), ("S", "s1", "R2", 2.0),
            ("S", "s2", "R1", 4.0), ("S", "s2", "R2", 5.0), ("S", "s7", "L1", 1.0), ("S", "s7", "R1", 1.0),
            ("S", "s7", "R2", 1.0)]
    e = spark.createDataFrame(data, "sample string, barcode string, gene string, value double")
    s = {r["barcode"]: r["score"] for r in lrop.lr_scores(e, edges, _db(spark), min_spots=1).collect()}
    # centre: L=3, mR = (2 + 4) / 6 = 1 -> 0.5 * (3 * 1 + 1 * 1) = 2
    assert abs(s["s0"] - 2.0) < 1e-12
    # petal s1: R=2, mL = 3 / 3 -> 0.5 * (2 * 1 + 1 * 1) = 1.5
    assert abs(s["s1"] - 1.5) < 1e-12
    assert "s7" not in s  # isolated spots score 0


def test_permutation_is_bijection(spark):
    spots = hex_patch(spark)
    idx = lrop.spot_index(spots).collect()
    assert sorted(r["i"] for r in idx) == list(range(8))
    types = spark.createDataFrame([("S", f"s{i}", f"T{i}") for i in range(8)], "sample string, barcode string, cell_type string")
    pt = lrop.permuted_types(types, spots, 5).collect()
    for rep in range(5):
        got = sorted(r["cell_type"] for r in pt if r["rep"] == rep)
        assert got == sorted(f"T{i}" for i in range(8))


def test_permutation_null_is_calibrated(spark):
    """Types dealt at random are no rarer than their own permutations: p is not skewed low."""
    import numpy as np
    rng = np.random.default_rng(8)
    n, side = 144, 12
    spots = spark.createDataFrame([("S", f"s{r:02d}{c:02d}", r, 2 * c + r % 2) for r in range(side) for c in range(side)],
                                  "sample string, barcode string, array_row int, array_col int")
    edges = sp.spot_neighbors(spots)
    names = [f"s{r:02d}{c:02d}" for r in range(side) for c in range(side)]
    db = spark.createDataFrame([(f"l{i}", ["L"], ["R"], "p") for i in range(1)],
                               "lr string, ligand array<string>, receptor array<string>, pathway string")
    ce = spark.createDataFrame([("S", b, "l0", k, 1.0) for b in names for k in ("L", "R")],
                               "sample string, barcode string, lr string, side string, value double")
    stats = spark.createDataFrame([("S", b, "l0", True) for b in names[::2]], "sample string, barcode string, lr string, sig boolean")
    comp = spark.createDataFrame([("S", b, f"T{rng.integers(6)}", 1.0) for b in names],
                                 "sample string, barcode string, cell_type string, score double")
    obs = lrop.cci_counts(stats, None, edges, db, comp, 0.2, 1, ce=ce)
    res = lrop.cci_permutation(stats, None, edges, db, comp, spots, 0.2, 60, obs, ce=ce).collect()
    ps = np.array([r["p"] for r in res])
    assert len(ps) >= 25 and 0.3 < ps.mean() < 0.75 and (ps < 0.1).mean() < 0.3
    # brute force: the same counts from the dealt types, pair by pair
    pt = lrop.permuted_types(comp.select("sample", "barcode", "cell_type"), spots, 3).collect()
    near = {}
    for e in edges.collect():
        near.setdefault(e["src"], set()).add(e["dst"])
    counts = []
    for rep in range(3):
        of = {r["barcode"]: r["cell_type"] for r in pt if r["rep"] == rep}
        c = {}
        for b in names[::2]:
            for t in {of[d] for d in near[b] | {b}}:
                c[of[b], t] = c.get((of[b], t), 0) + 1
        counts.append(c)
    few = {(r["sender"], r["receiver"]): r for r in lrop.cci_permutation(
        stats, None, edges, db, comp, spots, 0.2, 3, obs, ce=ce).collect()}
    for key, r in few.items():
        ge = sum(c.get(key, 0) >= r["n"] for c in counts)
        assert abs(r["p"] - (1 + ge) / 4) < 1e-12


def test_null_of_the_query_by_brute_force(spark):
    """p from 2000 draws, each taken and scored in a plain loop; a lone LR can pass the BH cut-off."""
    from __spark_entry__ import SMOKE_DIR
    f = lr_queries.LRFlow(spark, SMOKE_DIR)
    db = {r["lr"]: (r["ligand"], r["receptor"]) for r in f.lr_db.collect()}
    value, near = {}, {}
    for r in f.expr.collect():
        value.setdefault((r["sample"], r["barcode"]), {})[r["gene"]] = r["value"]
    for e in f.edges.collect():
        near.setdefault((e["sample"], e["src"]), []).append((e["sample"], e["dst"]))

    def level(spot, genes):
        return min(value.get(spot, {}).get(g, 0.0) for g in genes)

    def score(spot, left, right):
        around = near.get(spot, [])
        L, R = level(spot, left), level(spot, right)
        mL, mR = (sum(level(x, g) for x in around) / max(len(around), 1) for g in (left, right))
        return 0.5 * (L * (mR > 0) + (L > 0) * mR + R * (mL > 0) + (R > 0) * mL)

    def lcg(i, rep):
        return ((i * LCG_A + (rep + 1) * LCG_B) % LCG_M * LCG_A + LCG_B) % LCG_M

    def mean(genes):
        return sum(level(s, genes) for s in value) / len(value)

    means = {g: mean([g]) for g in {g for v in value.values() for g in v}}
    ordered = sorted(means.values())
    bounds = [ordered[-(-len(ordered) * i // 10) - 1] for i in range(1, 10)]
    bin_of = lambda m: sum(b < m for b in bounds)
    used = {g for sides in db.values() for genes in sides for g in genes}
    dealt = {}
    for g in sorted(set(means) - used):
        dealt.setdefault(bin_of(means[g]), []).append(g)
    draws = {}
    for lr, (left, right) in db.items():
        bl, br = bin_of(mean(left)), bin_of(mean(right))
        cl, cr, c = dealt.get(bl), dealt.get(br), bl * 10 + br
        picks = [(cl[lcg(k, 2 * c) % len(cl)], cr[lcg(k, 2 * c + 1) % len(cr)]) for k in range(2000)] if cl and cr else []
        draws[lr] = Counter((a, b) for a, b in picks if a != b)
    got = f.pvalues().collect()
    assert len(got) > 500
    for r in got:
        spot, n = (r["sample"], r["barcode"]), draws[r["lr"]]
        assert abs(score(spot, *db[r["lr"]]) - r["score"]) < 1e-9
        ge = sum(m for (a, b), m in n.items() if score(spot, [a], [b]) >= r["score"])
        assert abs(r["p"] - ((1 + ge) / (1 + n.total()) if n else 1.0)) < 1e-12
    assert min(r["p"] for r in got) * len(db) < lr_queries.CUTOFF


def test_permutations_are_a_thousand(spark):
    """A unique pair of neighbours in a patch of 144 spots: 1000 permutations by default."""
    side = 12
    names = [f"s{r:02d}{c:02d}" for r in range(side) for c in range(side)]
    spots = spark.createDataFrame([("S", f"s{r:02d}{c:02d}", r, 2 * c + r % 2) for r in range(side) for c in range(side)],
                                  "sample string, barcode string, array_row int, array_col int")
    edges = sp.spot_neighbors(spots)
    db = spark.createDataFrame([("l0", ["L"], ["R"], "p")],
                               "lr string, ligand array<string>, receptor array<string>, pathway string")
    ce = spark.createDataFrame([("S", b, "l0", k, 1.0) for b in names for k in ("L", "R")],
                               "sample string, barcode string, lr string, side string, value double")
    stats = spark.createDataFrame([("S", b, "l0", True) for b in names], "sample string, barcode string, lr string, sig boolean")
    rare = {"s0505": "A", "s0506": "B"}
    comp = spark.createDataFrame([("S", b, rare.get(b, "T"), 1.0) for b in names],
                                 "sample string, barcode string, cell_type string, score double")
    res = lrop.cci_permutation(stats, None, edges, db, comp, spots, 0.2, ce=ce).collect()
    of = {(r["sender"], r["receiver"]): (r["n"], r["p"]) for r in res}
    near = {(e["src"], e["dst"]) for e in edges.collect()}
    dealt = lrop.permuted_types(comp.select("sample", "barcode", "cell_type"), spots, 1000)
    place = {(r["rep"], r["cell_type"]): r["barcode"] for r in dealt.filter("cell_type <> 'T'").collect()}
    ge = sum((place[k, "A"], place[k, "B"]) in near for k in range(1000))
    assert of["A", "B"] == (1, (1 + ge) / 1001) and 0 < ge
    assert of["A", "A"] == (1, 1.0)
    # the query runs as many
    assert lr_queries.N_PERMS == 1000


def test_null_scores_never_become_rows(spark):
    genes = ["A", "B", *"cdefgh"]
    e = spark.createDataFrame([("S", f"s{i}", g, float(1 + (i * 7 + j * 3) % 5)) for i in range(12) for j, g in enumerate(genes)
                               if (i + j) % 3], "sample string, barcode string, gene string, value double")
    edges = spark.createDataFrame([("S", f"s{i}", f"s{(i + d) % 12}") for i in range(12) for d in (1, 11)],
                                  "sample string, src string, dst string")
    db = spark.createDataFrame([("A_B", ["A"], ["B"], "p")], "lr string, ligand array<string>, receptor array<string>, pathway string")
    scores = lrop.lr_scores(e, edges, db, min_spots=1)
    got = lrop.lr_null_p(e, edges, db, scores, n_pairs=50, n_bins=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "gl#" not in plan        # spots never meet draws in a join
    value = {(r["barcode"], r["gene"]): r["value"] for r in e.collect()}

    def score(i, a, b):
        own = [value.get((f"s{i}", g), 0.0) for g in (a, b)]
        near = [(value.get((f"s{(i + 1) % 12}", g), 0.0) + value.get((f"s{(i - 1) % 12}", g), 0.0)) / 2 for g in (a, b)]
        return 0.5 * (own[0] * (near[1] > 0) + (own[0] > 0) * near[1] + own[1] * (near[0] > 0) + (own[1] > 0) * near[0])
    rows = got.collect()
    assert len(rows) == sum(score(i, "A", "B") > 0 for i in range(12)) > 0
    for r in rows:
        assert r["score"] == score(int(r["barcode"][1:]), "A", "B")
        assert 0 <= r["n_ge"] <= r["n_null"] <= 50 and abs(r["p"] - (1 + r["n_ge"]) / (1 + r["n_null"])) < 1e-12


def test_distinct_genes_of_every_pairing(spark, tmp_path):
    from spotframe.plans.lr_queries import lr_genes_distinct
    names = ["cold bolt", "hot nut", "hot ring", "blue gear", "red gear", "red plate", "green gear"]
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["gene"] for r in lr_genes_distinct(spark, str(tmp_path)).collect()}
    assert got == {*names, "hot bolt"} - {"green gear"}


def test_spot_tables_of_the_flow_keep_what_is_read(spark, tmp_path):
    """Tables of a row per spot and LR are not shuffled by sample and LR, nor with columns nobody reads."""
    names = ["cold bolt", "hot ring", "hot bolt", "blue bolt", "red ring", "red bolt"]
    tables = {"part": ([(i, n) for i, n in enumerate(names)], "p_partkey long, p_name string"),
              "customer": ([(i, "A") for i in range(120)], "c_custkey long, c_mktsegment string"),
              "orders": ([(i, i) for i in range(120)], "o_orderkey long, o_custkey long"),
              "lineitem": ([(i, p, float(1 + (i * p) % 5)) for i in range(120) for p in range(6) if (i + p) % 3],
                           "l_orderkey long, l_partkey long, l_quantity double")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    flow = lr_queries.LRFlow(spark, str(tmp_path))
    assert flow.scores().count() > 0
    assert flow.scores().columns == ["sample", "barcode", "lr", "score"]
    assert flow.pvalues().columns == ["sample", "barcode", "lr", "score", "p"]
    plan = lrop.lr_scores(flow.expr, flow.edges, flow.lr_db, 5, ce=flow.ce())._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in next(line for line in plan.splitlines() if "LeftSemi" in line)


def test_spot_tables_stay_out_of_the_driver(spark, tmp_path):
    spots = [("S", f"b{i}") for i in range(4)]
    stats = spark.createDataFrame([(*s, "l_r", True) for s in spots], "sample string, barcode string, lr string, sig boolean")
    edges = spark.createDataFrame([("S", "b0", "b1"), ("S", "b1", "b0")], "sample string, src string, dst string")
    ce = spark.createDataFrame([(*s, "l_r", side, 1.0) for s in spots[:2] for side in "LR"],
                               "sample string, barcode string, lr string, side string, value double")
    comp = spark.createDataFrame([(*s, "t", 1.0) for s in spots], "sample string, barcode string, cell_type string, score double")
    pairs = lrop._cci_pairs(stats, None, edges, None, ce)
    assert sorted((r["barcode"], r["dst"]) for r in pairs.collect()) == [("b0", "b0"), ("b0", "b1"), ("b1", "b0"), ("b1", "b1")]
    for name, df in (("orders", spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long")),
                     ("lineitem", spark.createDataFrame([(1, 3, 2.0), (2, 3, 1.0)], "l_orderkey long, l_partkey long, l_quantity double")),
                     ("part", spark.createDataFrame([(3, "hot ring")], "p_partkey long, p_name string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    coarse, fine = adapter.expr_coarse(spark, str(tmp_path)), adapter.expr(spark, str(tmp_path))
    assert sorted((r["barcode"], r["gene"], r["value"]) for r in coarse.collect()) == [("7", "hot ring", 2.0), ("8", "hot ring", 1.0)]
    for df in (pairs, coarse, fine, lrop.cci_counts(stats, None, edges, None, comp, 0.2, ce=ce).select("n")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        kept = [line for line in joins if "strategy=merge" in line or "strategy=broadcast" in line]      # no join is left to a guess
        assert joins and kept == joins, plan
