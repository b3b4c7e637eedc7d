from spotframe.operators import ranking as rk
from tests.conftest import rows


def test_make_unique_file_order(spark):
    g = spark.createDataFrame([("1", "A", 1), ("2", "A", 2), ("3", "B", 3), ("4", "A", 4)], "gene_id string, gene_name string, idx long")
    got = rows(rk.make_unique(g), "gene_id", "unique_name")
    assert got == [("1", "A"), ("2", "A-1"), ("3", "B"), ("4", "A-2")]


def test_bh_monotone_and_capped(spark):
    ps = [0.01, 0.02, 0.03, 0.04, 1.0]
    df = spark.createDataFrame([("s", f"l{i}", p) for i, p in enumerate(ps)], "spot string, lr string, p double")
    got = {r["lr"]: r["p_adj"] for r in rk.bh_adjust(df, "p", ["spot"]).collect()}
    # p * m / rank with reverse cumulative min: 0.05 0.05 0.05 0.05 1.0
    assert [round(got[f"l{i}"], 12) for i in range(5)] == [0.05, 0.05, 0.05, 0.05, 1.0]
    assert all(got[f"l{i}"] >= ps[i] for i in range(5))


def test_bh_with_untested_m(spark):
    df = spark.createDataFrame([("s", "a", 0.01, 4)], "spot string, lr string, p double, m long")
    assert rk.bh_adjust(df, "p", ["spot"], m_col="m").collect()[0]["p_adj"] == 0.04


def test_make_unique_passes_over_names_the_file_has(spark):
    g = spark.createDataFrame([("1", "A", 1), ("2", "A", 2), ("3", "B", 3), ("4", "A", 4), ("5", "A-1", 5), ("6", "A-1", 6)],
                              "gene_id string, gene_name string, idx long")
    got = rows(rk.make_unique(g), "gene_id", "unique_name")
    assert got == [("1", "A"), ("2", "A-2"), ("3", "B"), ("4", "A-3"), ("5", "A-1"), ("6", "A-1-1")]


def test_avg_rank_shares_ties(spark):
    df = spark.createDataFrame([("s", v) for v in (3, 1, 1, 2, 3, 3)], "sample string, v long")
    assert sorted((r["v"], r["avg_rank"]) for r in rk.avg_rank(df, ["sample"], "v").collect()) == \
        [(1, 1.5), (1, 1.5), (2, 3.0), (3, 5.0), (3, 5.0), (3, 5.0)]


def test_make_unique_counts_past_taken_numbers_without_writing_them_out(spark):
    names = ["A"] * 40 + [f"A-{n}" for n in (1, 2, 5, 6, 9, 20, 21, 300)] + ["B"] * 3 + [None, None]
    g = spark.createDataFrame([(str(i), n, i) for i, n in enumerate(names)], "gene_id string, gene_name string, idx long")
    u = rk.make_unique(g)
    want, free = {}, [n for n in range(1, 100) if f"A-{n}" not in names]
    for i, n in enumerate(names):
        before = names[:i].count(n)
        want[str(i)] = n if before == 0 or n is None else f"{n}-{free[before - 1] if n == 'A' else before}"
    assert {r["gene_id"]: r["unique_name"] for r in u.collect()} == want
    assert "sequence(" not in u._jdf.queryExecution().toString()      # as many numbers a row as the name has copies
