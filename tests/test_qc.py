from pyspark.sql import functions as F

from spotframe.operators import qc
from tests.conftest import rows

REGEX_GENES = ["MT-CO1", "mt-nd1", "MTOR", "HBA1", "HBP1", "HB", "HBEGF"]


def test_mt_and_hb_patterns(spark):
    g = spark.createDataFrame([(x, x) for x in REGEX_GENES], "gene_id string, gene_name string")
    mt = {r[0] for r in qc.genes_matching(g, qc.MT_PATTERN).select("gene_name").collect()}
    hb = {r[0] for r in qc.genes_matching(g, qc.HB_PATTERN).select("gene_name").collect()}
    assert mt == {"MT-CO1", "mt-nd1"}
    assert hb == {"HBA1", "HBEGF"}


def test_prefix_split_is_case_sensitive(spark):
    e = spark.createDataFrame([("S", "a", g, 1.0) for g in REGEX_GENES], "sample string, barcode string, gene string, value double")
    main, side = qc.split_genes(e, "MT-")
    assert {r[0] for r in side.select("gene").collect()} == {"MT-CO1"}
    assert main.count() == len(REGEX_GENES) - 1


def tiny_expr(spark):
    # 2 samples x 4 spots x 5 genes; g5 all-zero (absent), g4 constant; spot S1/d empty
    data = []
    for s in ("S0", "S1"):
        for i, b in enumerate("abcd"):
            if s == "S1" and b == "d":
                continue
            data += [(s, b, "g1", float(i + 1)), (s, b, "g4", 2.0)]
            if i % 2 == 0:
                data.append((s, b, "MT-x", 1.0))
    return spark.createDataFrame(data, "sample string, barcode string, gene string, value double")


def test_qc_counts_and_percent(spark):
    e = tiny_expr(spark)
    m = qc.add_qc_metrics(e, {"percent_mt": spark.createDataFrame([("MT-x",)], "gene string"),
                              "percent_hb": spark.createDataFrame([], "gene string")})
    assert "percent_hb" not in m.columns  # empty gene set -> no column
    got = {(r["sample"], r["barcode"]): (r["n_count"], r["n_feature"], round(r["percent_mt"], 6)) for r in m.collect()}
    assert got[("S0", "a")] == (4.0, 3, round(100 / 4, 6))
    assert got[("S0", "b")] == (4.0, 2, 0.0)
    assert ("S1", "d") not in got


def test_min_features_before_min_cells(spark):
    e = tiny_expr(spark)
    kept = qc.create_object(e, min_cells=4, min_feat=3)
    # spots with 3 features: a, c in each sample (4 cells); MT-x is in all 4 -> kept, g1 / g4 too
    assert {(r[0], r[1]) for r in kept.select("sample", "barcode").distinct().collect()} == {
        ("S0", "a"), ("S0", "c"), ("S1", "a"), ("S1", "c")}
    assert {r[0] for r in kept.select("gene").distinct().collect()} == {"g1", "g4", "MT-x"}


def test_positions_truncate_toward_zero(spark):
    df = spark.createDataFrame([("5.9",), ("-5.9",), ("7",)], "x string")
    assert [r[0] for r in qc.positions_to_int(df, ["x"]).collect()] == [5, -5, 7]


def test_parse_groups(spark):
    g = qc.parse_groups(spark, "T,B:Fibro,epi")
    assert rows(g, "group_id", "name") == [(1, "B"), (1, "T"), (2, "Fibro"), (2, "epi")]


def test_drop_empty_and_flag(spark):
    c = spark.createDataFrame([("S", "a", "t1", 0.0), ("S", "a", "t2", 0.0), ("S", "b", "t1", 1.0)],
                              "sample string, barcode string, cell_type string, score double")
    assert rows(qc.drop_empty_spots(c).select("barcode").distinct(), "barcode") == [("b",)]
    spots = spark.createDataFrame([("S", "a"), ("S", "b")], "sample string, barcode string")
    f = qc.flag_members(spots, qc.drop_empty_spots(c))
    assert rows(f, "barcode", "kept") == [("a", 0), ("b", 1)]


def test_require_columns_names_what_is_missing(spark):
    import pytest

    from spotframe.operators import qc
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert qc.require_columns(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="missing required columns: c, d"):
        qc.require_columns(df, ["a", "c", "d"])
