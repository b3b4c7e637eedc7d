import gzip
import json
import os

from spotframe.sources import readers, writers
from tests.conftest import rows


def _write_10x(d):
    os.makedirs(d, exist_ok=True)
    with gzip.open(os.path.join(d, "features.tsv.gz"), "wt") as f:
        f.write("ENSG1\tMT-CO1\tGene Expression\nENSG2\tACTB\tGene Expression\nENSG3\tACTB\tGene Expression\n")
    with gzip.open(os.path.join(d, "barcodes.tsv.gz"), "wt") as f:
        f.write("AAAC-1\nAAAG-1\n")
    with open(os.path.join(d, "matrix.mtx"), "w") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n3 2 4\n1 1 5\n2 1 1\n3 2 7\n2 2 2\n")


def test_read_10x(spark, tmp_path):
    d = str(tmp_path / "s1")
    _write_10x(d)
    e = readers.read_10x(spark, d, "S1")
    assert rows(e, "barcode", "gene", "value") == [("AAAC-1", "ENSG1", 5.0), ("AAAC-1", "ENSG2", 1.0),
                                                   ("AAAG-1", "ENSG2", 2.0), ("AAAG-1", "ENSG3", 7.0)]
    f = readers.read_features(spark, os.path.join(d, "features.tsv.gz"))
    assert rows(f, "idx", "gene_name") == [(1, "MT-CO1"), (2, "ACTB"), (3, "ACTB")]
    both = readers.load_samples(spark, {"A": d, "B": d})
    assert both.count() == 8


def test_positions_scale_and_composition(spark, tmp_path):
    p = tmp_path / "pos.csv"
    p.write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAAAC-1,1,0,0,5.9,-5.9\n")
    pos = readers.read_positions(spark, str(p), "S1").collect()[0]
    assert pos["pxl_row_in_fullres"] == 5.9
    j = tmp_path / "sf.json"
    j.write_text(json.dumps({"tissue_lowres_scalef": 0.05, "tissue_hires_scalef": 0.2}))
    assert readers.read_scale_factors(spark, str(j), "S1").collect()[0]["tissue_lowres_scalef"] == 0.05
    c = tmp_path / "comp.csv"
    c.write_text("barcode,T,B,max\nAAAC-1,0.25,0.75,0.75\n")
    comp = readers.read_composition(spark, str(c), "S1", drop=("max",))
    assert rows(comp, "cell_type", "score") == [("B", 0.75), ("T", 0.25)]


def test_lr_db_and_writers(spark, tmp_path):
    p = tmp_path / "lr.csv"
    p.write_text("ligand,receptor,pathway,annotation,species\nTGFB1,TGFBR1_TGFBR2,TGFb,Secreted,human\nA,B,X,ECM,mouse\n")
    db = readers.load_lr_db(spark, str(p), species="human").collect()
    assert len(db) == 1 and db[0]["receptor"] == ["TGFBR1", "TGFBR2"] and db[0]["lr"] == "TGFB1_TGFBR1+TGFBR2"
    df = spark.createDataFrame([("S0", "g", 1.0), ("S1", "g", 2.0)], "sample string, gene string, value double")
    out = str(tmp_path / "stage")
    writers.save_stage({"expr": df}, out)
    back = writers.load_stage(spark, out, ["expr"])["expr"]
    assert rows(back.filter("sample = 'S1'"), "gene", "value") == [("g", 2.0)]
    writers.write_by(df, "sample", str(tmp_path / "by"))
    assert {"sample=S0", "sample=S1"} <= set(os.listdir(tmp_path / "by"))
    m = writers.to_matrix(df, "gene", "sample", "value", ["S0", "S1", "S2"]).collect()[0]
    assert (m["S0"], m["S1"], m["S2"]) == (1.0, 2.0, 0.0)


def test_annotation_and_visium_bundle(spark, tmp_path):
    a = tmp_path / "anno.csv"
    a.write_text("barcode,cluster,sample\nAAAC-1,3,S9\nAAAG-1,Tumour core,S9\nAAAT-1,,S9\n")
    got = readers.read_annotation(spark, str(a))
    assert rows(got, "sample", "barcode", "cluster") == [("S9", "AAAC-1", "3"), ("S9", "AAAG-1", "Tumour core")]
    d = tmp_path / "slide"
    _write_10x(str(d / "filtered_feature_bc_matrix"))
    (d / "spatial").mkdir()
    (d / "spatial" / "tissue_positions.csv").write_text(
        "barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAAAC-1,1,0,2,10.0,20.0\n")
    expr, spots = readers.read_visium(spark, str(d), "S1")
    assert expr.count() == 4
    assert rows(spots, "barcode", "x", "y", "array_col") == [("AAAC-1", 20.0, 10.0, 2)]


def test_line_numbers_follow_the_file(spark, tmp_path):
    p = tmp_path / "barcodes.tsv"
    p.write_text("".join(f"BC{i}\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = rows(readers.read_barcodes(spark, str(p)), "idx", "barcode")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, f"BC{i}") for i in range(1000)]


def test_write_table_and_matrix(spark, tmp_path):
    df = spark.createDataFrame([("S0", "g", 1.0), ("S1", "h", 2.0)], "sample string, gene string, value double")
    writers.write_table(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2
