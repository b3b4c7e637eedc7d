"""Readers for the input formats into the long engine tables.

All readers are lazy Spark reads; the only ordering-dependent step, numbering the
lines of the barcode / feature lists, adds each partition's offset to the line's
place in its partition.  Paths are looked up through Hadoop's file systems, so any
store that Spark reads will do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION_SCHEMA = ("barcode string, in_tissue int, array_row int, array_col int, "
                   "pxl_row_in_fullres double, pxl_col_in_fullres double")
LR_SCHEMA = "ligand string, receptor string, pathway string, annotation string, species string"


def _indexed_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(idx 1-based, columns of a headerless TSV) in file order."""
    # the id is (partition << 33) + place in the partition, and partitions follow the file
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_id"), F.col("value").alias(name))
    lines = lines.withColumn("_part", F.shiftright("_id", 33))
    size = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)    # one row per partition
    size = size.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id") - F.shiftleft("_part", 33)
    return lines.join(size, "_part").select((F.col("_before") + place + 1).alias("idx"), name)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A2: (idx, gene_id, gene_name, type) from a features / genes TSV (gzip read transparently)."""
    lines = _indexed_lines(spark, path, "line")
    parts = F.split("line", "\t")
    return lines.select("idx", parts[0].alias("gene_id"),
                        F.coalesce(parts[1], parts[0]).alias("gene_name"),
                        F.coalesce(parts[2], F.lit("Gene Expression")).alias("type"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    lines = _indexed_lines(spark, path, "barcode")
    return lines.select("idx", F.trim("barcode").alias("barcode"))


def read_mtx_entries(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate entries (gene_idx, barcode_idx, value) of a MatrixMarket file; the
    comment lines and the size line (first non-comment line) are dropped."""
    t = spark.read.text(path).filter(~F.col("value").startswith("%")).withColumn("_id", F.monotonically_increasing_id())
    first = t.agg(F.min("_id")).first()[0]
    parts = F.split(F.trim("value"), r"\s+")
    return t.filter(F.col("_id") != F.lit(first)).select(
        parts[0].cast("long").alias("gene_idx"), parts[1].cast("long").alias("barcode_idx"),
        parts[2].cast("double").alias("value"))


def _first_existing(spark: SparkSession, base: str, names: list[str]) -> str:
    """The first of ``names`` that exists under ``base``, in whatever store that is."""
    conf = spark._jsc.hadoopConfiguration()
    for n in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}")
        if where.getFileSystem(conf).exists(where):
            return f"{base}/{n}"
    raise FileNotFoundError(f"none of {names} under {base}")


def read_10x(spark: SparkSession, directory: str, sample: str, gene_key: str = "gene_id") -> DataFrame:
    """A1: 10x triplet directory -> expr (sample, barcode, gene, value); zeros are absent."""
    mtx = _first_existing(spark, directory, ["matrix.mtx.gz", "matrix.mtx"])
    feats = read_features(spark, _first_existing(spark, directory, ["features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"]))
    bcs = read_barcodes(spark, _first_existing(spark, directory, ["barcodes.tsv.gz", "barcodes.tsv"]))
    e = read_mtx_entries(spark, mtx)
    e = e.join(feats.select(F.col("idx").alias("gene_idx"), F.col(gene_key).alias("gene")), "gene_idx")
    e = e.join(bcs.select(F.col("idx").alias("barcode_idx"), "barcode"), "barcode_idx")
    return e.select(F.lit(sample).alias("sample"), "barcode", "gene", "value").filter(F.col("value") != 0)


def read_positions(spark: SparkSession, path: str, sample: str | None = None, header: bool = True) -> DataFrame:
    """A3: tissue positions CSV (coordinates kept as read; see qc.positions_to_int for B11)."""
    df = spark.read.csv(path, header=header, schema=POSITION_SCHEMA)
    return df.withColumn("sample", F.lit(sample)) if sample is not None else df


def read_scale_factors(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """A4: scale-factor JSON -> one row (sample, tissue_lowres_scalef, tissue_hires_scalef, spot_diameter_fullres)."""
    j = spark.read.option("multiLine", True).json(path)
    cols = {c: (F.col(c).cast("double") if c in j.columns else F.lit(None).cast("double"))
            for c in ["tissue_lowres_scalef", "tissue_hires_scalef", "spot_diameter_fullres"]}
    return j.select(F.lit(sample).alias("sample"), *[v.alias(k) for k, v in cols.items()])


def read_visium(spark: SparkSession, directory: str, sample: str) -> tuple[DataFrame, DataFrame]:
    """A5: counts + positions of one slide: (expr, spots) keyed by (sample, barcode)."""
    expr = read_10x(spark, _first_existing(spark, directory, ["filtered_feature_bc_matrix", "."]), sample)
    pos = read_positions(spark, _first_existing(spark, f"{directory}/spatial",
                                                ["tissue_positions.csv", "tissue_positions_list.csv"]), sample)
    spots = pos.select("sample", "barcode", "in_tissue", "array_row", "array_col",
                       F.col("pxl_col_in_fullres").alias("x"), F.col("pxl_row_in_fullres").alias("y"))
    return expr, spots


def read_composition(spark: SparkSession, path: str, sample: str, barcode_col: str | None = None,
                     drop: tuple = ()) -> DataFrame:
    """Wide CSV (barcode + one numeric column per class) -> long (sample, barcode, cell_type, score)."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    bc = barcode_col or wide.columns[0]
    classes = [c for c in wide.columns if c != bc and c not in drop]
    w = wide.select(F.col(bc).alias("barcode"), *[F.col(f"`{c}`").cast("double").alias(c) for c in classes])
    long = w.unpivot(["barcode"], classes, "cell_type", "score")
    return long.select(F.lit(sample).alias("sample"), "barcode", "cell_type", "score").filter(F.col("score").isNotNull())


def read_annotation(spark: SparkSession, path: str, sample: str | None = None, barcode_col: str | None = None,
                    label_col: str | None = None) -> DataFrame:
    """Annotation CSV (barcode, label[, sample]) -> (sample, barcode, cluster), labels as text.
    The barcode is the first column and the label the second unless named; ``sample`` fills
    in where the file has no such column.  Rows without a label are dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    bc, lab = barcode_col or df.columns[0], label_col or df.columns[1]
    smp = F.col("sample") if "sample" in df.columns else F.lit(sample)
    out = df.select(smp.alias("sample"), F.trim(F.col(f"`{bc}`")).alias("barcode"), F.col(f"`{lab}`").alias("cluster"))
    return out.filter(F.col("cluster").isNotNull())


def load_counts(spark: SparkSession, path: str, fmt: str, sample: str) -> DataFrame:
    """Format dispatch.  10x directory, long CSV / TSV (barcode, gene, value with header),
    or Parquet long table.  HDF5-based formats are not supported."""
    if fmt == "10x":
        return read_10x(spark, path, sample)
    if fmt in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, sep="," if fmt == "csv" else "\t",
                            schema="barcode string, gene string, value double")
    elif fmt == "parquet":
        df = spark.read.parquet(path).select("barcode", "gene", F.col("value").cast("double"))
    else:
        raise ValueError(f"unsupported count format {fmt!r} (h5 / h5ad / loom are not supported)")
    return df.select(F.lit(sample).alias("sample"), "barcode", "gene", "value").filter(F.col("value") != 0)


def load_lr_db(spark: SparkSession, path: str, species: str | None = None, annotation: str | None = None) -> DataFrame:
    """LR catalogue CSV (ligand, receptor, pathway, annotation[, species]); complexes are
    '_'-joined subunits.  Filtered by species / signalling class when given; no network fetch."""
    df = spark.read.csv(path, header=True, schema=LR_SCHEMA)
    if species is not None:
        df = df.filter(F.col("species") == species)
    if annotation is not None:
        df = df.filter(F.col("annotation") == annotation)
    lig = F.split("ligand", "_")
    rec = F.split("receptor", "_")
    return df.select(F.concat(F.array_join(lig, "+"), F.lit("_"), F.array_join(rec, "+")).alias("lr"),
                     lig.alias("ligand"), rec.alias("receptor"), "pathway", "annotation")


def load_samples(spark: SparkSession, dirs: dict[str, str], fmt: str = "10x") -> DataFrame:
    """Several samples appended by name (F1), keyed by the ``sample`` column."""
    parts = [load_counts(spark, p, fmt, s) for s, p in sorted(dirs.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
