"""Adapter: driver parquet tables -> engine tables.

The driver ships TPC-H-like tables; these functions give rows in the engine
schemas (see FIXTURES.md section 3) and do none of an operator's work.  The
same definitions exist as SQL in ``spotframe.plans.oracle_views`` for DuckDB.

  spots        customer: sample S<key % 6>, hexagonal array position from key div 6
  expr         orders x lineitem: barcode = customer, gene = part key, value = summed quantity
  expr_coarse  same with gene = part name (64 names: dense)
  genes        part: gene_id = part key, gene_name = part name
  composition  share of a spot's counts by part type (6 types)
  lr_db        ligand / receptor pairs over part names (cold with hot)
  embedding    embeddings table, sample = vec_id % 2
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sample(key):
    return F.concat(F.lit("S"), (key % 6).cast("string"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    i = F.expr("c_custkey div 6")
    row = F.expr("(c_custkey div 6) div 10")
    col = 2 * (i % 10) + row % 2
    return c.select(
        _sample(F.col("c_custkey")).alias("sample"),
        F.col("c_custkey").cast("string").alias("barcode"),
        F.lit(1).cast("int").alias("in_tissue"),
        row.cast("int").alias("array_row"),
        col.cast("int").alias("array_col"),
        (F.lit(50.0) * col.cast("double")).alias("x"),
        (F.lit(86.6) * row.cast("double")).alias("y"),
        F.col("c_mktsegment").alias("cluster"),
        F.when(F.col("c_custkey") % 6 < 3, F.lit("C")).otherwise(F.lit("P")).alias("condition"),
    )


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine layer: gene = part key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    # two columns of the orders look small in their files; as rows they would fill the driver.
    # Grouped by the keys as they are: their texts, one for each key, are made of what is left
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
            .groupBy("o_custkey", "l_partkey")
            .agg(F.sum("l_quantity").alias("value"))
            .filter(F.col("value") != 0)
            .select(_sample(F.col("o_custkey")).alias("sample"),
                    F.col("o_custkey").cast("string").alias("barcode"),
                    F.col("l_partkey").cast("string").alias("gene"), "value"))


def expr_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse layer: gene = part name (dense; used by LR / co-occurrence queries)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # neither orders nor parts are as small as rows as they look in their files
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
            .join(p.hint("merge"), li.l_partkey == p.p_partkey)
            .groupBy(_sample(F.col("o_custkey")).alias("sample"),
                     F.col("o_custkey").cast("string").alias("barcode"),
                     F.col("p_name").alias("gene"))
            .agg(F.sum("l_quantity").alias("value"))
            .filter(F.col("value") != 0))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("gene_id"),
                    F.col("p_name").alias("gene_name"),
                    F.col("p_partkey").cast("long").alias("idx"))


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-type shares per spot: share of counts by part type (sums to 1)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # two columns of the orders look small in their files; as rows they would fill the driver
    by_type = (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
               .join(p, li.l_partkey == p.p_partkey)
               .groupBy(_sample(F.col("o_custkey")).alias("sample"),
                        F.col("o_custkey").cast("string").alias("barcode"),
                        F.col("p_type").alias("cell_type"))
               .agg(F.sum("l_quantity").alias("v")))
    w = Window.partitionBy("sample", "barcode")
    return by_type.select("sample", "barcode", "cell_type",
                          (F.col("v") / F.sum("v").over(w)).alias("score"))


# Adjectives of ligand and receptor names (every ligand meets every receptor),
# and the one two-subunit receptor (noun 'ring').  Names with the other adjectives stay
# outside the catalogue (null-model genes).
LIGAND, RECEPTOR = "cold", "hot"
# every pairing of ligand and receptor adjectives, for queries over all catalogue genes
PAIRINGS = {LIGAND: RECEPTOR, "blue": "red"}
COMPLEX_NOUN = "ring"
COMPLEX_EXTRA_SUBUNIT = "hot bolt"


def lr_db(spark: SparkSession, sf_dir: str, pairings: dict[str, str] | None = None) -> DataFrame:
    """Ligand-receptor catalogue derived from the part names: every cold name with every hot one
    (or by ``pairings``, ligand adjective to receptor adjective).

    lr = '<ligand subunits joined by +>_<receptor subunits joined by +>'; the pathway is the
    ligand's noun.  The receptor 'hot ring' is the complex [hot ring, hot bolt].
    """
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    names = names.select(F.split("p_name", " ").getItem(0).alias("adj"),
                         F.split("p_name", " ").getItem(1).alias("noun"),
                         F.col("p_name").alias("name"))
    pairings = pairings or {LIGAND: RECEPTOR}
    partner = F.coalesce(*[F.when(F.col("adj") == a, F.lit(b)) for a, b in pairings.items()])
    lig = names.filter(F.col("adj").isin(*pairings)).select("noun", partner.alias("adj"), F.col("name").alias("lig"))
    rec = names.filter(F.col("adj").isin(*pairings.values())).select("adj", F.col("name").alias("rec"))
    # the catalogue itself: 8 x 8 names for every pairing, at any size
    pairs = lig.join(rec, "adj")
    receptor = F.when((F.col("rec") == F.lit("hot " + COMPLEX_NOUN)),
                      F.array(F.col("rec"), F.lit(COMPLEX_EXTRA_SUBUNIT))).otherwise(F.array(F.col("rec")))
    out = pairs.select(F.array(F.col("lig")).alias("ligand"), receptor.alias("receptor"),
                       F.col("noun").alias("pathway"))
    return out.select(
        F.concat(F.array_join("ligand", "+"), F.lit("_"), F.array_join("receptor", "+")).alias("lr"),
        "ligand", "receptor", "pathway")


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.concat(F.lit("B"), (F.col("vec_id") % 2).cast("string")).alias("sample"),
        F.col("vec_id").cast("string").alias("barcode"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("label"))
