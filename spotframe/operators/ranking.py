"""Ranking, top-k, name de-duplication and multiple-testing adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.functions.ranks import average_rank


def top_n_ties(df: DataFrame, by: str | list[str], wt: str, n: int, tie_digits: int | None = 9) -> DataFrame:
    """Top ``n`` rows per group by ``wt`` descending, ties at the cut kept (``rank``).

    The ranking key is ``wt`` rounded to ``tie_digits`` so values equal up to summation
    order (which depends on partitioning) tie deterministically."""
    by = [by] if isinstance(by, str) else by
    key = F.round(F.col(wt), tie_digits) if tie_digits is not None else F.col(wt)
    w = Window.partitionBy(*by).orderBy(key.desc())
    return df.withColumn("_rk", F.rank().over(w)).filter(F.col("_rk") <= n).drop("_rk")


def first_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First k rows under an explicit total order (distributed top-k)."""
    return df.orderBy(*order).limit(k)


def make_unique(genes: DataFrame, name: str = "gene_name", order: str = "idx", out: str = "unique_name") -> DataFrame:
    """E5: 2nd+ occurrence of a name gets '-1', '-2', ... in file order; numbers that would make
    a name the file already has are passed over."""
    key = "_base"
    rn = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    taken = (genes.select(F.regexp_extract(F.col(name), r"^(.*)-([1-9][0-9]{0,8})$", 1).alias(key),
                          F.regexp_extract(F.col(name), r"^(.*)-([1-9][0-9]{0,8})$", 2).alias("_n"))
             .filter(F.col("_n") != "").select(key, F.col("_n").cast("int").alias("_n")).distinct())
    # before the j-th smallest taken number t lie t - j free ones; of free numbers that lie before the same count of
    # taken ones, [from, to) in their own order, each is its place plus that count
    place = F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    after = taken.select(key, (F.col("_n") - place).alias("_from"), place.alias("_shift"))
    after = after.groupBy(key, "_from").agg(F.max("_shift").alias("_shift"))
    upto = F.lead("_from", 1, (1 << 31) - 1).over(Window.partitionBy(key).orderBy("_from"))
    after = after.withColumn("_to", upto)
    hit = (F.col(name) == F.col(key)) & (F.col("_rn") > F.col("_from")) & (F.col("_rn") <= F.col("_to"))
    return (genes.withColumn("_rn", rn).join(after, hit, "left")
            .withColumn(out, F.when(F.col("_rn") == 0, F.col(name)).otherwise(
                F.concat(F.col(name), F.lit("-"), (F.col("_rn") + F.coalesce("_shift", F.lit(0))).cast("string"))))
            .drop("_rn", key, "_from", "_shift", "_to"))


def avg_rank(df: DataFrame, by: list[str], col: str, out: str = "avg_rank") -> DataFrame:
    """Average-tie rank (1-based) of ``col`` within ``by``; a large group is ranked in
    slices (``functions.ranks.average_rank``)."""
    ranks = average_rank(df, by, col, out=out).select(*by, col, out)
    return df.join(ranks, [*by, col])


def bh_adjust(df: DataFrame, p: str = "p", by: list[str] | None = None, out: str = "p_adj",
              m_col: str | None = None) -> DataFrame:
    """Benjamini-Hochberg within each ``by`` group:
    p_adj(i) = min(1, min over j with rank >= rank(i) of p_j * m / rank_j).

    ``m`` is the number of rows in the group, or ``m_col`` when untested hypotheses (p = 1)
    are not materialised; they rank last and cannot lower any adjusted value."""
    by = by or []
    w_rank = Window.partitionBy(*by).orderBy(F.col(p))
    wm = Window.partitionBy(*by)
    m = F.col(m_col) if m_col else F.count("*").over(wm)
    d = (df.withColumn("_m", m)
           .withColumn("_r", F.row_number().over(w_rank))
           .withColumn("_q", F.col(p) * F.col("_m") / F.col("_r")))
    w_suffix = Window.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return (d.withColumn(out, F.least(F.lit(1.0), F.min("_q").over(w_suffix)))
             .drop("_m", "_r", "_q"))


def bonferroni(df: DataFrame, p: str, m: int, out: str = "p_adj") -> DataFrame:
    """min(p * m, 1)."""
    return df.withColumn(out, F.least(F.col(p) * F.lit(float(m)), F.lit(1.0)))
