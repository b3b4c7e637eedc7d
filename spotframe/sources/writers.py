"""Sinks: delimited tables, per-sample split output, wide matrices at the
sink, and Parquet stage bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "tsv", mode: str = "overwrite", header: bool = True) -> None:
    """A10: CSV / TSV with header; values are written unquoted unless they contain the separator."""
    sep = "\t" if fmt == "tsv" else ","
    df.write.mode(mode).option("header", header).option("sep", sep).option("quoteAll", False).csv(path)


def write_by(df: DataFrame, col: str, path: str, fmt: str = "tsv", mode: str = "overwrite") -> None:
    """One output folder per value of ``col`` (e.g. sample)."""
    sep = "\t" if fmt == "tsv" else ","
    df.write.mode(mode).partitionBy(col).option("header", True).option("sep", sep).csv(path)


def to_matrix(long: DataFrame, row: str, col: str, value: str, cols: list[str], digits: int | None = 6) -> DataFrame:
    """Wide row x column matrix for an explicit, bounded column list (missing = 0)."""
    v = F.round(F.col(value), digits) if digits is not None else F.col(value)
    w = long.select(row, col, v.alias(value)).groupBy(row).pivot(col, cols).agg(F.first(value))
    return w.fillna(0.0, cols)


def write_matrix(long: DataFrame, row: str, col: str, value: str, cols: list[str], path: str,
                 fmt: str = "tsv") -> None:
    write_table(to_matrix(long, row, col, value, cols), path, fmt)


def save_stage(tables: dict[str, DataFrame], path: str, partition_by: tuple = ("sample",), mode: str = "overwrite") -> None:
    """Persist a stage as one Parquet table per name, partitioned by sample where present."""
    for name, df in tables.items():
        parts = [c for c in partition_by if c in df.columns]
        w = df.write.mode(mode)
        if parts:
            w = w.partitionBy(*parts)
        w.parquet(f"{path}/{name}")


def load_stage(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Reload a saved stage (partition pruning applies to filters on sample)."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
