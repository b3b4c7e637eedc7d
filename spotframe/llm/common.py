"""Shared by the operators: order-preserving buckets and text defaults."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark looks names up without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def order_bounds(df: DataFrame, column: str, buckets: int) -> list[list]:
    """Approximate quantiles of a numeric column, as at most sqrt(buckets) runs of sorted
    bounds (at most ``buckets`` numbers reach the driver, whatever the table's size)."""
    n = max(1, int(buckets))
    got = df.select(F.percentile_approx(column, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    cuts = sorted(set(got or []))
    run = max(1, math.isqrt(len(cuts)))
    return [cuts[i:i + run] for i in range(0, len(cuts), run)]


def order_bucket(column: Column, bounds: list[list]) -> Column:
    """Ordered bucket of a value: equal values share one, larger values never get a
    smaller one; null comes first, with the smallest."""
    if not bounds:
        return F.lit(0)
    heads = F.array(*[F.lit(r[0]) for r in bounds])
    runs = F.array(*[F.array(*[F.lit(v) for v in r]) for r in bounds])
    run = F.size(F.filter(heads, lambda b: b <= column))
    inner = F.size(F.filter(F.get(runs, run - 1), lambda b: b <= column))
    width = max(map(len, bounds)) + 1
    return F.when(column.isNull() | (run == 0), F.lit(0)).otherwise(run * width + inner)
