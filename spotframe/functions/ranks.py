"""Skew-safe ranking inside a key.

A plain ``rank() OVER (PARTITION BY gene ORDER BY value)`` sorts every value of
a gene in one task; one highly expressed gene can hold a third of all rows.
``average_rank`` instead

1. pre-aggregates duplicate values (map-side combine),
2. cuts each key's value range into ``buckets`` order-preserving slices from
   approximate per-key quantiles (a mergeable sketch, partial aggregation),
3. ranks inside (key, slice) with a window, and
4. adds the slice offset from a running sum over at most ``buckets`` rows per key.

The result is exact (ties share one slice because the slice is a function of
the value); only the work distribution uses the approximate quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_of(bounds: Column, value: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < value))


def average_rank(df: DataFrame, keys: list[str], value: str, weight: str | None = None,
                 buckets: int = 32, out: str = "rank", hot_distinct: int = 100_000) -> DataFrame:
    """Distinct (keys, value) rows with ``cnt``, ``below`` (weight of smaller values)
    and the average-tie rank ``below + (cnt + 1) / 2`` (1-based).

    Only hot keys (more than ``hot_distinct`` distinct values) are sliced; every other key is
    one slice, so the quantile sketches are built for the hot keys alone."""
    w = F.col(weight) if weight else F.lit(1)
    d = df.groupBy(*keys, value).agg(F.sum(w).cast("long").alias("cnt"))
    probs = [i / buckets for i in range(1, buckets)]
    nd = d.groupBy(*keys).agg(F.count("*").alias("_nd"))
    hot = nd.filter(F.col("_nd") > hot_distinct).select(*keys)
    bounds = (d.join(hot, keys, "left_semi").groupBy(*keys)
              .agg(F.percentile_approx(value, probs, 10000).alias("_bounds")))
    d = (d.join(bounds, keys, "left")
         .withColumn("_bucket", F.coalesce(bucket_of(F.col("_bounds"), F.col(value)), F.lit(0)))
         .drop("_bounds"))
    w_local = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_below_local", F.coalesce(F.sum("cnt").over(w_local), F.lit(0)))
    tot = d.groupBy(*keys, "_bucket").agg(F.sum("cnt").alias("_btot"))
    w_off = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_offset", F.coalesce(F.sum("_btot").over(w_off), F.lit(0))).drop("_btot")
    d = (d.join(tot, keys + ["_bucket"])
         .withColumn("below", (F.col("_offset") + F.col("_below_local")).cast("long"))
         .withColumn(out, F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))
         .drop("_bucket", "_offset", "_below_local"))
    return d


def exact_percentiles(df: DataFrame, value: str, qs: list[float], keys: list[str] | None = None,
                      buckets: int = 256, hot_distinct: int = 100_000) -> DataFrame:
    """Exact linear-interpolation quantiles (keys, prob, percentile) without buffering a group in
    one task.  From the distributed ranks of ``average_rank``: position p = (n - 1) q; the order
    statistics at floor(p) and ceil(p) are the distinct values whose [below, below + cnt) covers
    them; result v_lo + (p - floor(p)) (v_hi - v_lo)."""
    keys = list(keys or [])
    k = keys or ["_g"]
    src = df.select(*keys, F.col(value).alias("_v")) if keys else df.select(F.lit(0).alias("_g"), F.col(value).alias("_v"))
    r = average_rank(src, k, "_v", buckets=buckets, hot_distinct=hot_distinct)
    n = r.groupBy(*k).agg(F.sum("cnt").alias("_n"))
    r = r.join(n, k).select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("prob"))
    pos = (F.col("_n") - F.lit(1)).cast("double") * F.col("prob")
    lo_i, hi_i = F.floor(pos), F.ceil(pos)
    hit_lo = (F.col("below") <= lo_i) & (lo_i < F.col("below") + F.col("cnt"))
    hit_hi = (F.col("below") <= hi_i) & (hi_i < F.col("below") + F.col("cnt"))
    agg = r.groupBy(*k, "prob").agg(F.max(F.when(hit_lo, F.col("_v"))).alias("_lo"),
                                    F.max(F.when(hit_hi, F.col("_v"))).alias("_hi"), F.first(pos).alias("_p"))
    res = agg.select(*k, "prob", (F.col("_lo") + (F.col("_p") - F.floor("_p")) * (F.col("_hi") - F.col("_lo"))).alias("percentile"))
    return res.drop("_g") if not keys else res


def exact_percentile(df: DataFrame, value: str, q: float, keys: list[str] | None = None,
                     buckets: int = 256, out: str = "percentile", hot_distinct: int = 100_000) -> DataFrame:
    """Single-probability form of ``exact_percentiles``: (keys, <out>)."""
    r = exact_percentiles(df, value, [q], keys, buckets, hot_distinct)
    return r.drop("prob").withColumnRenamed("percentile", out)
