"""Statistical special functions as Column expressions (JVM-side, codegen-able).

Spark 4.1 has no erf / erfc / lgamma, so they are written out here.  Each has
a SQL twin (``*_sql``) that emits the same arithmetic as text, used by the
DuckDB oracle, so both engines evaluate the identical formula.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev-fitted coefficients of the complementary error
# function approximation erfc(z) ~ t*exp(-z^2 + P(t)), t = 1/(1+z/2)
# (relative error below 1.2e-7), in order of increasing power of t.
ERFC_COEF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
             0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]

# Lanczos approximation, g = 7, nine coefficients.
LANCZOS_G = 7.0
LANCZOS_COEF = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
                771.32342877765313, -176.61502916214059, 12.507343278686905,
                -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

LOG_SQRT_2PI = 0.5 * math.log(2.0 * math.pi)


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: plain IEEE arithmetic, so every engine agrees."""
    f = float(10 ** digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def round_half_up_sql(x: str, digits: int) -> str:
    f = float(10 ** digits)
    return f"(floor(({x}) * {f!r} + 0.5) / {f!r})"


def _horner(t, coefs):
    acc = coefs[-1]
    for c in reversed(coefs[:-1]):
        acc = c + t * acc
    return acc


def erfc(x: Column) -> Column:
    """Complementary error function."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    ans = t * F.exp(-z * z + _horner(t, [F.lit(c) for c in ERFC_COEF]))
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def erfc_sql(x: str) -> str:
    z = f"abs({x})"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * {z}))"
    poly = f"{ERFC_COEF[-1]!r}::DOUBLE"
    for c in reversed(ERFC_COEF[:-1]):
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN ({x}) >= 0 THEN {ans} ELSE 2.0::DOUBLE - {ans} END)"


def norm_sf_two_sided(z: Column) -> Column:
    """Two-sided normal p-value for a non-negative statistic z."""
    return erfc(z / F.lit(math.sqrt(2.0)))


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x >= 0.5 (all callers pass n + 1 with n >= 0)."""
    xm = x - F.lit(1.0)
    a = F.lit(LANCZOS_COEF[0])
    for i, c in enumerate(LANCZOS_COEF[1:], start=1):
        a = a + F.lit(c) / (xm + F.lit(float(i)))
    t = xm + F.lit(LANCZOS_G + 0.5)
    return F.lit(LOG_SQRT_2PI) + (xm + F.lit(0.5)) * F.log(t) - t + F.log(a)


def log_choose(n: Column, k: Column) -> Column:
    n = n.cast("double")
    k = k.cast("double")
    one = F.lit(1.0)
    return lgamma(n + one) - lgamma(k + one) - lgamma(n - k + one)


def log_choose_sql(n: str, k: str) -> str:
    return f"(lgamma(({n})::DOUBLE + 1) - lgamma(({k})::DOUBLE + 1) - lgamma(({n})::DOUBLE - ({k})::DOUBLE + 1))"


def hyper_terms(lo: Column, hi: Column, N: Column, K: Column, n: Column) -> tuple[Column, Column]:
    """[lo, hi] without the outer terms that are 0.0 as doubles."""
    # P(|X - mean| >= d) <= 2 exp(-2 d^2 / m) for m = min(n, K, N - n, N - K) (Hoeffding, over the
    # symmetries of the distribution): past d = 20 sqrt(m) a term is under exp(-799), which is 0.0 as a double
    mean = F.coalesce(F.try_divide(n.cast("double") * K.cast("double"), N.cast("double")), F.lit(0.0))
    reach = F.lit(20.0) * F.sqrt(F.greatest(F.least(n, K, N - n, N - K).cast("double"), F.lit(0.0))) + F.lit(1.0)
    return F.greatest(lo, F.floor(mean - reach)).cast("int"), F.least(hi, F.ceil(mean + reach)).cast("int")


def _hyper_sum(lo: Column, hi: Column, N: Column, K: Column, n: Column) -> Column:
    lo, hi = hyper_terms(lo, hi, N, K, n)
    base = log_choose(N, n)
    summed = F.aggregate(
        F.sequence(lo, hi), F.lit(0.0),
        lambda acc, x: acc + F.exp(log_choose(K, x) + log_choose(N - K, n - x) - base))
    return F.when(lo <= hi, summed).otherwise(F.lit(0.0))


def hyper_upper(k: Column, N: Column, K: Column, n: Column) -> Column:
    """P(X >= k), X ~ Hypergeometric(population N, successes K, draws n)."""
    lo = F.greatest(k, n + K - N, F.lit(0))
    hi = F.least(K, n)
    return F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _hyper_sum(lo, hi, N, K, n)))


def hyper_lower(k: Column, N: Column, K: Column, n: Column) -> Column:
    """P(X <= k)."""
    lo = F.greatest(n + K - N, F.lit(0))
    hi = F.least(k, K, n)
    return F.least(F.lit(1.0), _hyper_sum(lo, hi, N, K, n))


def _hyper_sum_sql(lo: str, hi: str, N: str, K: str, n: str) -> str:
    term = (f"exp({log_choose_sql(K, 'x')} + {log_choose_sql(f'({N}) - ({K})', f'({n}) - x')}"
            f" - {log_choose_sql(N, n)})")
    return (f"(CASE WHEN ({lo}) <= ({hi}) THEN "
            f"list_sum(list_transform(range(({lo})::BIGINT, ({hi})::BIGINT + 1), lambda x: {term})) "
            f"ELSE 0.0::DOUBLE END)")


def hyper_upper_sql(k: str, N: str, K: str, n: str) -> str:
    lo = f"greatest({k}, ({n}) + ({K}) - ({N}), 0)"
    hi = f"least({K}, {n})"
    return f"(CASE WHEN ({k}) <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {_hyper_sum_sql(lo, hi, N, K, n)}) END)"


def hyper_lower_sql(k: str, N: str, K: str, n: str) -> str:
    lo = f"greatest(({n}) + ({K}) - ({N}), 0)"
    hi = f"least({k}, {K}, {n})"
    return f"least(1.0::DOUBLE, {_hyper_sum_sql(lo, hi, N, K, n)})"


# Portable linear congruential generator (bigint-safe: the id is
# reduced mod 2^31 first, so LCG_A * id stays below 2^63).
LCG_A = 1103515245
LCG_B = 12345
LCG_M = 2147483648


def lcg(id_col: Column, rep: Column | int = 0) -> Column:
    """Deterministic pseudo-random integer in [0, 2^31) from a dense id and replicate."""
    rep_c = rep if isinstance(rep, Column) else F.lit(rep)
    idm = F.pmod(id_col.cast("long"), F.lit(LCG_M))
    s = F.pmod(idm * F.lit(LCG_A) + (rep_c.cast("long") + 1) * F.lit(LCG_B), F.lit(LCG_M))
    return F.pmod(s * F.lit(LCG_A) + F.lit(LCG_B), F.lit(LCG_M))


def lcg_sql(id_expr: str, rep: str = "0") -> str:
    s = f"(((({id_expr})::BIGINT % {LCG_M}) * {LCG_A} + (({rep})::BIGINT + 1) * {LCG_B}) % {LCG_M})"
    return f"(({s} * {LCG_A} + {LCG_B}) % {LCG_M})"


def lcg_unit(id_col: Column, rep: Column | int = 0) -> Column:
    """LCG mapped into (0, 1]."""
    return (lcg(id_col, rep) + F.lit(1)).cast("double") / F.lit(float(LCG_M))


def md5_unit(text: Column) -> Column:
    """Uniform number in (0, 1] from 52 bits of the md5 of a text."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(1)).cast("double") / F.lit(float(1 << 52))


def md5_unit_sql(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 1)::DOUBLE / {float(1 << 52)!r})"
