"""Special functions as column expressions: log gamma, the incomplete beta function, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of a published approximation of the gamma function (relative error below 1e-14).
GAMMA_G = 7
GAMMA_TERMS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function of x > 0 (from 1/2 on at full precision)."""
    y = x - 1
    total = F.lit(GAMMA_TERMS[0])
    for i, c in enumerate(GAMMA_TERMS[1:], 1):
        total = total + c / (y + i)
    t = y + GAMMA_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from the front with both partial sums kept."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
        mid = F.struct(c1.alias("c"), d1.alias("d"), (s["h"] * d1 * c1).alias("h"))

        def second(t: Column) -> Column:
            d2, c2 = 1 / safe(1 + odd * t["d"]), safe(1 + odd / t["c"])
            return F.struct(c2.alias("c"), d2.alias("d"), (t["h"] * d2 * c2).alias("h"))

        return F.transform(F.array(mid), second)[0]

    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b >= 1/2 and x in [0, 1]; null where an input is.

    The fraction converges in about sqrt(max(a, b)) steps on the side that is chosen: 200 serve a and b up to some 10,000.
    """
    lead = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    low = x < (a + 1) / (a + b + 2)
    inside = F.when(low, lead * _fraction(a, b, x, steps) / a).otherwise(1 - lead * _fraction(b, a, 1 - x, steps) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t with df degrees of freedom; null for df < 1 or a null."""
    df = df.cast("double")
    return F.when((df >= 1) & t.isNotNull(), incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def student_p_sql(t: str, n: str) -> str:
    """DuckDB text of the same for whole degrees of freedom n, by the finite series in the angle atan(t / sqrt(n))."""
    angle = f"atan(abs({t}) / sqrt({n}))"
    odd = f"2 / pi() * ({angle} + case when {n} = 1 then 0 else sin({angle}) * cos({angle}) * list_sum(list_transform(range(0, cast(({n} - 1) // 2 as bigint)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + 2 * k * ln(cos({angle}))))) end)"
    even = f"sin({angle}) * list_sum(list_transform(range(0, cast({n} // 2 as bigint)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + 2 * k * ln(cos({angle})))))"
    return f"(case when {n} >= 1 then 1 - (case when {n} % 2 = 1 then {odd} else {even} end) end)"
