"""Chi-square upper-tail probability as a JVM-side column expression.

Spark SQL has no ``erfc`` or incomplete gamma, and MLlib's ChiSquareTest
(a) omits the continuity correction SciPy applies to 2x2 tables and (b)
returns p = 0.0 far above the magnitudes seen here (p ~ 1e-254). The test
statistic is a distributed aggregate (``lateflow.operators.diagnostics``).

    sf(x; k) = Q(k/2, x/2)      (regularized upper incomplete gamma)

Q is evaluated by the series for P when x/2 < k/2 + 1 and by the Lentz
continued fraction otherwise, as Spark's higher-order ``aggregate`` over a
``sequence``. Both need of the order of sqrt(k) steps where they converge
slowest (x near k), so the number of steps grows with sqrt(k) and no result is
cut off. ln Gamma(k/2) is Stirling's series after an exact shift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _steps(k: Column) -> Column:
    """1, 2, ... as many as the slowest case for ``k`` degrees of freedom needs."""
    return F.sequence(F.lit(1), (F.sqrt(k.cast("double")) * 20.0 + 400.0).cast("int"))


def _lgamma(a: Column) -> Column:
    """ln Gamma(a): shifted by 20, where Stirling's series is exact to the last digits."""
    b = a + 20.0
    stirling = (
        (b - 0.5) * F.log(b) - b + 0.5 * math.log(2 * math.pi)
        + 1.0 / (12.0 * b) - 1.0 / (360.0 * F.pow(b, F.lit(3.0))) + 1.0 / (1260.0 * F.pow(b, F.lit(5.0)))
    )
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(19)), F.lit(0.0), lambda acc, i: acc + F.log(a + i))
    return stirling - shift


def _gamma_p_series(a: Column, h: Column, k: Column) -> Column:
    start = F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total"))

    def step(acc, i):
        term = acc["term"] * h / (a + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(_steps(k), start, step)["total"]


def _gamma_q_fraction(a: Column, h: Column, k: Column) -> Column:
    tiny = F.lit(_TINY)
    b0 = h + 1.0 - a
    start = F.struct(b0.alias("b"), (F.lit(1.0) / tiny).alias("c"), (F.lit(1.0) / b0).alias("d"), (F.lit(1.0) / b0).alias("h"))

    def step(acc, i):
        an = -i * (i - a)
        b = acc["b"] + 2.0
        d = an * acc["d"] + b
        d = F.when(F.abs(d) < tiny, tiny).otherwise(d)
        c = b + an / acc["c"]
        c = F.when(F.abs(c) < tiny, tiny).otherwise(c)
        d = F.lit(1.0) / d
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    return F.aggregate(_steps(k), start, step)["h"]


def log_p_value(statistic: Column, dof: Column) -> Column:
    """ln P(X >= statistic) for X ~ chi-square(dof), as a JVM-side expression.

    Kept in log space on the upper branch, so tails far below the smallest
    double (very large statistics) still have a finite value.
    """
    x = statistic.cast("double")
    k = dof.cast("int")
    a, h = k / 2.0, x / 2.0
    log_front = -h + a * F.log(h) - _lgamma(a)
    lower = _gamma_p_series(a, h, k) * F.exp(log_front)
    log_upper = log_front + F.log(_gamma_q_fraction(a, h, k))
    value = F.when(h < a + 1.0, F.log(F.greatest(F.lit(0.0), F.lit(1.0) - lower))).otherwise(log_upper)
    return F.when(x.isNull() | k.isNull(), F.lit(None).cast("double")).when((k <= 0) | (x <= 0), F.lit(0.0)).otherwise(value)


def p_value(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic) for X ~ chi-square(dof), as a JVM-side expression."""
    return F.exp(log_p_value(statistic, dof))
