"""Exact rounding of integer ratios, as JVM-side Column expressions.

Percentages and averages in the reference are ``CAST(100.0*x/n AS DECIMAL(5,2))``
and ``CAST(AVG(hours) AS DECIMAL(10,1))``. Computing them through DOUBLE or
through engine-specific decimal division lets two engines disagree at rounding
ties. Here every such value is built from integer numerators and
denominators (counts, summed minutes, summed scores) and rounded half away
from zero with one integral division -- the same result on any engine and
on any cluster size, because integer sums do not depend on summation order.

    round_ratio(num, den, s) = sign(num) * ((2*|num|*10^s + den) div (2*den)) * 10^-s

Operands are widened to DECIMAL(38,0) first so that products of large counts
cannot overflow; the quotient itself always fits a BIGINT for the magnitudes
used here (percent, hours, scores).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
# Rates that feed further arithmetic (moving averages, baselines, ranks) are
# carried as integers scaled by 10^RATE_SCALE.
RATE_SCALE = 12


def _col(x: Column | str | int) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``), truncating toward zero; BIGINT result."""
    return F.call_function("div", a, b)


def scaled_ratio(num: Column | str, den: Column | str, scale: int) -> Column:
    """num/den * 10^scale rounded half away from zero, as BIGINT. NULL if den is 0."""
    n = _col(num).cast(WIDE)
    d = F.nullif(_col(den).cast(WIDE), F.lit(0).cast(WIDE))
    q = idiv(F.abs(n) * F.lit(2 * 10**scale).cast(WIDE) + d, d * F.lit(2).cast(WIDE))
    return F.when(n < 0, -q).otherwise(q)


def from_scaled(q: Column, scale: int, precision: int) -> Column:
    """BIGINT scaled by 10^scale -> DECIMAL(precision, scale), exactly."""
    unit = F.lit(Decimal(1).scaleb(-scale))
    return (q.cast("decimal(30,0)") * unit).cast(f"decimal({precision},{scale})")


def round_ratio(num: Column | str, den: Column | str, scale: int, precision: int) -> Column:
    """num/den rounded half away from zero to DECIMAL(precision, scale)."""
    return from_scaled(scaled_ratio(num, den, scale), scale, precision)


def pct(part: Column | str, whole: Column | str, scale: int = 2, precision: int = 5) -> Column:
    """``CAST(100.0*part/whole AS DECIMAL(5,2))`` computed exactly."""
    return round_ratio(_col(part).cast(WIDE) * 100, whole, scale, precision)


def mean_hours(sum_minutes: Column | str, n: Column | str, scale: int = 1, precision: int = 10) -> Column:
    """Mean of per-row hours (= minutes/60) from the summed minutes of n non-null rows."""
    return round_ratio(sum_minutes, _col(n).cast(WIDE) * 60, scale, precision)


def mean(sum_: Column | str, n: Column | str, scale: int = 2, precision: int = 4) -> Column:
    """Mean of integer values from their sum and non-null count."""
    return round_ratio(sum_, n, scale, precision)


def rate_scaled(part: Column | str, whole: Column | str) -> Column:
    """Percent rate as BIGINT scaled by 10^RATE_SCALE (for windows and baselines)."""
    return scaled_ratio(_col(part).cast(WIDE) * 100, whole, RATE_SCALE)
