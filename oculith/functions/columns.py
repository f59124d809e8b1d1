"""Column helpers: safe statistics, half-even rounding, the normal distribution, binning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the error function's rational approximation (absolute error below 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rows() -> Column:
    """Number of rows of a group."""
    return F.count(F.lit(1))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function as a polynomial, inside code generation."""
    u = F.abs(z) / F.lit(math.sqrt(2))
    t = 1.0 / (1.0 + ERF_P * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1.0 - poly * F.exp(-u * u)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def two_sided_p(t: Column, free: Column, terms: int = 64) -> Column:
    """Chance that Student's t with `free` degrees of freedom is farther from 0 than `t`: Simpson's rule over the angle
    atan(t / sqrt(free)), where the density is a power of the cosine; the scale comes from the same rule over all angles."""
    power = free - 1
    value = lambda at: F.pow(F.cos(at), power)

    def area(upto: Column) -> Column:
        step = upto / float(terms)
        weights = F.transform(F.sequence(F.lit(0), F.lit(terms)), lambda i: F.when((i == 0) | (i == terms), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0) * value(i * step))
        return F.aggregate(weights, F.lit(0.0), lambda s, x: s + x) * step / 3.0

    # Beyond a few hundred degrees of freedom the cosine's power is so narrow that the normal limit of its tail is used.
    most = F.least(F.lit(math.pi / 2), 12.0 / F.sqrt(free))
    inside = area(F.least(F.atan(F.abs(t) / F.sqrt(free)), most)) / area(most)
    return F.when(t.isNotNull() & (free > 0), F.greatest(F.lit(0.0), 1.0 - inside))


def student_quantile(p: float, free: float) -> float:
    """The value that Student's t with `free` degrees of freedom stays under with chance p, by bisection of the integral."""

    def above(t: float, n: int = 4000) -> float:
        most = min(math.pi / 2, 12 / math.sqrt(free))
        area = lambda upto: sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(i * upto / n) ** (free - 1) for i in range(n + 1)) * upto / n / 3
        return 0.5 * (1 - area(min(math.atan(t / math.sqrt(free)), most)) / area(most))

    low, high = 0.0, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return (low + high) / 2


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation; null where a side is constant."""
    x, y = col(x), col(y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def safe_r2(y: Column | str, x: Column | str) -> Column:
    """R squared of y on x; null where a side is constant."""
    y, x = col(y), col(x)
    return F.when(F.var_samp(y) > 0, F.regr_r2(y, x))


def norm2(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def equal_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Number (from 1) of the right-closed equal-width bin between low and high; 1 where the range is empty."""
    at = F.try_divide((x - low) * F.lit(float(n)), high - low)
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(at))), F.lit(1)).cast("int")


def quantile_bin(x: Column, breaks: Column) -> Column:
    """Number (from 1) of the right-closed bin between the breaks (lowest value included); null where breaks repeat."""
    inner = F.slice(breaks, 2, F.size(breaks) - 2)
    return F.when(F.size(F.array_distinct(breaks)) == F.size(breaks), F.size(F.filter(inner, lambda b: x > b)) + 1)


#: Part of the last digit that rounding adds first. Means of regular values lie on ties of the last digit, where the order
#: of a sum would decide; with this they lie beside it.
NUDGE = 7.071e-4


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last digits of sums in another order don't show; -0 becomes 0."""
    near = NUDGE * 10.0**-digits
    return df.select(*[(F.round(F.col(c) + near, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def by(keys: tuple[str, ...], *order: Column | str):
    """A window over the keys, in order if any is given."""
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w
