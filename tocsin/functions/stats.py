"""Robust location and scale, count models, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def median(x) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(_c(x), 0.5)


def quantile(x, p: float) -> Column:
    return F.percentile(_c(x), p)


def nearest_rank(x, p: float) -> Column:
    """The ceil(p n)-th smallest value of a group."""
    values = F.array_sort(F.collect_list(_c(x)))
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.lit(p) * F.count(_c(x)))).cast("int"))


def finite_mean(x) -> Column:
    x = _c(x)
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def weighted_mean(x, w) -> Column:
    x, w = _c(x), _c(w)
    ok = x.isNotNull() & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def half_life_weight(age, half_life: float) -> Column:
    return F.exp(-math.log(2) / half_life * _c(age))


def decayed_mean(x, age, half_life: float) -> Column:
    w = half_life_weight(age, half_life)
    return F.sum(w * _c(x)) / F.sum(w)


def decayed_rms(x, age, half_life: float) -> Column:
    w = half_life_weight(age, half_life)
    return F.sqrt(F.sum(w * _c(x) * _c(x)) / F.sum(w))


def clamp(x, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def round_half_up(x, digits: int = 0) -> Column:
    """Halves go to plus infinity, so -2.5 becomes -2."""
    f = float(10**digits)
    return F.floor(_c(x) * f + 0.5) / f


def robust_by(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, med, mad (scaled; 0 for one value): the median, then the median of distances from it."""
    med = df.groupBy(*keys).agg(F.count(x).alias("n"), median(x).alias("med"))
    joined = df.select(*keys, x).join(med, keys) if keys else df.select(x).crossJoin(F.broadcast(med))
    return joined.groupBy(*keys, "n", "med").agg((median(F.abs(F.col(x) - F.col("med"))) * MAD_SCALE).alias("mad"))


def robust_sigma(mad, med) -> Column:
    """The scale of counts: never under the root of the median, nor under 1."""
    return F.greatest(_c(mad), F.sqrt(F.greatest(_c(med), F.lit(1.0))), F.lit(1.0))


def robust_z(value, med, mad, floor) -> Column:
    """Null where even the floor gives no scale."""
    scale = F.greatest(_c(mad), _c(floor))
    return F.when(scale > 0, (_c(value) - _c(med)) / scale)


def clip_cap(med) -> Column:
    return _c(med) + 4 * F.sqrt(F.greatest(_c(med), F.lit(1.0)))


def upper_tail(count, mean, dispersion, terms: int = 400) -> Column:
    """P(X >= count) of a negative binomial of that mean and dispersion (Poisson at a dispersion of 1), summed from count on.

    The terms are taken by logarithms, so small tails and terms far under the mean keep their precision. The sum goes so far (terms at
    least) that a Bernstein bound puts the rest under 1e-17 of the tail.
    """
    k, mu, d = _c(count).cast("double"), _c(mean), _c(dispersion)
    poisson = d <= 1 + 1e-6
    size = mu / (d - 1)
    upto = F.sequence(F.lit(1).cast("long"), F.greatest(_c(count).cast("long"), F.lit(1).cast("long")))
    first_p = F.aggregate(upto, -mu, lambda a, i: F.when(i <= k, a + F.log(mu / i)).otherwise(a))
    base_nb = -size * F.log(d)
    first_nb = F.aggregate(upto, base_nb, lambda a, i: F.when(i <= k, a + F.log((size + i - 1) / i * (d - 1) / d)).otherwise(a))
    first = F.when(poisson, first_p).otherwise(first_nb)
    far = F.ceil(F.greatest(mu - k, F.lit(0.0)) + 45 * d + F.sqrt(F.pow(45 * d, 2) + 90 * mu * d)) + 60
    last = F.when((mu > 0) & (k > 0), F.greatest(F.lit(terms), far)).otherwise(0).cast("long")
    fold = F.aggregate(
        F.sequence(F.lit(0).cast("long"), last), F.struct(first.alias("log"), F.lit(0.0).alias("tail")),
        lambda a, j: F.struct((a.log + F.log(F.when(poisson, mu / (k + j + 1)).otherwise((size + k + j) / (k + j + 1) * (d - 1) / d))).alias("log"), (a.tail + F.exp(a.log)).alias("tail")),
    )
    return F.when(mu > 0, F.when(k <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), fold.tail)))


def surprise(tail) -> Column:
    return -F.log10(F.greatest(_c(tail), F.lit(1e-300)))
