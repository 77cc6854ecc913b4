"""Statistics as Column expressions. Unknown is never zero: a null or a zero base gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import constants as C


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    return col(c).cast("double")


def growth_pct(now: Column | str, then: Column | str) -> Column:
    """Percentage growth; null on a null or zero base."""
    return F.when(number(then) != 0, (number(now) / number(then) - 1) * 100)


def excess_pct(growth: Column, base_growth: Column) -> Column:
    """Growth beyond that of the control group."""
    return F.when(1 + base_growth / 100 != 0, ((1 + growth / 100) / (1 + base_growth / 100) - 1) * 100)


def noise_pct(base: Column | str) -> Column:
    """One standard deviation of counting noise, as a percentage of the count."""
    return F.when(number(base) > 0, F.lit(100.0) / F.sqrt(number(base)))


def count_z(now: Column | str, before: Column | str) -> Column:
    """Difference of two counts in units of arrival noise."""
    total = number(now) + number(before)
    return F.when(total > 0, (number(now) - number(before)) / F.sqrt(total))


def ratio_ci(now: Column | str, before: Column | str, upper: bool, z: float = 1.96) -> Column:
    """End of the interval of the percentage change between two counts, by the logarithm of their ratio."""
    a, b = number(now), number(before)
    spread = F.lit(z) * F.sqrt(1 / a + 1 / b)
    return F.when((a > 0) & (b > 0), (F.exp(F.ln(a / b) + (spread if upper else -spread)) - 1) * 100)


def wilson(hits: Column | str, n: Column | str, upper: bool, z: float = 1.96) -> Column:
    """End of the Wilson interval of a share; 0 and 1 without trials."""
    k, m = number(hits), number(n)
    p = k / m
    half = F.lit(z) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    end = (p + z * z / (2 * m) + (half if upper else -half)) / (1 + z * z / m)
    return F.when(m > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), end))).otherwise(F.lit(1.0 if upper else 0.0))


def threshold(base: Column | str, is_index: Column) -> Column:
    """The growth a tier has to show: 10 %, or one standard deviation of its base's noise."""
    return F.when(is_index | number(base).isNull() | (number(base) <= 0), F.lit(C.RISING)).otherwise(F.greatest(F.lit(C.RISING), noise_pct(base)))


def fires(growth: Column | str, base: Column | str, is_index: Column) -> Column:
    """Whether a tier fires: enough growth on a base large enough to believe it."""
    thin = ~is_index & F.coalesce(number(base) < C.MIN_BASE, F.lit(False))
    return F.coalesce(~thin & (number(growth) >= threshold(base, is_index)), F.lit(False))


def why_not(growth: Column | str, base: Column | str, is_index: Column) -> Column:
    """The reason a tier does not fire; null if it does."""
    g, b = number(growth), number(base)
    return (
        F.when(g.isNull(), "no reading")
        .when(~is_index & (b < C.MIN_BASE), "base too small")
        .when(g >= threshold(base, is_index), F.lit(None))
        .when(~is_index & (threshold(base, is_index) > C.RISING), "inside the noise band")
        .otherwise("not rising")
    )


def show_pct(base: Column | str, is_index: Column) -> Column:
    """Whether a percentage may be printed at all."""
    return is_index | F.coalesce(number(base) >= C.MIN_BASE, F.lit(True))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    return F.when(k == 0, F.lit(1.0)).otherwise(F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i))


def binomial_tail(k: Column | str, n: Column | str, p: float = 0.5) -> Column:
    """P(X >= k) of X ~ Binomial(n, p), exact."""
    k, n = col(k), col(n)
    terms = F.when(k <= n, F.sequence(F.greatest(k, F.lit(0)), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, i: acc + choose(n, i) * F.pow(F.lit(p), i) * F.pow(F.lit(1 - p), n - i))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double")))


def fisher_one_sided(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """P of a table with the same margins whose first cell is at least a."""
    a, b, c, d = (col(x).cast("int") for x in (a, b, c, d))
    row1, col1, n = a + b, a + c, a + b + c + d
    fixed = log_factorial(row1) + log_factorial(n - row1) + log_factorial(col1) + log_factorial(n - col1) - log_factorial(n)
    cells = F.sequence(a, F.least(row1, col1))
    return F.aggregate(cells, F.lit(0.0), lambda acc, i: acc + F.exp(fixed - log_factorial(i) - log_factorial(row1 - i) - log_factorial(col1 - i) - log_factorial(n - row1 - col1 + i)))


def median_range(n: Column | str, low: Column | str, high: Column | str, conf: float = 0.95) -> Column:
    """(low, high, coverage) of the median of n values between low and high; null if even this widest interval does not reach conf."""
    cover = 1 - 2 * F.pow(F.lit(0.5), col(n))
    return F.when((col(n) >= 2) & (cover >= conf), F.struct(col(low).alias("low"), col(high).alias("high"), F.round(cover, 4).alias("coverage")))


def median_ci(values: Column, conf: float = 0.95) -> Column:
    """median_range of a sorted array: of the intervals between order statistics that reach conf the widest is taken, which needs the ends only."""
    return median_range(F.size(values), F.get(values, F.lit(0)), F.get(values, F.size(values) - 1), conf)


def sweep_p(n: Column | str) -> Column:
    """P of a perfect sweep of n signs."""
    return F.pow(F.lit(0.5), col(n))


def sweep_needed(hypotheses: int = 3, alpha: float = 0.05) -> int:
    """The least n at which a perfect sweep passes the Bonferroni-corrected level."""
    return math.ceil(math.log(alpha / hypotheses) / math.log(0.5))


def lift(last: Column | str, first: Column | str) -> Column:
    """Smoothed ratio, finite from zero."""
    return (number(last) + 0.5) / (number(first) + 0.5)


def safe_pct(part: Column, whole: Column) -> Column:
    """A share to one place, halves to even; null over nothing."""
    return F.bround(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), 1)


def recovered_base(latest: str, growth: str) -> Column:
    """The count before that a growth in percent was quoted against; null without one."""
    ratio = 1 + F.col(growth) / 100
    return F.when(ratio > 0, F.round(F.col(latest) / ratio))
