"""Log-densities as Column expressions; results are nats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gaussian(x: Column, mean: Column | float, std: Column | float) -> Column:
    mean, std = _c(mean), _c(std)
    z = (x - mean) / std
    return -0.5 * z * z - F.log(std) - 0.5 * math.log(2 * math.pi)


def bernoulli(on: Column, p: Column | float) -> Column:
    p = _c(p)
    return F.when(on, F.log(p)).otherwise(F.log(1 - p))


def zero_inflated(x: Column, p0: Column | float, mean: Column | float, std: Column | float) -> Column:
    """A mass p0 at 0 and a Gaussian elsewhere."""
    p0 = _c(p0)
    return F.when(x == 0, F.log(p0)).otherwise(F.log(1 - p0) + gaussian(x, mean, std))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function's absolute value; infinite at 0, -1, -2, ... and at both ends."""
    z = F.when(x < 0.5, 1 - x).otherwise(x)
    y = z - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + LANCZOS_G + 0.5
    size = F.abs(0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total))
    out = size * F.when((z > 1) & (z < 2), -1.0).otherwise(1.0)  # the sign holds where the sum is all rounding
    ends = (F.abs(x) == math.inf) | ((x <= 0) & (F.rint(x) == x))
    turn = math.log(math.pi) - F.log(F.abs(F.sin(math.pi * (x - F.rint(x)))))
    return F.when(ends, math.inf).otherwise(out * F.when(x < 0.5, -1.0).otherwise(1.0) + F.when(x < 0.5, turn).otherwise(-0.0))  # adds nothing, to minus 0 neither


def gamma_pdf(x: Column, shape: Column | float, rate: Column | float) -> Column:
    """Minus infinity below 0, and at 0 what the density tends to there: Spark's logarithm of 0 is null."""
    shape, rate = _c(shape), _c(rate)
    log_x = F.when(x > 0, F.log(x)).when(x <= 0, float("-inf"))
    power = F.when((shape == 1) & (x == 0), 0.0).otherwise((shape - 1) * log_x)
    return F.when(x < 0, float("-inf")).otherwise(shape * F.log(rate) + power - rate * x - log_gamma(shape))


def rounded(x: Column, digits: int) -> Column:
    """A negative number that rounds to 0 stays negative, as in SQL; Spark's own gives 0."""
    out = F.round(x, digits)
    return F.when(out == 0, x * 0.0).otherwise(out)


def closeness(x: Column, ideal: float, tolerance: float) -> Column:
    """1 at the ideal, falling as a bell."""
    z = (x - ideal) / tolerance
    return F.exp(-0.5 * z * z)


def log_sum_exp(values: Column) -> Column:
    """Over an array of doubles; minus infinity for an empty one."""
    top = F.array_max(values)
    return F.when(F.size(values) == 0, float("-inf")).otherwise(top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _c(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x
