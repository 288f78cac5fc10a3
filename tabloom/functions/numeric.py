"""Numeric expressions Spark does not ship: normal distribution function, normal scores, integer repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.hashing import never_null

# Coefficients of Hart's rational approximation as published by West,
# "Better approximations to cumulative normal functions" (2005). Highest power first.
_HART_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_SQRT_TWO_PI = 2.506628274631
# Fixed value: Winitzki's constant for the inverse error function.
_WINITZKI = 0.147
_PI = 3.141592653589793


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to about 1e-14, as one native expression."""
    x = F.abs(z)
    bell = F.exp(-x * x / F.lit(2.0))
    centre = bell * _polynomial(x, _HART_NUMERATOR) / _polynomial(x, _HART_DENOMINATOR)
    fraction = x + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + F.lit(k) / fraction
    far = bell / fraction / F.lit(_SQRT_TWO_PI)
    tail = F.when(x > 37.0, F.lit(0.0)).when(x < 7.07106781186547, centre).otherwise(far)
    return never_null(F.when(z > 0.0, F.lit(1.0) - tail).otherwise(tail))


def normal_score(rank: Column, size: int | Column) -> Column:
    """Normal score of a 0-based rank among ``size`` rows, by Winitzki's inverse error function."""
    n = F.lit(float(size)) if isinstance(size, int) else size.cast("double")
    x = F.lit(2.0) * ((rank.cast("double") + F.lit(0.5)) / n) - F.lit(1.0)
    log_term = F.log(F.lit(1.0) - x * x)
    half = F.lit(2.0 / (_PI * _WINITZKI)) + log_term / F.lit(2.0)
    magnitude = F.sqrt(F.sqrt(half * half - log_term / F.lit(_WINITZKI)) - half)
    return F.sqrt(F.lit(2.0)) * F.when(x < 0.0, -magnitude).otherwise(magnitude)


def half_even(value: Column, data_type: T.DataType) -> Column:
    """Round half to even, then cast to an integer type; what lies outside its range goes to the nearest end."""
    bits = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}[data_type.simpleString()]
    low = -(2.0 ** (bits - 1))
    high = 2.0 ** (bits - 1) - (1.0 if bits < 64 else 1024.0)  # the largest double below 2^63
    rounded = F.bround(value.cast("double"))
    return F.when(rounded <= low, F.lit(low)).when(rounded >= high, F.lit(high)).otherwise(rounded).cast(data_type)


def as_number(value: Column) -> Column:
    """Double with NaN turned into NULL, so that aggregates skip it."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def as_level(value: Column) -> Column:
    """The text form under which a category is counted; a missing value is the level ``nan``."""
    return F.coalesce(value.cast("string"), F.lit("nan"))


def weighted_class(probabilities: Column, u: Column, n_classes: int) -> Column:
    """Class index drawn from an array of probabilities with one uniform number ``u``."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("index"))

    def step(state: Column, p: Column) -> Column:
        mass = state["mass"] + p
        return F.struct(
            mass.alias("mass"),
            (state["index"] + F.when(mass <= u, F.lit(1)).otherwise(F.lit(0))).alias("index"),
        )

    return F.least(F.aggregate(probabilities, start, step, lambda s: s["index"]), F.lit(n_classes - 1))
