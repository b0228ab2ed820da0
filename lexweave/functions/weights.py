"""Weights and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rates of the two Poisson distributions.
MU, LAMBDA = 0.013, 0.022
#: Weights are ordered and summed in these units, so that sums don't depend on their order.
UNITS = 1_000_000


def idf(n: Column, df: Column, variant: str = "real") -> Column:
    """ln(n / df), with a real or (`integer`) a whole quotient; `or_one` gives 1 where df is null."""
    if variant == "integer":
        return F.log(F.floor(n / df).cast("double"))
    real = F.log(n.cast("double") / df)
    return F.coalesce(real, F.lit(1.0)) if variant == "or_one" else real


def two_poisson(idf_: Column, tf: Column, length: Column) -> Column:
    """sqrt(idf) / (1 + (mu / lambda)^(tf - 1) * exp(-(mu - lambda) * length))."""
    return F.sqrt(idf_) / (1 + F.pow(F.lit(MU / LAMBDA), tf - 1) * F.exp(F.lit(LAMBDA - MU) * length))


def tf_idf_by_length(idf_: Column, tf: Column, length: Column) -> Column:
    return tf * idf_ / length


def overlap_ratio(common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common), 0 where the denominator is 0."""
    den = a + b - common
    return F.when(den == 0, F.lit(0.0)).otherwise(common / den)


def in_units(weight: Column) -> Column:
    return F.round(weight * UNITS).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """v divided by its length; a zero vector gives NaN in every place."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm == 0, F.lit(float("nan"))).otherwise(x.cast("double") / norm))
