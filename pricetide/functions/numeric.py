"""Numeric expressions. NULL is the one missing marker; NaN is handled only at the edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_INFINITY = float("inf")


def unit_price(spend: Column, quantity: Column) -> Column:
    """Price per unit; a line without quantity has no price and so leaves price means alone."""
    return F.try_divide(spend, quantity)


def finite_or_zero(value: Column) -> Column:
    """NaN and both infinities become 0; NULL stays NULL."""
    broken = F.isnan(value) | (F.abs(value) == _INFINITY)
    return F.when(broken, 0.0).otherwise(value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def non_negative(value: Column) -> Column:
    """Floor at zero. NaN sorts above every number in Spark, so it is sent to NULL first."""
    return F.when(F.isnan(value), None).otherwise(F.greatest(value, F.lit(0.0)))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def standardise(value: Column, center: Column, scale: Column) -> Column:
    return (value - center) / scale


def unstandardise(value: Column, center: Column, scale: Column) -> Column:
    return value * scale + center


def improvement_pct(value: Column, base: Column) -> Column:
    """Change against a base in percent of its size; infinite against a zero base."""
    return F.when(base == 0, F.lit(_INFINITY)).otherwise((value - base) / F.abs(base) * 100)
