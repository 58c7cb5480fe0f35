"""Step rules of number properties, in plain double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def step_from_min(value: Column, step: float, least: float | None = None) -> Column:
    """Whether (value - least) / step is a whole number, exactly: 0.3 fails a step of 0.1. Steps of 0 and below don't constrain."""
    if step <= 0:
        return F.lit(True)
    quotient = (value - F.lit(float(least or 0.0))) / F.lit(float(step))
    return quotient == F.floor(quotient).cast("double")


def step_mod(value: Column, step: float, tolerance: float = 1e-9) -> Column:
    """Whether the value is a multiple of the step from zero, within a tolerance; a step of 1 asks for a whole number. The remainder keeps the
    dividend's sign, so negative values always pass a step other than 1."""
    if step == 1:
        return value == F.floor(value).cast("double")
    if step <= 0:
        return F.lit(True)
    rest = value % F.lit(float(step))
    return (rest <= tolerance) | (F.abs(rest - step) <= tolerance)
