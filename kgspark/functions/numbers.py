"""Numeric row functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Oxygen pressure at half saturation (mmHg), Hill coefficient, and
# the reading above which a temperature is taken as Fahrenheit.
P50 = 26.6
HILL_N = 2.8
FAHRENHEIT_FROM = 45.0


def celsius(c: Column, above: float = FAHRENHEIT_FROM) -> Column:
    return F.when(c > above, (c - 32) * 5 / 9).otherwise(c)


def oxygen_saturation(pressure: Column, p50: float = P50, n: float = HILL_N) -> Column:
    lifted = F.pow(pressure, F.lit(n))
    return lifted / (lifted + F.pow(F.lit(p50), F.lit(n))) * 100


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean over the non-null columns of a row."""
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return F.try_divide(total, present)
