"""Measures derived from other measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.numbers import round_half_up


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mean_arterial_pressure(systolic: str | Column, diastolic: str | Column, digits: int | None = None) -> Column:
    """Pressure averaged over the heart cycle: two parts diastolic, one part systolic."""
    value = (F.lit(2) * _col(diastolic) + _col(systolic)) / F.lit(3)
    return value if digits is None else round_half_up(value, digits)


def weight_from_bmi(bmi: str | Column, height: str | Column, digits: int | None = 2) -> Column:
    """Weight in kilograms from body-mass index and height in metres."""
    value = _col(bmi) * (_col(height) * _col(height))
    return value if digits is None else round_half_up(value, digits)


def distance_per_minute(distance: str | Column, minutes: float = 6, digits: int | None = 2) -> Column:
    value = _col(distance) / F.lit(minutes)
    return value if digits is None else round_half_up(value, digits)


def feet_and_inches(metres: str | Column, feet_per_metre: float = 3.28084) -> Column:
    """Height as ``5'11"``, both parts cut to whole numbers."""
    feet = _col(metres) * F.lit(feet_per_metre)
    whole = F.floor(feet).cast("bigint")
    inches = F.floor((feet - whole) * 12).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("'"), inches.cast("string"), F.lit('"'))
