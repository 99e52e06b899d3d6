"""Numeric helpers whose results do not depend on the order rows arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Real division; NULL when the divisor is 0 or NULL."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def percent(part: str | Column, whole: str | Column, digits: int | None = None) -> Column:
    """``100 * part / whole`` of two counts as one division; NULL for an empty whole."""
    value = (F.lit(100) * _col(part)).cast("double") / F.nullif(_col(whole), F.lit(0)).cast("double")
    return value if digits is None else F.round(value, digits)


def cents(c: str | Column) -> Column:
    """A two-decimal amount as whole cents."""
    return F.round(_col(c) * 100).cast("bigint")


def exact_sum(c: str | Column) -> Column:
    """Sum of two-decimal amounts, added as whole cents so that order cannot change the result."""
    return F.sum(cents(c)).cast("double") / F.lit(100.0)


def exact_mean(c: str | Column, digits: int | None = None) -> Column:
    """Mean of two-decimal amounts: integer sum, one division at the end."""
    amount = cents(c)
    value = F.sum(amount).cast("double") / F.nullif(F.lit(100) * F.count(amount), F.lit(0)).cast("double")
    return value if digits is None else F.round(value, digits)


def mean(c: str | Column, digits: int | None = 2) -> Column:
    """Mean, rounded half up to ``digits`` places unless that is None."""
    value = F.avg(_col(c))
    return value if digits is None else F.round(value, digits)


def round_half_up(value: Column, digits: int) -> Column:
    """Round the decimal number meant by a double, not its binary neighbour: 50.225 gives 50.23."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def decimal_mean(c: str | Column, digits: int = 2) -> Column:
    """Mean in decimal arithmetic, rounded half up: exact for measures of up to six decimals."""
    return F.round(F.avg(_col(c).cast("decimal(18,6)")), digits).cast("double")
