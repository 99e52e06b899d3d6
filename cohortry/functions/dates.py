"""Date helpers. Period tests are half-open ranges on the bare column, which Parquet can push down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bound(value: str | dt.date) -> Column:
    text = value if isinstance(value, str) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def in_period(ts: str | Column, start: str | dt.date, end: str | dt.date) -> Column:
    """``start <= ts < end``."""
    return (_col(ts) >= _bound(start)) & (_col(ts) < _bound(end))


def in_year(ts: str | Column, year: int) -> Column:
    return in_period(ts, dt.date(year, 1, 1), dt.date(year + 1, 1, 1))


def in_month(ts: str | Column, year: int, month: int) -> Column:
    following = dt.date(year + month // 12, month % 12 + 1, 1)
    return in_period(ts, dt.date(year, month, 1), following)


def hour_between(ts: str | Column, first: int, last: int, *, inclusive: bool = True) -> Column:
    """Hour of day from ``first`` to ``last``; inclusive counts the whole of the last hour."""
    hour = F.hour(_col(ts))
    return hour.between(first, last) if inclusive else (hour >= first) & (hour < last)


def month_name(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "MMMM")


def date_text(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def time_text(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "HH:mm:ss")


def time_text_12h(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "hh:mm:ss a")


def timestamp_text(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss")


def week_text(year: str | Column, week: str | Column) -> Column:
    """``2004-W53`` from its two numbers."""
    return F.concat(_col(year).cast("string"), F.lit("-W"), F.lpad(_col(week).cast("string"), 2, "0"))


def week_label(ts: str | Column) -> Column:
    """Calendar year of the week's Monday and the ISO week number, as ``2004-W53``."""
    monday = F.date_trunc("week", _col(ts))
    return week_text(F.year(monday), F.weekofyear(monday))


def birth_year(visit: str | Column, age: str | Column) -> Column:
    """Year of birth from the age at a visit."""
    return F.year(_col(visit)).cast("bigint") - _col(age)


def age_on(visit: str | Column, age: str | Column, as_of: Column | None = None) -> Column:
    """Age at a later date, by calendar years; today unless ``as_of`` is given."""
    at = F.current_date() if as_of is None else as_of
    return F.year(at).cast("bigint") - F.year(_col(visit)).cast("bigint") + _col(age)


def is_leap_birth(year: str | Column, *, gregorian: bool = True) -> Column:
    """Whether a year has a 29 February; ``gregorian=False`` tests only division by 4."""
    y = _col(year)
    by_four = y % 4 == 0
    return by_four & ((y % 100 != 0) | (y % 400 == 0)) if gregorian else by_four


def decade_label(year: str | Column, unknown: str = "unknown") -> Column:
    """``1930-1939`` style label; ``unknown`` for NULL."""
    start = F.floor(_col(year) / 10).cast("bigint") * 10
    label = F.concat(start.cast("string"), F.lit("-"), (start + 9).cast("string"))
    return F.coalesce(label, F.lit(unknown))
