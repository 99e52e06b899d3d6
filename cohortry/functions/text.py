"""Text helpers that fix how NULLs join with other text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def concat_skip_null(*cols: str | Column) -> Column:
    """Join as text, leaving NULLs out; all NULL gives the empty text."""
    return F.concat_ws("", *[_text(c) for c in cols])


def concat_null(*cols: str | Column) -> Column:
    """Join as text; any NULL makes the result NULL."""
    return F.concat(*[_text(c) for c in cols])


def full_name(first: str | Column, last: str | Column) -> Column:
    """First and last name with a space that stays even where one of them is NULL."""
    return concat_skip_null(first, F.lit(" "), last)


def csv_line(*cols: str | Column) -> Column:
    """Comma-separated record; a NULL leaves its place empty so the number of commas is constant."""
    return F.concat_ws(",", *[F.coalesce(_text(c), F.lit("")) for c in cols])


def derived_id(key: str | Column, prefix: str = "UID", factor: int = 1000) -> Column:
    """Identifier text made from a numeric key."""
    number = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(prefix), (number * factor).cast("string"))


def id_number(c: str | Column, skip: int = 1) -> Column:
    """Number that follows the first ``skip`` letters of an identifier such as S0030."""
    return F.substr(_text(c), F.lit(skip + 1)).cast("bigint")


def map_label(c: str | Column, labels: Mapping[object, str], other: str | None = None) -> Column:
    """Label looked up by value; ``other`` for the rest, NULL included only in the rest."""
    col = F.col(c) if isinstance(c, str) else c
    result: Column | None = None
    for value, label in labels.items():
        condition = col == F.lit(value)
        result = F.when(condition, F.lit(label)) if result is None else result.when(condition, F.lit(label))
    if result is None:
        return F.lit(other)
    return result.otherwise(F.lit(other))


def prefixed(c: str | Column, by: str | Column, prefixes: Mapping[object, str]) -> Column:
    """``prefix + text`` with the prefix chosen by another column; NULL where none is chosen."""
    return F.concat(map_label(by, prefixes), _text(c))


def failed_names(tests: Mapping[str, Column], separator: str = ", ") -> Column:
    """Names of the tests that hold for a row, in the order given; empty text if none does."""
    return F.concat_ws(separator, *[F.when(test, F.lit(name)) for name, test in tests.items()])
