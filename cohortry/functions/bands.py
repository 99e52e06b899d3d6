"""Classification of a value into ordered bands and fixed-width bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOSED = ("left", "right", "both", "neither")


@dataclass(frozen=True)
class Band:
    """One labelled range; ``closed`` says which ends belong to it, None leaves an end open."""

    label: str
    lo: float | None = None
    hi: float | None = None
    closed: str = "left"

    def __post_init__(self) -> None:
        if self.closed not in _CLOSED:
            raise ValueError(f"closed must be one of {_CLOSED}")
        if self.lo is None and self.hi is None:
            raise ValueError("a band needs at least one limit")

    @property
    def closed_left(self) -> bool:
        return self.closed in ("left", "both")

    @property
    def closed_right(self) -> bool:
        return self.closed in ("right", "both")

    def holds(self, value: Column) -> Column:
        tests = []
        if self.lo is not None:
            tests.append(value >= F.lit(self.lo) if self.closed_left else value > F.lit(self.lo))
        if self.hi is not None:
            tests.append(value <= F.lit(self.hi) if self.closed_right else value < F.lit(self.hi))
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def below(label: str, hi: float, *, inclusive: bool = False) -> Band:
    return Band(label, None, hi, "right" if inclusive else "neither")


def at_least(label: str, lo: float, *, inclusive: bool = True) -> Band:
    return Band(label, lo, None, "left" if inclusive else "neither")


def between(label: str, lo: float, hi: float, closed: str = "both") -> Band:
    return Band(label, lo, hi, closed)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(
    c: str | Column, bands: Sequence[Band], other: str | None = None, *, other_includes_null: bool = False
) -> Column:
    """Label of the first band that holds the value.

    ``other`` labels values in no band. NULL stays NULL unless ``other_includes_null`` is set, so
    a missing measurement is never reported as a class by accident.
    """
    value = _col(c)
    result: Column | None = None
    for b in bands:
        test = b.holds(value)
        result = F.when(test, F.lit(b.label)) if result is None else result.when(test, F.lit(b.label))
    if result is None:
        raise ValueError("no bands given")
    if other is None:
        return result
    if other_includes_null:
        return result.otherwise(F.lit(other))
    return result.when(value.isNotNull(), F.lit(other))


def band_by(
    c: str | Column,
    by: str | Column,
    bands: Mapping[object, Sequence[Band]],
    other: str | None = None,
    *,
    other_includes_null: bool = False,
) -> Column:
    """Band whose limits depend on the group in another column.

    The group is compared once per key and its bands are nested inside. Values of a group without
    bands count as lying in no band.
    """
    value, group = _col(c), _col(by)
    if not bands:
        raise ValueError("no bands given")
    result: Column | None = None
    for key, group_bands in bands.items():
        own = band(value, group_bands, other, other_includes_null=other_includes_null)
        test = group == F.lit(key)
        result = F.when(test, own) if result is None else result.when(test, own)
    if other is None:
        return result
    return result.otherwise(F.lit(other)) if other_includes_null else result.when(value.isNotNull(), F.lit(other))


def within_limits(c: str | Column, by: str | Column, limits: Mapping[object, tuple[float, float]]) -> Column:
    """Whether the value lies in its own group's range, both ends included."""
    value, group = _col(c), _col(by)
    result: Column | None = None
    for key, (lo, hi) in limits.items():
        test = (group == F.lit(key)) & value.between(lo, hi)
        result = test if result is None else result | test
    if result is None:
        raise ValueError("no limits given")
    return result


def band_gaps(bands: Sequence[Band]) -> list[tuple[float, float, str]]:
    """Ranges that no band covers, as (from, to, which ends are missing); empty when complete.

    A gap of a single point reads ``(100, 100, 'both')``. The outer ends are reported with
    infinite limits.
    """
    inf = float("inf")
    spans = sorted(
        (
            (-inf if b.lo is None else b.lo, b.lo is None or b.closed_left,
             inf if b.hi is None else b.hi, b.hi is None or b.closed_right)
            for b in bands
        ),
        key=lambda s: (s[0], not s[1]),
    )
    gaps: list[tuple[float, float, str]] = []
    reach, covered = -inf, True
    for lo, lo_in, hi, hi_in in spans:
        if lo > reach or (lo == reach and not covered and not lo_in):
            ends = {(True, True): "both", (True, False): "left", (False, True): "right"}
            gaps.append((reach, lo, ends.get((not covered, not lo_in), "neither")))
        if hi > reach or (hi == reach and hi_in):
            reach, covered = hi, hi_in or (hi == reach and covered)
    if reach < inf:
        gaps.append((reach, inf, "neither" if covered else "left"))
    return gaps


def bin_start(c: str | Column, width: int, offset: int = 0) -> Column:
    """First whole number of the bin, as BIGINT: bins are ``[start, start + width)``."""
    return F.floor((_col(c) - F.lit(offset)) / F.lit(width)).cast("bigint") * F.lit(width)


def bin_label(c: str | Column, width: int, offset: int = 0, upper: str = "inclusive") -> Column:
    """``start-end`` text; the end is ``start+width-1`` or, with ``upper='exclusive'``, ``start+width``."""
    if upper not in ("inclusive", "exclusive"):
        raise ValueError("upper must be 'inclusive' or 'exclusive'")
    start = bin_start(c, width, offset)
    end = start + F.lit(width - 1 if upper == "inclusive" else width)
    return F.concat(start.cast("string"), F.lit("-"), end.cast("string"))


def bucket_number(c: str | Column, lo: float, hi: float, n: int) -> Column:
    """1..n inside ``[lo, hi)``, 0 below, n+1 from ``hi`` on."""
    return F.width_bucket(_col(c), F.lit(lo), F.lit(hi), F.lit(n))


def bucket_label(c: str | Column, lo: int, hi: int, n: int, separator: str = " - ") -> Column:
    """Range text of the bucket, under- and overflow included."""
    width = (hi - lo) // n
    bucket = bucket_number(c, lo, hi, n)
    start = F.lit(lo) + (bucket - 1) * width
    return F.concat(start.cast("string"), F.lit(separator), (start + width - 1).cast("string"))
