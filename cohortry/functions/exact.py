"""Sums and means of doubles that do not depend on the order of addition, at any magnitude.

A double is a whole number of at most 53 bits times a power of two. Cut into limbs of 24 bits at fixed places it
becomes whole numbers, whose sums are exact in any order and grouping. The places are chosen from the smallest and
the largest magnitude of the column, so a column of like values takes four or five limbs and the whole range of doubles 88.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 24
_LEAST = -1074  # exponent of the smallest double


@dataclass(frozen=True)
class Limbs:
    """Places of the limbs: ``count`` of them from the power ``low`` of two upwards."""

    low: int
    count: int

    def _scale(self, k: int) -> Column:
        return F.lit(math.ldexp(1.0, self.low + _BITS * k))

    def cut(self, value: Column) -> list[Column]:
        """The limbs of a finite value, lowest first, with its sign; NULL counts as 0."""
        size = F.abs(value)
        out = []
        for k in range(self.count):
            # the remainder of doubles, dividing by a power of two and the floor are all exact
            below = size if k == self.count - 1 else size % self._scale(k + 1)
            out.append(F.floor(below / self._scale(k)))
        sign = F.when(value < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        return [F.coalesce(limb.cast("bigint") * sign, F.lit(0).cast("bigint")) for limb in out]

    def value(self, sums: list[Column]) -> Column:
        """The sum as a double: limbs carried over and added from the lowest up, those of a negative sum with their signs turned."""
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(0.0).alias("total"), self._scale(0).alias("scale"))

        def step(state: Column, limb: Column) -> Column:
            whole = state["carry"] + limb
            carry = F.shiftright(whole, _BITS)
            rest = (whole - F.shiftleft(carry, _BITS)).cast("double")
            return F.struct(carry.alias("carry"), (state["total"] + rest * state["scale"]).alias("total"), (state["scale"] * F.lit(2.0**_BITS)).alias("scale"))

        def added(limbs: list[Column]) -> tuple[Column, Column]:
            lower = F.aggregate(F.array(*limbs[:-1]).cast("array<bigint>"), start, step)
            top = limbs[-1] + lower["carry"]
            return top, lower["total"] + top.cast("double") * lower["scale"]

        top, value = added(sums)
        _, turned = added([-limb for limb in sums])
        return F.when(top < 0, -turned).otherwise(value)

    def mean(self, sums: list[Column], count: Column) -> Column:
        """The sum of ``count`` values divided by it, rounded once: limbs are divided from the highest down, each with the remainder above it."""
        start = F.struct(F.lit(0).cast("bigint").alias("rest"), F.lit(0.0).alias("total"), F.lit(0.0).alias("lost"), self._scale(self.count - 1).alias("scale"))
        count = count.cast("bigint")

        def step(state: Column, limb: Column) -> Column:
            whole = F.shiftleft(state["rest"], _BITS) + limb
            rest = F.pmod(whole, count)
            # at most 25 bits, as no value has more than 24 in a limb
            part = F.call_function("div", whole - rest, count).cast("double") * state["scale"]
            total = state["total"] + part
            lost = state["lost"] + (part - (total - state["total"]))
            return F.struct(rest.alias("rest"), total.alias("total"), lost.alias("lost"), (state["scale"] * F.lit(2.0**-_BITS)).alias("scale"))

        def finish(state: Column) -> Column:
            return state["total"] + (state["lost"] + state["rest"].cast("double") / count.cast("double") * self._scale(0))

        return F.aggregate(F.array(*reversed(sums)).cast("array<bigint>"), start, step, finish)


def limbs_of(df: DataFrame, column: str) -> Limbs:
    """Places for the finite values of a column; one aggregation over it."""
    size = F.abs(F.col(column).cast("double"))
    finite = F.when((size > 0) & (size < float("inf")) & ~F.isnan(size), size)
    least, most = df.agg(F.min(finite), F.max(finite)).first()
    if most is None:
        return Limbs(0, 1)
    low = max(_LEAST, math.frexp(least)[1] - 53)
    return Limbs(low, (math.frexp(most)[1] - low - 1) // _BITS + 1)
