"""Shards by a Feistel permutation of global row numbers.

Rows are numbered by id. The number is permuted by a six-round Feistel network over the least even
number of bits that holds all numbers, applied again while the result is no row number (cycle
walking). The permuted number's remainder by the shard count is the shard, its quotient the slot: both
can be computed for any row, and ``row_at`` finds the row of any slot, without a table. Counts of the
shards differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.sources.workspace import materialise

ROUNDS = 6
RANGE_ROWS = 1_000_000
_FACTOR = 1_640_531_527  # below 2**31, so products of a half and it stay below 2**63


def half_bits(rows: int) -> int:
    """Bits of each half of a row number."""
    return max(1, math.ceil(max(rows - 1, 1).bit_length() / 2))


def round_keys(seed: int) -> list[int]:
    """A number below 2**30 for each round."""
    return [(seed * 2_654_435_761 + 1_013_904_223 * (k + 1)) % (1 << 30) for k in range(ROUNDS)]


def _stirred(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half + key) * _FACTOR
    return ((x ^ (x >> 17)) >> 5) & mask


def _pass(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _stirred(left, key, mask), left
        else:
            left, right = right, left ^ _stirred(right, key, mask)
    return left << bits | right


def permuted(numbers: np.ndarray, rows: int, seed: int = 0, *, back: bool = False) -> np.ndarray:
    """Where each row number below ``rows`` goes, or with ``back`` which one goes there."""
    if rows > 1 << 58:
        raise ValueError("too many rows")
    bits, keys = half_bits(rows), round_keys(seed)
    out = _pass(np.asarray(numbers, np.int64), bits, keys, back)
    while len(outside := np.flatnonzero(out >= rows)):
        out[outside] = _pass(out[outside], bits, keys, back)
    return out


def row_at(shard: np.ndarray, slot: np.ndarray, shards: int, rows: int, seed: int = 0) -> np.ndarray:
    """Row number that is at a slot of a shard."""
    return permuted(np.asarray(slot, np.int64) * shards + shard, rows, seed, back=True)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in the order of columns, nulls last; no task sorts more than a range of about ``RANGE_ROWS``."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / RANGE_ROWS))
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = materialise(rows.repartitionByRange(parts, *keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranged.withColumn(name, within).join(F.broadcast(offsets), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def shard(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", *, seed: int = 0) -> DataFrame:
    """Per row its ``size``, ``text_crc32``, ``row_number``, ``shard`` and ``slot``.

    Sizes are UTF-8 bytes and 8 more; a null text has none. Rows without id are numbered last; rows
    that share an id follow one another by their text's checksum and size, and are interchangeable if
    equal in these. Equal texts are spread like any others. Further columns are ignored.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).cast("long").alias("__id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"))
    found = numbered(rows, ["__id", "text_crc32", "size"], "row_number")
    total = found.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), total, seed))

    placed = found.withColumn("__place", place("row_number"))
    return placed.select(
        F.col("__id").alias(id), "size", "text_crc32", "row_number", F.expr(f"__place % {shards}").cast("int").alias("shard"), F.expr(f"__place div {shards}").alias("slot")
    )
