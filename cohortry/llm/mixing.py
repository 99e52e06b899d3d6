"""Mixing sources to target weights by Pfair scheduling, rows in DataFrame functions only.

Each source's rows are cut into blocks. In an ideal mix all sources that still have rows flow at once,
each at its exact share of their weights: after the sources with the smallest blocks / weight have run
out, block j of a source of weight w flows until slot B + W (j + 1) / w, where B is the number of blocks
of those that ran out and W the weight of the others. The floor of its first moment is the block's
release and the ceiling of its last its deadline. Every slot goes to the released block that is due
first, which meets all deadlines because the ideal mix does. So at any slot every source is less than one
block from its exact share, however long the table is and also after others ran out. Every row is used once.

The schedule has a row a block and is made on the driver from the number of rows of each source, in whole
numbers of any size, so nothing is rounded. Rows get their number within the source from counts per (source,
bucket), so no source meets in one task, and join the schedule by block.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
MAX_SOURCES = 1000
BUCKET_ROWS = 100_000
CHUNK_BLOCKS = 1024


def _edges(blocks: int, weight: int, ends: list[Fraction], gone: list[int], weights: list[int]) -> Iterator[tuple[int, int]]:
    """Release and deadline of each block of a source.

    ``ends``: where each source runs out, as blocks / weight, rising; ``gone`` and ``weights``: the blocks of the
    first k of them and the weight of the others.
    """
    phase = -1
    for j in range(blocks + 1):
        if phase < 0 or phase < len(ends) and ends[phase] * weight <= j:
            phase = bisect.bisect_right(ends, Fraction(j, weight))
        flown = j * weights[phase]
        if j:
            yield release, gone[phase] - (-flown // weight)
        release = gone[phase] + flown // weight


def schedule(blocks: list[int], weights: list[float]) -> list[np.ndarray]:
    """For each source the slot, release and deadline of its blocks, one column each.

    Sources of weight 0 come when all others are used up, in equal shares.
    """
    if any(not 0 <= w < math.inf for w in weights):
        raise ValueError("weights must be finite and not below 0")
    out = [np.zeros((n, 3), np.int64) for n in blocks]
    start = 0
    for group in ([i for i, w in enumerate(weights) if w > 0], [i for i, w in enumerate(weights) if w == 0]):
        exact = {i: Fraction(weights[i] or 1) for i in group}
        scale = math.lcm(*(x.denominator for x in exact.values()))
        whole = {i: int(x * scale) for i, x in exact.items()}
        order = sorted((Fraction(blocks[i], whole[i]), i) for i in group)
        gone, left = [0], [sum(whole.values())]
        for _, i in order:
            gone.append(gone[-1] + blocks[i])
            left.append(left[-1] - whole[i])
        ends = [e for e, _ in order]
        edges = {i: _edges(blocks[i], whole[i], ends, gone, left) for i in group}
        done = dict.fromkeys(group, 0)
        waiting = [(*next(edges[i]), i) for i in group]
        heapq.heapify(waiting)
        due: list[tuple[int, int, int]] = []
        for t in range(gone[-1]):
            while waiting and waiting[0][0] <= t:
                release, deadline, i = heapq.heappop(waiting)
                heapq.heappush(due, (deadline, i, release))
            deadline, i, release = heapq.heappop(due)
            out[i][done[i]] = start + t, start + release, start + deadline
            done[i] += 1
            if (following := next(edges[i], None)) is not None:
                heapq.heappush(waiting, (*following, i))
        start += gone[-1]
    return out


def _numbered(docs: DataFrame, source: str, id: str, seed: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their source and their number in it, in an order drawn by hash; and the rows of each source."""
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / BUCKET_ROWS))
    drawn = F.xxhash64(F.lit(seed), *by)
    keyed = docs.withColumns({"__s": F.to_json(F.struct(F.col(source).cast("string").alias("s"))), "__draw": drawn, "__b": F.pmod(drawn, F.lit(buckets))})
    sizes = keyed.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__draw", id))
    numbered = keyed.withColumn("__k", within - 1).join(offsets, ["__s", "__b"]).withColumn("__k", F.col("__k") + F.col("__before"))
    return numbered.drop("__b", "__draw", "__before"), sizes.groupBy("__s").agg(F.sum("__n").alias("rows"))


def plan(spark: SparkSession, rows: DataFrame, weights: Mapping[str, float] | None, block_rows: int, resolution: int | None = None) -> DataFrame:
    """Slot, release and deadline of each block: a row for each ``__s`` and ``block``.

    ``rows``: each source's key ``__s``, its name and its ``rows``.
    """
    sizes = sorted(tuple(r) for r in rows.select("__s", F.get_json_object("__s", "$.s"), "rows").limit(MAX_SOURCES + 1).collect())
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if weights is None:  # between equal shares and the sources' own: their square roots
        given = [math.sqrt(n) for _, _, n in sizes]
    else:
        least = min(weights.values(), default=1.0)
        given = [float(least if name is None else weights.get(name, least)) for _, name, _ in sizes]
    if resolution:
        given = [float(max(1, round(w * resolution / sum(given)))) for w in given]
    columns: dict[str, list] = {"__s": [], "first": [], "slot": [], "release": [], "deadline": []}
    for (key, _, _), found in zip(sizes, schedule([-(-n // block_rows) for _, _, n in sizes], given), strict=True):
        for first in range(0, len(found), CHUNK_BLOCKS):
            part = found[first : first + CHUNK_BLOCKS]
            for name, value in zip(columns, (key, first, *part.T), strict=True):
                columns[name].append(value)
    kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    chunks = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], list(columns)))
    each = chunks.select("__s", "first", F.posexplode(F.arrays_zip("slot", "release", "deadline")).alias("k", "x"))
    return each.select("__s", (F.col("first") + F.col("k")).alias("block"), "x.slot", "x.release", "x.deadline")


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", id: str = "doc_id", by: list[str] | None = None,
    block_rows: int = BLOCK_ROWS, resolution: int | None = None, seed: int = 0,
) -> DataFrame:
    """Add ``block``, ``row_in_block``, ``slot``, ``release`` and ``deadline`` to every row of ``docs``.

    Rows ordered by ``slot`` and ``row_in_block`` follow the target weights. ``weights`` maps a source
    to its weight; one that it leaves out gets the smallest given. Without it a source weighs the
    square root of its rows. Weights count as they are; ``resolution`` rounds them to as many units in all,
    one at least, before. A null source is a source of its own. ``by`` names the columns that the
    drawn order depends on (the id alone unless given); rows equal in all of them are
    interchangeable. More than MAX_SOURCES sources are an error. A column of ``docs`` named like an added one is replaced. An empty table stays empty.
    """
    docs = docs.drop("block", "row_in_block", "slot", "release", "deadline", "__s", "__b", "__k", "__draw")
    numbered, rows = _numbered(docs, source, id, seed, by or [id])
    placed = numbered.withColumn("block", F.expr(f"__k div {block_rows}")).withColumn("row_in_block", F.expr(f"__k % {block_rows}"))
    found = placed.join(plan(docs.sparkSession, rows, weights, block_rows, resolution), ["__s", "block"])
    return found.select(*[c for c in numbered.columns if c not in ("__s", "__k")], "block", "row_in_block", "slot", "release", "deadline")
