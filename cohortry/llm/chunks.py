"""Documents in chunks of ascending ids, and the exchange of packed hash lists between chunks.

A chunk is a range of ids with about ``chunk_bytes`` of text. Equal ids share a chunk, and a lower
chunk holds lower ids only. Rows without an id are spread over negative chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20


def chunk_count(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks that the bytes of all texts fill."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / chunk_bytes))


def id_bounds(docs: DataFrame, id: str, chunks: int) -> np.ndarray:
    """First ids of chunks 1, 2, ... as Spark's range partitioning draws them (8 bytes a chunk)."""
    ids = docs.select(F.col(id).cast("long").alias("id")).filter("id IS NOT NULL")
    ranged = ids.repartitionByRange(chunks, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("b"))
    return np.array(sorted(r["b"] for r in ranged.collect())[1:], np.int64)


def in_chunks(docs: DataFrame, id: str, chunks: int, bounds: np.ndarray, name: str = "chunk") -> DataFrame:
    """Add the number of the chunk."""

    @F.pandas_udf("long")
    def chunk(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right"))

    spread = -1 - F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != id]), F.lit(chunks)).cast("long")
    return docs.withColumn(name, F.coalesce(chunk(F.coalesce(F.col(id).cast("long"), F.lit(0))), F.lit(0))).withColumn(
        name, F.when(F.col(id).isNull(), spread).otherwise(F.col(name))
    )
