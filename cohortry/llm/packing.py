"""Best-fit packing of token sequences with a fixed number of open bins.

Texts are encoded where they are read; only the lengths of their pieces are shuffled. Each task packs
its pieces online, longest first: a piece goes to the open bin with the least free space that holds
it, found as the lowest set bit of a bitset keyed by free space. When ``open_bins`` are open, the
fullest closes for the next. So a task's memory is bounded by its rows and ``open_bins``, and only
a task's last bins stay part empty. Rows that come in numbered stretches are packed stretch by
stretch, so the sequences keep the order of the stretches and only a stretch's last bins stay part empty.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.tokens import Encoder
from cohortry.llm.words import lean, slices, utf8

LENGTH = 4096
END = 1
OPEN_BINS = 16_384
TASK_ROWS = 100_000


@functools.lru_cache(maxsize=1)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end: int = END, with_ids: bool = False,
    stretch: str | None = None,
) -> DataFrame:
    """Each document's ids and the id ``end``, cut into pieces of ``length``; a null text is empty.

    Columns: id, ``piece`` (from 0), ``start`` (ids before it), ``length``, ``ids_crc32`` and, with
    ``with_ids``, ``ids``: little-endian unsigned 32-bit ids. With ``stretch`` a whole number
    of the document by that name comes along as ``stretch``. Further columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path(tokenizer), end)
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            ids = batch.column("__id")
            for i, j in slices(offsets):
                where = offsets[i : j + 1]
                flat, first = encoder.encode(data[where[0] : where[-1]], where - where[0])
                total = np.diff(first)
                n = -(-total // length)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                size = np.minimum(length, total[doc] - piece * length)
                raw, at = memoryview(flat.astype("<u4").tobytes()), 4 * (first[doc] + piece * length)
                spans = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
                columns = [ids.take(pa.array(i + doc)), pa.array(piece, pa.int32()), pa.array(piece * length, pa.int64()), pa.array(size, pa.int64()), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                names = ["__id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(s) for s in spans], pa.binary())], [*names, "ids"]
                if stretch:
                    columns, names = [*columns, batch.column("stretch").take(pa.array(i + doc))], [*names, "stretch"]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "__id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", stretch long" * bool(stretch)
    found = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"), *([F.col(stretch).cast("long").alias("stretch")] if stretch else []))
    return found.mapInArrow(lean(cut), schema).withColumnRenamed("__id", id)


def fit(sizes: np.ndarray, length: int, open_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece and the place in it, for pieces in the order they come."""
    bins: dict[int, list[int]] = defaultdict(list)  # free space -> open bins with it
    bits = opened = open_now = 0
    number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        fitting = bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            which = bins[free].pop()
            open_now -= 1
        else:
            if open_now >= open_bins:  # the fullest closes
                fullest = (bits & -bits).bit_length() - 1
                bins[fullest].pop()
                open_now -= 1
                if not bins[fullest]:
                    bits &= ~(1 << fullest)
            free, which = length, opened
            opened += 1
        if free != length and not bins[free]:
            bits &= ~(1 << free)
        number[k], offset[k] = which, length - free
        if left := free - size:
            bins[left].append(which)
            bits |= 1 << left
            open_now += 1
    return number, offset


def pack(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, end: int = END,
    open_bins: int = OPEN_BINS, with_ids: bool = False, tasks: int | None = None, stretch: str | None = None,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``: sequences of at most ``length`` ids, gapless from 0.

    ``stretch`` names a column that numbers stretches of the documents from 0, each small enough for a task: a
    sequence holds pieces of one stretch only, and ``sequence_id`` rises with it. Without it a task is one
    stretch, and the documents' order plays no part. See ``pieces`` for the other columns. Equal ids are
    separate documents; an empty table packs into nothing.
    """
    cut = pieces(docs, id, text, tokenizer=tokenizer, length=length, end=end, with_ids=with_ids, stretch=stretch)
    n = tasks or max(1, math.ceil(docs.count() / (TASK_ROWS // 8 if with_ids else TASK_ROWS)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        whose = table.column("stretch").to_numpy() if stretch else np.full(len(table), TaskContext.get().partitionId())
        order = np.lexsort((table.column("piece").to_numpy(), table.column(id).fill_null(0).to_numpy(), -table.column("length").to_numpy(), whose))
        table, whose = table.take(pa.array(order)).combine_chunks(), whose[order]
        sizes, edges = table.column("length").to_numpy(), np.flatnonzero(np.diff(whose, prepend=-1, append=-1))
        number, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            number[i:j], offset[i:j] = fit(sizes[i:j], length, open_bins)
        number += whose << (32 if stretch else 40)
        if stretch:
            table = table.drop_columns(["stretch"])
        yield from table.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).to_batches()

    # spread by the stretch or by the content of the row, so that a repeated task gets the same rows
    dealt = cut.repartition(n, *(["stretch"] if stretch else [F.xxhash64(id, "piece", "ids_crc32")]))
    schema = cut.drop("stretch").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(lean(packed), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences of a packing made ``with_ids``: ``sequence_id``, ``length`` and ``ids``."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    empty = F.lit(b"")
    return parts.select("sequence_id", "length", F.aggregate("parts", empty, lambda all_, p: F.concat(all_, p["ids"])).alias("ids"))
