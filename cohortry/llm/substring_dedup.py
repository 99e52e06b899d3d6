"""Substring deduplication with fixed-block anchors.

A passage of ``window`` words that two documents share holds a whole block of ``block`` words of the
earlier document's grid of non-overlapping blocks, as long as ``window >= 2 * block - 1``. So:

1. Every rolling window of ``block`` words is a probe; those on the grid are also the index. Each
   chunk of documents sends every bucket its distinct probes once, as packed 30-bit hashes with two
   flags (on the grid, repeated within the chunk), so a passage that a third of all documents
   hold is sent once a chunk. A bucket answers with one bit a probe: indexed, and seen twice.
2. Hits are extended: the full windows around a hit are hashed to 96 bits and exchanged alike; the
   bucket answers whether a lower chunk has the window. Chunks are ranges of ids, so that and the
   lowest id within the chunk decide which windows start in an earlier document. Runs of such
   windows are the maximal exact repeats.
3. Words of these runs are cut out.

Chunks times buckets cells are exchanged. At 100 TB ``chunk_bytes`` of 256 MB makes 400,000
chunks; a bucket then holds a few hundred MB.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.chunks import CHUNK_BYTES, chunk_count, id_bounds, in_chunks
from cohortry.llm.words import Words, lean, slices, utf8, windows, words

WINDOW = 13
_LOW30 = np.uint64(0x3FFFFFFF)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, int)


class _Chunk:
    """The words of a chunk's documents and the hashes exchanged for them."""

    def __init__(self, table: pa.Table, window: int, block: int, buckets: int):
        self.window, self.block, self.buckets = window, block, buckets
        self.data, self.offsets = utf8(table.column("__text"))
        self.ids = table.column("__id").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        self.parts: list[tuple[int, int, Words]] = []
        for i, j in slices(self.offsets):
            where = self.offsets[i : j + 1]
            self.parts.append((i, j, words(self.data[where[0] : where[-1]], where - where[0])))

    def probes(self) -> None:
        """Distinct probes as (bucket, 30 bits), their flags, and which one each rolling window is."""
        keys, flags, self.at = [], [], []
        for _, _, found in self.parts:
            hashed, at = windows(found, self.block)
            grid = (at - found.first[:-1][found.documents()[at]]) % self.block == 0
            bucket = (hashed >> np.uint64(34)) % np.uint64(self.buckets)
            keys.append(bucket << np.uint64(32) | (hashed & _LOW30) << np.uint64(2))
            flags.append(grid)
            self.at.append(at)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        flag = np.concatenate(flags) if flags else np.zeros(0, bool)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = _runs(key)
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        self.probe = key[starts]
        if len(starts):
            self.probe = self.probe | np.logical_or.reduceat(flag[order], starts).astype(np.uint64)
            self.probe |= (np.diff(np.append(starts, len(key))) > 1).astype(np.uint64) << np.uint64(1)

    def candidates(self, hit: np.ndarray) -> None:
        """Full windows around the hits: distinct 96-bit hashes, the lowest id of each, and their places."""
        n0, full, extra, owner, self.places = 0, [], [], [], []
        for (i, _, found), at in zip(self.parts, self.at, strict=True):
            hits = np.zeros(len(found.hash) + 1, np.int32)
            hits[at[hit[self.which[n0 : n0 + len(at)]]] + 1] = 1
            n0 += len(at)
            if not hits.any():
                self.places.append(np.zeros(0, np.int64))
                continue
            seen = np.cumsum(hits)
            hashed, start = windows(found, self.window)
            near = seen[np.minimum(start + self.window - self.block + 1, len(seen) - 1)] > seen[start]
            check, _ = windows(found, self.window, seed=1)
            start = start[near]
            full.append(hashed[near])
            extra.append(check[near] >> np.uint64(32))
            owner.append(self.ids[i + found.documents()[start]])
            self.places.append(start)
        key = np.concatenate(full) if full else np.zeros(0, np.uint64)
        more = np.concatenate(extra) if full else np.zeros(0, np.uint64)
        ids = np.concatenate(owner) if full else np.zeros(0, np.int64)
        bucket = key % np.uint64(self.buckets)
        order = np.lexsort((more, key, bucket))
        key, more, bucket = key[order], more[order], bucket[order]
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(change)
        self.same = np.empty(len(key), np.int64)
        self.same[order] = np.cumsum(change) - 1
        self.full, self.more, self.full_bucket = key[starts], more[starts].astype(np.uint32), bucket[starts]
        self.lowest = np.minimum.reduceat(ids[order], starts) if len(starts) else ids

    def cut(self, earlier: np.ndarray) -> list[np.ndarray]:
        """For each slice, which words are covered by a window that an earlier document has."""
        n0, covered = 0, []
        for (i, _, found), start in zip(self.parts, self.places, strict=True):
            same = self.same[n0 : n0 + len(start)]
            n0 += len(start)
            own = self.ids[i + found.documents()[start]]
            taken = start[earlier[same] | (self.lowest[same] < own)]
            steps = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(steps, taken, 1)
            np.add.at(steps, taken + self.window, -1)
            covered.append(np.cumsum(steps)[:-1] > 0)
        return covered


def _cells(chunk: int, bucket: np.ndarray, buckets: int, payload: list[np.ndarray]) -> pa.Table:
    """A row for each bucket that gets something: the arrays' bytes one after another."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(edges))
    data = [b"".join(p[edges[b] : edges[b + 1]].tobytes() for p in payload) for b in used]
    return pa.table({"chunk": pa.array(np.full(len(used), chunk), pa.int64()), "bucket": pa.array(used, pa.int64()), "data": pa.array(data, pa.binary())})


def _answers(chunk: np.ndarray, counts: np.ndarray, bits: np.ndarray, bucket: int, stage: int) -> pa.Table:
    """A row for each chunk that has a set bit."""
    ends = np.cumsum(counts)
    rows = [(c, np.packbits(bits[e - n : e]).tobytes()) for c, n, e in zip(chunk, counts, ends, strict=True) if bits[e - n : e].any()]
    return pa.table({
        "chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()),
        "stage": pa.array([stage] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary()),
    })


def _bits(answers: pa.Table, stage: int, bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of a stage as one array over the chunk's distinct hashes."""
    out = np.zeros(len(bucket), bool)
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for b, s, data in zip(*(answers.column(c).to_pylist() for c in ("bucket", "stage", "data")), strict=True):
        if s == stage:
            n = edges[b + 1] - edges[b]
            out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
    return out


def _seen_twice(table: pa.Table) -> pa.Table:
    """A bucket of probes: which are indexed by a grid block and occur at two places or more."""
    lists = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
    key = np.concatenate(lists)
    order = np.argsort(key >> np.uint32(2), kind="stable")
    starts = _runs((key >> np.uint32(2))[order])
    sizes = np.diff(np.append(starts, len(key)))
    flags = np.bitwise_or.reduceat(key[order] & np.uint32(3), starts)
    good = (flags & 1 > 0) & ((sizes > 1) | (flags & 2 > 0))
    bits = np.empty(len(key), bool)
    bits[order] = np.repeat(good, sizes)
    return _answers(table.column("chunk").to_numpy(), np.array([len(x) for x in lists]), bits, table.column("bucket")[0].as_py(), 0)


def _in_lower_chunk(table: pa.Table) -> pa.Table:
    """A bucket of full windows: which are also in a lower chunk."""
    chunk = table.column("chunk").to_numpy()
    data = table.column("data").to_pylist()
    counts = np.array([len(x) // 12 for x in data])
    key = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(data, counts, strict=True)])
    more = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(data, counts, strict=True)])
    whose = np.repeat(chunk, counts)
    order = np.lexsort((whose, more, key))
    change = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (more[order][1:] != more[order][:-1])])
    first = whose[order][np.flatnonzero(change)]
    bits = np.empty(len(key), bool)
    bits[order] = first[np.cumsum(change) - 1] < whose[order]
    return _answers(chunk, counts, bits, table.column("bucket")[0].as_py(), 1)


def _kept(chunk: _Chunk, covered: list[np.ndarray], join_words: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts without the covered words, and the words and covered words of each document."""
    texts, n_words, n_removed = [], [], []
    for (i, j, found), gone in zip(chunk.parts, covered, strict=True):
        where = chunk.offsets[i : j + 1]
        data, where = chunk.data[where[0] : where[-1]], where - where[0]
        n, doc = len(data), found.documents()
        keep = ~gone
        if join_words:
            last = np.zeros(len(doc), bool)
            at = np.flatnonzero(keep)
            last[at[np.flatnonzero(np.diff(doc[at], append=-1))]] = True
            steps = np.zeros(n + 1, np.int8)
            steps[found.start[keep]] += 1
            np.subtract.at(steps, found.end[keep], 1)
            mask = np.cumsum(steps[:n]).astype(bool)
            blanks = found.end[keep & ~last]
            mask[blanks] = True
            data = data.copy()
            data[blanks] = 32
        else:
            until = np.append(found.start[1:], n)
            ends = np.flatnonzero(np.diff(doc, append=-1))
            until[ends] = where[doc[ends] + 1]
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, found.start[gone], 1)
            np.subtract.at(steps, until[gone], 1)
            mask = np.cumsum(steps[:n]) == 0
        size = np.concatenate([[0], np.cumsum(mask)])[where]
        texts.append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[mask])))
        n_words.append(found.counts)
        n_removed.append(np.concatenate([[0], np.cumsum(gone)])[found.first[1:]] - np.concatenate([[0], np.cumsum(gone)])[found.first[:-1]])
    return pa.chunked_array(texts, pa.large_string()).cast(pa.string()), np.concatenate(n_words), np.concatenate(n_removed)


def drop_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = WINDOW, carry: tuple[str, ...] = (),
    join_words: bool = False, chunk_bytes: int = CHUNK_BYTES, chunks: int | None = None,
) -> DataFrame:
    """Cut the words that a window of ``window`` words covers which also starts in a document with a smaller id.

    Returns the id, the columns of ``carry``, ``n_words``, ``n_removed`` and ``kept``: the text
    without those words, in its own layout, or its words joined by one space (``join_words``). All
    windows are judged on the input. A null text has no words and stays empty. Rows that share an id
    do not repeat one another; a row without id neither loses words nor counts as an earlier one.
    Further columns of ``docs`` are ignored, whatever they are named.
    """
    if window < 3:
        raise ValueError("a window of at least three words is needed")
    block = (window + 1) // 2
    n = chunks or chunk_count(docs, text, chunk_bytes)
    bounds = id_bounds(docs, id, n) if n > 1 else np.zeros(0, np.int64)
    own = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"), *[F.col(c).alias(f"__carry_{c}") for c in carry])
    placed = in_chunks(own, "__id", n, bounds, "__chunk")
    by_chunk = placed.groupBy("__chunk")

    def number(table: pa.Table) -> int:
        return table.column("__chunk")[0].as_py()

    def send_probes(table: pa.Table) -> pa.Table:
        chunk = _Chunk(table if number(table) >= 0 else table.slice(0, 0), window, block, n)
        chunk.probes()
        return _cells(number(table), chunk.probe >> np.uint64(32), n, [(chunk.probe & np.uint64(0xFFFFFFFF)).astype(np.uint32)])

    def extended(table: pa.Table, answers: pa.Table) -> _Chunk:
        chunk = _Chunk(table, window, block, n)
        chunk.probes()
        hit = _bits(answers, 0, chunk.probe >> np.uint64(32), n)
        chunk.candidates(hit if number(table) >= 0 else np.zeros_like(hit))
        return chunk

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _cells(0, np.zeros(0, np.uint64), n, [])
        chunk = extended(table, answers)
        return _cells(number(table), chunk.full_bucket, n, [chunk.full, chunk.more])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        chunk = extended(table, answers)
        earlier = _bits(answers, 1, chunk.full_bucket, n)
        kept, n_words, n_removed = _kept(chunk, chunk.cut(earlier), join_words)
        return pa.table([table.column("__id"), *[table.column(f"__carry_{c}") for c in carry], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], schema=arrow)

    cells, answered = "chunk long, bucket long, data binary", "chunk long, bucket long, stage int, data binary"
    hits = by_chunk.applyInArrow(lean(send_probes), cells).groupBy("bucket").applyInArrow(lean(_seen_twice), answered)
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(lean(send_windows), cells)
    lower = sent.groupBy("bucket").applyInArrow(lean(_in_lower_chunk), answered)

    fields = [F.col("__id").alias(id), *[F.col(f"__carry_{c}").alias(c) for c in carry]]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = own.select(*fields).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept": F.lit("")}).schema
    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    return by_chunk.cogroup(hits.unionByName(lower).groupBy("chunk")).applyInArrow(lean(finish), schema)
