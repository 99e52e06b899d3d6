"""Removal of byte strings that occur anywhere else, by prefix-free parsing.

A rolling hash over ``WINDOW`` bytes is a trigger about every ``length / 12`` bytes. Triggers cut a text into phrases that
reach to the end of the next trigger, so no phrase is a proper beginning of another, and equal
strings are cut alike wherever they lie. A string of ``length`` bytes belongs to the first trigger in it, its anchor: the
part before is an end of the phrase that leads to the anchor, and what follows is the parse. A string whose first ``reach`` bytes
hold no trigger is its own anchor.

1. Tasks take chunks of documents and send, for each distinct text of ``length - reach`` bytes after an anchor, one entry: its hash and that
   of its whole context (the phrase before and ``length`` bytes after). A bucket answers whether the text is unique, always in the
   same context (then all strings of the anchor are repeated), or in different ones.
2. For the last kind a chunk builds the corpus order of its strings. Its distinct phrases, sorted from their ends, are the suffix
   order of the dictionary; the parse is sorted by doubling ranks of phrases. All strings that begin with the same end of a phrase follow
   one another as their parses do, so equal strings are neighbours whose common prefix, compared byte by byte, is ``length`` or more.
   Only one of each is sent on, as 95 bits of hash, and a bucket answers whether another chunk has it, or this one twice.
3. The union of the repeated strings is cut out.

A passage that a third of all documents hold is sent once a chunk, and texts in different contexts are dealt by the hash of the
whole string, so neither gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.chunks import CHUNK_BYTES
from cohortry.llm.words import constants, lean, mix, powers, slices, utf8

LENGTH = 400
WINDOW = 16
CONTEXT_BYTES = 64 << 20  # of text, for each bucket of contexts
STRING_BYTES = 8 << 20  # and of strings, which may be as many as bytes
_BYTE, _CHECK = constants(7, 256), constants(29, 256)
_SCALE = constants(31, 3)
_LOW = np.uint64(3)


class Spec:
    """Lengths that follow from the length of the strings."""

    def __init__(self, length: int):
        self.length = length
        self.window = min(WINDOW, max(1, length // 8))
        self.reach = length // 2
        self.after = length - self.reach
        self.mean = max(2, self.reach // 6)
        self.limit = np.uint64((1 << 64) // self.mean)


class _Part:
    """Bytes of some documents, and their hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, base: int, spec: Spec):
        self.data, self.ends, self.base = data, ends, base  # ends: of documents, ascending
        n = len(data)
        self.up, self.down = powers(n + 1)
        self.total = self._running(_BYTE)
        size = spec.window
        stirred = (self.total[size:] - self.total[:-size]) * self.down[: max(0, n - size + 1)] if n >= size else np.zeros(0, np.uint64)
        stirred ^= stirred >> np.uint64(32)
        stirred *= _SCALE[0]
        at = np.flatnonzero(stirred < spec.limit)
        end = ends[np.searchsorted(ends, at, "right")] if len(at) else at
        inside = at + size <= end
        self.trigger, self.trigger_end = at[inside], end[inside]
        self._anchors(spec)

    def _running(self, table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * self.up[: len(self.data)], out=total[1:])
        return total

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])

    def check(self, start: np.ndarray, length: int) -> np.ndarray:
        """31 bits of another hash."""
        total = self._running(_CHECK)
        return (mix((total[start + length] - total[start]) * self.down[start]) >> np.uint64(33)).astype(np.uint32)

    def _anchors(self, spec: Spec) -> None:
        """Where strings have their anchor: position, how many strings may begin up to there, end of the document, first distance that fits."""
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        at, end = self.trigger, self.trigger_end
        new = np.concatenate([[True], end[1:] != end[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.concatenate([[0], at[:-1]])[: len(at)]
        doc = np.searchsorted(self.ends, at, "right")
        before[new] = starts[doc[new]] - 1
        gap = np.minimum(at - before, spec.reach + 1)
        least = np.maximum(0, spec.length - (end - at))
        fits = least < gap
        # strings without a trigger near: between triggers, and after the last one of a document
        last = starts - 1
        last[doc] = at  # ascending, so the last one stays
        low = np.concatenate([before + 1, last + 1])
        high = np.concatenate([np.minimum(at - spec.reach - 1, end - spec.length), self.ends - spec.length])
        size = np.maximum(0, high - low + 1)
        alone = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if size.any() else np.zeros(0, np.int64)
        alone_end = np.repeat(np.concatenate([end, self.ends]), size)
        self.triggered = np.concatenate([np.ones(fits.sum(), bool), np.zeros(len(alone), bool)])
        self.at = np.concatenate([at[fits], alone])
        self.gap = np.concatenate([gap[fits], np.ones(len(alone), np.int64)])
        self.end = np.concatenate([end[fits], alone_end])
        self.least = np.concatenate([least[fits], np.zeros(len(alone), np.int64)])

    def contexts(self, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the text after each anchor, and of its whole context."""
        stop = np.minimum(self.at + spec.length, self.end)
        size = self.gap.astype(np.uint64) * _SCALE[1] + (stop - self.at).astype(np.uint64) * _SCALE[2]
        return self.hash(self.at, self.at + spec.after), mix(self.hash(self.at - self.gap + 1, stop) ^ size)


def common_prefix(data: np.ndarray, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes are equal from two places on, ``most`` at most."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(one), np.int64)
    left = np.flatnonzero(most > 0)
    while len(left):
        differ = eight[one[left] + out[left]] != eight[two[left] + out[left]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[left] = np.minimum(out[left] + first, most[left])
        left = left[(first == 8) & (out[left] < most[left])]
    return out


def dictionary_order(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Place of each phrase among the distinct ones sorted from their ends, and how long an end each of those shares with the one before."""
    turned = [p[::-1] for p in phrases]
    distinct = sorted(set(turned))
    place = {p: k for k, p in enumerate(distinct)}
    sizes = np.array([len(p) for p in distinct], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.frombuffer(b"".join(distinct) + b"\0", np.uint8)
    shared = common_prefix(data, starts[:-1], starts[1:], np.minimum(sizes[:-1], sizes[1:]))
    return np.array([place[p] for p in turned], np.int64), np.concatenate([[0], shared])


def parse_order(data: np.ndarray, trigger: np.ndarray, end: np.ndarray, spec: Spec, wanted: np.ndarray) -> np.ndarray:
    """Rank of the text after each wanted trigger (an index), as far as ``length`` bytes tell: the parse's suffix order."""
    until = np.minimum(np.searchsorted(trigger, trigger[wanted] + spec.length), np.searchsorted(end, end[wanted], "right"))
    steps = np.zeros(len(trigger) + 1, np.int64)
    np.add.at(steps, wanted, 1)
    np.subtract.at(steps, until, 1)
    used = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    at, stop = trigger[used], end[used]
    following = np.append(trigger, 0)[used + 1]
    same = np.append(end, -1)[used + 1] == stop
    close = np.minimum(np.where(same, following + spec.window, stop), at + spec.length)  # no more than length bytes matter
    phrases = [data[a:b].tobytes() for a, b in zip(at, close, strict=True)]
    ranks = {p: k + 1 for k, p in enumerate(sorted(set(phrases)))}
    rank = np.array([ranks[p] for p in phrases], np.int64)
    n = len(used)
    # the phrase after next is the next one used of the same document; 0 ends a document
    follows = np.concatenate([same[:-1] & (np.diff(used) == 1), [False]])
    after = np.where(follows, np.arange(1, n + 1), n)
    most = int((until - wanted).max())
    covered = 1
    while covered < most and int(rank.max()) < n:
        _, rank = np.unique(rank * (int(rank.max()) + 1) + np.append(rank, 0)[after], return_inverse=True)
        rank += 1
        after = np.append(after, n)[after]
        covered *= 2
    return rank[np.searchsorted(used, wanted)]


def string_classes(chunk: _Chunk, chosen: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal strings of the chosen triggered anchors.

    Returns where each string begins, its class, and for each class one such place and how many strings it has.
    """
    at, gap, end, least = (x[chosen] for x in (chunk.at, chunk.gap, chunk.end, chunk.least))
    order = np.argsort(-gap, kind="stable")
    at, gap, end, least = at[order], gap[order], end[order], least[order]
    place, shared_end = dictionary_order([chunk.data[a - g + 1 : a].tobytes() for a, g in zip(at, gap, strict=True)])
    rank = parse_order(chunk.data, chunk.trigger, chunk.trigger_end, spec, np.searchsorted(chunk.trigger, at))
    sort = np.argsort(rank, kind="stable")
    one, two = sort[:-1], sort[1:]
    most = np.minimum(np.minimum(end[one] - at[one], end[two] - at[two]), spec.length)
    common = np.concatenate([[0], common_prefix(chunk.data, at[one], at[two], most)])
    row = np.empty(len(sort), np.int64)
    row[sort] = np.arange(len(sort))
    begins, classes, places, counts, known = [], [], [], [], 0
    longest_first = -gap
    for distance in range(int(gap[0])):
        held = int(np.searchsorted(longest_first, -distance, "left"))  # gap > distance
        inside = np.flatnonzero(least[:held] <= distance)
        if not len(inside):
            continue
        ending = np.cumsum(shared_end < distance)[place[inside]]
        parsed = np.cumsum(common < spec.length - distance)[row[inside]]
        _, first, which, n = np.unique(ending * (len(at) + 1) + parsed, return_index=True, return_inverse=True, return_counts=True)
        begin = (at[inside] - distance).astype(np.int64)
        begins.append(begin)
        classes.append(which + known)
        places.append(begin[first])
        counts.append(n)
        known += len(n)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, classes, places, counts))


class _Chunk:
    """Documents of a chunk with their triggers and anchors, in places of the chunk's bytes."""

    def __init__(self, table: pa.Table, spec: Spec):
        self.spec = spec
        self.data, self.offsets = utf8(table.column("__text"))
        self.parts: list[_Part] = []
        for i, j in slices(self.offsets):
            base = self.offsets[i]
            self.parts.append(_Part(self.data[base : self.offsets[j]], self.offsets[i + 1 : j + 1] - base, int(base), spec))

        def gathered(name: str, moved: bool = True) -> np.ndarray:
            return np.concatenate([getattr(p, name) + (p.base if moved else 0) for p in self.parts]) if self.parts else np.zeros(0, np.int64)

        self.trigger, self.trigger_end, self.at, self.end = (gathered(x) for x in ("trigger", "trigger_end", "at", "end"))
        self.gap, self.least = gathered("gap", False), gathered("least", False)
        self.triggered = np.concatenate([p.triggered for p in self.parts]) if self.parts else np.zeros(0, bool)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash for each distinct text after an anchor; that of its context with two flags: several contexts, met twice."""
        both = [p.contexts(self.spec) for p in self.parts]
        after, whole = (np.concatenate([x[k] for x in both]) if both else np.zeros(0, np.uint64) for k in (0, 1))
        whole = whole & ~_LOW
        keys, self.which, n = np.unique(after, return_inverse=True, return_counts=True)
        lowest, highest = np.full(len(keys), ~np.uint64(0)), np.zeros(len(keys), np.uint64)
        np.minimum.at(lowest, self.which, whole)
        np.maximum.at(highest, self.which, whole)
        return keys, lowest | (lowest != highest).astype(np.uint64) << np.uint64(1) | (n > 1).astype(np.uint64)

    def strings(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of anchors in different contexts: hash of each distinct string, and 31 bits of another with a flag (met twice)."""
        mixed = mixed[self.which]
        parsed = np.flatnonzero(mixed & self.triggered)
        none = np.zeros(0, np.int64)
        self.begins, self.class_of, places, counts = string_classes(self, parsed, self.spec) if len(parsed) else (none,) * 4
        alone = self.at[mixed & ~self.triggered]  # stand for themselves
        key, check = self._hashes(np.concatenate([places, alone]))
        order = np.lexsort((check, key))
        change = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])]) if len(key) else np.zeros(0, bool)
        same = np.empty(len(key), np.int64)
        same[order] = np.cumsum(change) - 1
        sent = order[change]
        many = np.zeros(len(sent), np.int64)
        np.add.at(many, same, np.concatenate([counts, np.ones(len(alone), np.int64)]))
        self.begins = np.concatenate([self.begins, alone])
        self.class_of = np.concatenate([same[self.class_of], same[len(places) :]])
        return key[sent], check[sent] << np.uint32(1) | (many > 1).astype(np.uint32)

    def _hashes(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, check = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint32)
        whose = np.searchsorted([p.base for p in self.parts], begin, "right") - 1
        order = np.argsort(whose, kind="stable")
        edges = np.searchsorted(whose[order], np.arange(len(self.parts) + 1))
        for k, part in enumerate(self.parts):
            at = order[edges[k] : edges[k + 1]]
            if len(at):
                start = begin[at] - part.base
                key[at], check[at] = part.hash(start, start + self.spec.length), part.check(start, self.spec.length)
        return key, check

    def covered(self, settled: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Which bytes lie in a repeated string."""
        steps = np.zeros(len(self.data) + 1, np.int64)
        whole = settled[self.which]
        np.add.at(steps, self.at[whole] - self.gap[whole] + 1, 1)
        np.subtract.at(steps, self.at[whole] - self.least[whole] + self.spec.length, 1)
        begin = self.begins[repeated[self.class_of]]
        np.add.at(steps, begin, 1)
        np.subtract.at(steps, begin + self.spec.length, 1)
        return np.cumsum(steps[:-1]) > 0


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the key, so sorted keys lie bucket by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cells(chunk: int, buckets: int, keys: np.ndarray, more: np.ndarray) -> pa.Table:
    """A row for each bucket that gets some of the sorted keys: their bytes and those of ``more``."""
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    data = [keys[edges[b] : edges[b + 1]].tobytes() + more[edges[b] : edges[b + 1]].tobytes() for b in used]
    return pa.table({"chunk": pa.array(np.full(len(used), chunk), pa.int64()), "bucket": pa.array(used, pa.int64()), "data": pa.array(data, pa.binary())})


def _received(cells: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and what came with them, and how many each chunk sent."""
    data = cells.column("data").to_pylist()
    counts = np.array([len(x) // (8 + np.dtype(kind).itemsize) for x in data])
    keys = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(data, counts, strict=True)])
    return keys, np.concatenate([np.frombuffer(x, kind, n, 8 * n) for x, n in zip(data, counts, strict=True)]), counts


def _answers(cells: pa.Table, counts: np.ndarray, kinds: list[np.ndarray], stage: int) -> pa.Table:
    """For each chunk the bits of each kind, where one is set."""
    ends = np.cumsum(counts)
    rows = [
        (c, b"".join(np.packbits(bits[e - n : e]).tobytes() for bits in kinds))
        for c, n, e in zip(cells.column("chunk").to_pylist(), counts, ends, strict=True) if any(bits[e - n : e].any() for bits in kinds)]
    return pa.table({
        "chunk": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([cells.column("bucket")[0].as_py()] * len(rows), pa.int64()),
        "stage": pa.array([stage] * len(rows), pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


def _answered(answers: pa.Table, stage: int, keys: np.ndarray, buckets: int, kinds: int) -> np.ndarray:
    """The bits of a stage over the sorted keys, a row for each kind."""
    out = np.zeros((kinds, len(keys)), bool)
    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
    for b, s, data in zip(*(answers.column(c).to_pylist() for c in ("bucket", "stage", "data")), strict=True):
        if s == stage:
            bits = np.frombuffer(data, np.uint8).reshape(kinds, -1)
            out[:, edges[b] : edges[b + 1]] = np.unpackbits(bits, axis=1, count=edges[b + 1] - edges[b])
    return out


def _judge_contexts(cells: pa.Table) -> pa.Table:
    """Which texts are repeated in one context only, and which in different ones."""
    keys, whole, counts = _received(cells, np.uint64)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    flags = np.bitwise_or.reduceat(whole[order] & _LOW, starts)
    context = whole[order] & ~_LOW
    mixed = (np.minimum.reduceat(context, starts) != np.maximum.reduceat(context, starts)) | (flags & 2 > 0)
    repeated = (sizes > 1) | (flags & 1 > 0)
    bits = []
    for kind in (repeated & ~mixed, repeated & mixed):
        back = np.empty(len(keys), bool)
        back[order] = np.repeat(kind, sizes)
        bits.append(back)
    return _answers(cells, counts, bits, 0)


def _judge_strings(cells: pa.Table) -> pa.Table:
    """Which strings are repeated."""
    keys, more, counts = _received(cells, np.uint32)
    order = np.lexsort((more >> np.uint32(1), keys))
    change = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] >> np.uint32(1) != more[order][:-1] >> np.uint32(1))
    starts = np.flatnonzero(np.concatenate([[True], change]))
    sizes = np.diff(np.append(starts, len(keys)))
    repeated = (sizes > 1) | (np.bitwise_or.reduceat(more[order] & np.uint32(1), starts) > 0)
    back = np.empty(len(keys), bool)
    back[order] = np.repeat(repeated, sizes)
    return _answers(cells, counts, [back], 1)


def _kept(chunk: _Chunk, gone: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Of each document: bytes, removed bytes, removed runs and what is left."""
    offsets = chunk.offsets
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    starts = offsets[:-1][offsets[:-1] < len(gone)]
    first[starts] = gone[starts]
    removed, runs = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, first))
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    kept = pa.Array.from_buffers(pa.large_binary(), len(left) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(chunk.data[~gone])])
    return pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs), kept.cast(pa.binary())


def drop_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", *, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, chunks: int | None = None) -> DataFrame:
    """Cut the bytes that lie in a string of ``length`` bytes which also begins anywhere else, in the same document or another.

    Returns the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the bytes that are left: a cut may fall within a
    character of several bytes, so they need not be valid UTF-8. Strings are judged on the input and do not cross documents;
    every occurrence goes, the first one too. A null text is empty, and texts shorter than ``length`` keep everything. Every row is a document
    of its own, with or without an id, so rows that repeat one text remove each other. An empty table stays empty. Further columns
    of ``docs`` are ignored. A chunk holds one document at least, whatever its size.
    """
    if length < 16:
        raise ValueError("strings of at least 16 bytes are needed")
    spec = Spec(length)
    own = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    total = own.agg(F.sum(F.octet_length("__text")).alias("n")).first()["n"] or 0
    n, contexts, strings = (chunks or max(1, math.ceil(total / b)) for b in (chunk_bytes, CONTEXT_BYTES, STRING_BYTES))
    # the number of the input's partition spreads rows that are alike in everything, and is the same when a task runs again
    drawn = F.pmod(F.xxhash64("__id", "__text", F.spark_partition_id()), F.lit(n))
    by_chunk = own.select(drawn.alias("__chunk"), "__id", "__text").groupBy("__chunk")

    def number(table: pa.Table) -> int:
        return table.column("__chunk")[0].as_py()

    def send_contexts(table: pa.Table) -> pa.Table:
        return _cells(number(table), contexts, *_Chunk(table, spec).contexts())

    def ordered(table: pa.Table, answers: pa.Table) -> tuple[_Chunk, np.ndarray, np.ndarray, np.ndarray]:
        chunk = _Chunk(table, spec)
        keys, _ = chunk.contexts()
        settled, mixed = _answered(answers, 0, keys, contexts, 2)
        return chunk, settled, *chunk.strings(mixed)

    def send_strings(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _cells(0, strings, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        _, _, keys, more = ordered(table, answers)
        return _cells(number(table), strings, keys, more)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["__id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in (*[pa.int64()] * 4, pa.binary())], names)
        chunk, settled, keys, _ = ordered(table, answers)
        repeated = _answered(answers, 1, keys, strings, 1)[0]
        return pa.table([table.column("__id"), *_kept(chunk, chunk.covered(settled, repeated))], names)

    cells, answered = "chunk long, bucket long, data binary", "chunk long, bucket long, stage int, data binary"

    def exchanged(sent: DataFrame, judge: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(lean(judge), answered)

    first = exchanged(by_chunk.applyInArrow(lean(send_contexts), cells), _judge_contexts)
    second = exchanged(by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(lean(send_strings), cells), _judge_strings)
    result = by_chunk.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(lean(finish), "__id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return result.withColumnRenamed("__id", id)
