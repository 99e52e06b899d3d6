"""Context-triggered piecewise hashes of whole texts.

A rolling hash over seven bytes ends a chunk where its low bits are zero, so an edit moves only the
boundaries next to it. Each chunk gives one of 64 characters. The block size is the least power of two
(4 at least) at which a text has fewer than 64 boundaries; the signature there and the one at twice the
block size make the fingerprint ``size:signature:signature``. Fingerprints of the same or of
neighbouring block sizes are compared by edit distance, many pairs at once with the bits of a
64-bit number for the cells of a column.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.words import constants, lean, mix, powers, slices, utf8
from cohortry.sources.workspace import materialise

WIDTH = 64
ROLL = 7
LEAST_BITS = 2
RUN = 4  # characters in a row that two signatures must share to be alike at all
RANGE_BYTES = 64 << 20
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE, _ROLL = constants(21, 256), constants(22, ROLL)


@dataclass
class Prints:
    """Fingerprints of some texts: block bits, and the two signatures as rows of characters (0 beyond their length)."""

    bits: np.ndarray
    one: np.ndarray
    two: np.ndarray

    def take(self, at: np.ndarray) -> Prints:
        return Prints(self.bits[at], self.one[at], self.two[at])

    def strings(self) -> list[str]:
        return [f"{1 << b}:{x.tobytes().rstrip(b'\0').decode()}:{y.tobytes().rstrip(b'\0').decode()}" for b, x, y in zip(self.bits.tolist(), self.one, self.two, strict=True)]

    @staticmethod
    def join(parts: list[Prints]) -> Prints:
        return Prints(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("bits", "one", "two")))


def _signature(level: np.ndarray, at: np.ndarray, doc: np.ndarray, least: np.ndarray, offsets: np.ndarray, total: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Characters of the chunks that end where the level reaches the document's, and of the rest behind the last."""
    keep = level >= least[doc]
    n = len(offsets) - 1
    ends = np.concatenate([at[keep] + 1, offsets[1:]])
    owner = np.concatenate([doc[keep], np.arange(n)])
    order = np.lexsort((ends, owner))
    ends, owner = ends[order], owner[order]
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(owner, np.arange(n))
    starts[first] = offsets[:-1]
    full = ends > starts  # a text may end with a boundary
    starts, ends, owner = starts[full], ends[full], owner[full]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.zeros((n, WIDTH), np.uint8)
    out[owner, place] = _ALPHABET[(mix((total[ends] - total[starts]) * down[starts]) & np.uint64(63)).astype(np.int64)]
    return out


def _prints_of_slice(data: np.ndarray, offsets: np.ndarray) -> Prints:
    n, docs = len(data), len(offsets) - 1
    value = _BYTE[data]
    rolled = value * _ROLL[0]
    starts = np.unique(offsets[:-1])
    for k in range(1, ROLL):
        earlier = np.zeros(n, np.uint64)
        earlier[k:] = value[:-k] if k < n else 0
        for j in range(k):  # bytes before the text count as nothing
            earlier[starts[starts + j < n] + j] = 0
        rolled += earlier * _ROLL[k]
    rolled = mix(rolled)
    at = np.flatnonzero(rolled & np.uint64((1 << LEAST_BITS) - 1) == 0)
    doc = np.searchsorted(offsets, at, "right") - 1
    low = rolled[at] | np.uint64(1 << 40)
    level = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
    counts = np.bincount(doc * 41 + level, minlength=docs * 41).reshape(docs, 41)
    reaching = counts[:, ::-1].cumsum(1)[:, ::-1]
    bits = np.maximum((reaching >= WIDTH).sum(1), LEAST_BITS)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=total[1:])
    return Prints(bits, *(_signature(level, at, doc, bits + more, offsets, total, down) for more in (0, 1)))


def prints(data: np.ndarray, offsets: np.ndarray) -> Prints:
    """Fingerprints of the texts whose bytes are ``data`` with ``offsets``."""
    parts = [_prints_of_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
    return Prints.join(parts) if parts else Prints(np.zeros(0, np.int64), np.zeros((0, WIDTH), np.uint8), np.zeros((0, WIDTH), np.uint8))


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of rows: a column of the table is two 64-bit numbers of its steps up and down."""
    la, lb = (a > 0).sum(1), (b > 0).sum(1)
    one = np.uint64(1)
    up, down = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    last = np.maximum(la - 1, 0).astype(np.uint64)
    score = la.astype(np.int64)
    for j in range(int(lb.max(initial=0))):
        live = j < lb
        same = np.packbits((a == b[:, j : j + 1]) & (a > 0), axis=1, bitorder="little").view(np.uint64)[:, 0]
        level = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(level | up), level & up
        score += np.where(live, (plus >> last & one).astype(np.int64) - (minus >> last & one).astype(np.int64), 0)
        plus, minus = plus << one | one, minus << one
        up, down = np.where(live, minus | ~(level | plus), up), np.where(live, plus & level, down)
    return np.where(la == 0, lb, score)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the edit distance by the longer length; 0 without a common run of characters."""
    la, lb = (a > 0).sum(1), (b > 0).sum(1)
    longer, shorter = np.maximum(la, lb), np.minimum(la, lb)
    out = 1 - edit_distances(a, b) / np.maximum(longer, 1)
    key = [sum(x[:, k : WIDTH - RUN + 1 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(RUN)) for x in (a, b)]
    full = [np.arange(WIDTH - RUN + 1)[None, :] <= n[:, None] - RUN for n in (la, lb)]
    shared = np.zeros(len(a), bool)
    for k in range(WIDTH - RUN + 1):
        shared |= ((key[0][:, k : k + 1] == key[1]) & full[1]).any(1) & full[0][:, k]
    return np.where((shorter >= RUN) & ~shared, 0.0, np.where(shorter == 0, (longer == 0).astype(float), out))


def likeness(a: Prints, b: Prints, rows: int = 4096) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; 0 where block sizes are further apart than a factor of two."""
    out = np.zeros(len(a.bits))
    for i in range(0, len(out), rows):
        s = slice(i, i + rows)
        difference = a.bits[s] - b.bits[s]
        for step, sides in ((0, ((a.one, b.one), (a.two, b.two))), (1, ((a.one, b.two),)), (-1, ((a.two, b.one),))):
            at = i + np.flatnonzero(difference == step)
            for x, y in sides:
                if len(at):
                    out[at] = np.maximum(out[at], _alike(x[at], y[at]))
    return out


def parse(fingerprints: list[str]) -> Prints:
    """Fingerprints from their strings."""
    cut = [f.split(":") for f in fingerprints]
    rows = [np.array([np.frombuffer(c[k].encode().ljust(WIDTH, b"\0"), np.uint8) for c in cut]).reshape(-1, WIDTH) for k in (1, 2)]
    return Prints(np.array([int(c[0]).bit_length() - 1 for c in cut], np.int64), *rows)


def fingerprint(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id and ``fingerprint`` of every row's whole text; a null text is empty. Further columns are ignored."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints(*utf8(batch.column(1))).strings(), pa.string())], ["__id", "fingerprint"])

    return docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text")).mapInArrow(lean(made), "__id long, fingerprint string").withColumnRenamed("__id", id)


def _compared(texts: list[bytes], following: list[bytes], own: Prints, next_: Prints) -> list[pa.Array]:
    """Columns of documents of which the next one is given: what replacing a text's last quarter by the next one's start does."""
    edited, n_chars = [], []
    for text, other in zip(texts, following, strict=True):
        codes = np.frombuffer(text, np.uint8)
        leads = np.flatnonzero((codes & 0xC0) != 0x80)
        quarter = len(leads) // 4
        n_chars.append(len(leads))
        cut = int(leads[len(leads) - quarter]) if quarter else len(text)
        start = np.flatnonzero((np.frombuffer(other[: 4 * quarter], np.uint8) & 0xC0) != 0x80)
        edited.append(text[:cut] + (other[: int(start[quarter])] if len(start) > quarter else other[: 4 * quarter] if quarter else b""))
    sizes = np.concatenate([[0], np.cumsum([len(e) for e in edited])]).astype(np.int64)
    changed = prints(np.frombuffer(b"".join(edited), np.uint8), sizes)
    return [
        pa.array(n_chars, pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(own.strings()), pa.array(changed.strings()),
        pa.array(likeness(own, changed)), pa.array(likeness(own, next_)),
    ]


_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def against_next(docs: DataFrame, id: str = "doc_id", text: str = "text", *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text, of its edited form and their likeness to it and to the next document's.

    The next document is that with the next larger id, the first after the last; rows without id come
    last, and rows that share an id follow one another by a hash of their text. Texts are shuffled once, into ranges of
    ids; the last row of each range is completed afterwards with the first of the next.
    """
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / range_bytes))
    rows = docs.select(F.col(id).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    keys = [F.col("__id").asc_nulls_last(), F.xxhash64("__text")]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    fields = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in _COLUMNS[1:4]], *[(c, pa.float64()) for c in _COLUMNS[4:]]])

    def edge(kind: int, part: int, id: int | None, text: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "id": id, "text": text.decode("utf-8", "replace")}], fields)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[bytes] = []
        own = None
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            for i, j in slices(offsets):
                if not i and own is None:
                    yield edge(1, part, batch.column("__id")[0].as_py(), data[: offsets[1]].tobytes())
                found = prints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = found if own is None else Prints.join([own, found])
                ids += batch.column("__id").slice(i, j - i).to_pylist()
                texts += [data[a:b].tobytes() for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)]
                n = len(ids) - 1
                if n:
                    columns = _compared(texts[:n], texts[1:], own.take(np.arange(n)), own.take(np.arange(1, n + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(ids[:n], pa.int64()), pa.nulls(n, pa.string()), *columns], schema=fields)
                ids, texts, own = ids[n:], texts[n:], own.take(np.array([n]))
        if ids:
            yield edge(2, part, ids[0], texts[0])

    ddl = "kind int, part long, id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = materialise(ranged.mapInArrow(lean(compared), ddl), "fingerprints")

    heads = done.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    order = Window.orderBy("part")
    numbers = done.filter("kind = 1").select("part")  # a number for each range
    pairs = numbers.withColumn("next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.orderBy(F.lit(0)))))
    lasts = done.filter("kind = 2").select("part", "id", "text").join(F.broadcast(pairs), "part").join(heads, "next")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = ([t.encode() for t in batch.column(c).to_pylist()] for c in ("text", "following"))
            own, next_ = (prints(*utf8(batch.column(c))) for c in ("text", "following"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *_compared(texts, following, own, next_)], ["id", *_COLUMNS])

    ends = lasts.select("id", "text", "following").mapInArrow(lean(complete), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.filter("kind = 0").select("id", *_COLUMNS).unionByName(ends).withColumnRenamed("id", id)
