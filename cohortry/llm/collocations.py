"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A text is cut into pieces at ``.,;:!?`` and line breaks, a piece into words. Level m counts phrases of m words:
the stripe of a prefix of m - 1 words maps each next word to its count. Tasks build their stripes, deal
them to buckets and buckets merge them elementwise. A stripe is dealt by prefix *and* next word, so the one of a
very frequent word is never gathered in one task.

A phrase can only be frequent if the phrases without its first and without its last word are, so level m reads the
text for windows whose two parts level m - 1 found frequent, as a bit filter of bounded size tells; where the filter errs,
a phrase is counted in vain and dropped for its count. The entries kept give everything:

* an entry of a stripe is the count of a phrase, that is of an extension of its prefix;
* the total of a prefix is its own entry in the stripe that is one word shorter, and the total of what follows the
  first word likewise, so both sides of every cut are found among the entries;
* the largest entries of a stripe, and of the stripes that share a suffix, are the largest counts of longer phrases that
  subsume a phrase. One word more is enough: counts fall with every further word.

Words are told apart by 64-bit hashes, longer phrases by 128 bits; two words of one hash are an error, not a wrong count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.chunks import chunk_count
from cohortry.llm.terms import codes, number_of, spelled
from cohortry.llm.words import Words, lean, mix, slices, utf8, words
from cohortry.sources.workspace import materialise

LONGEST = 4
LEAST = 30
SUBSUMED = 80  # percent
RANKS = 2000
SCALE = 2_000_000
HELD = 1_500_000  # entries that a task holds before it passes them on
BUCKET_BYTES = 16 << 20  # of text, for each bucket that stripes are merged in
FILTER_BITS = 1 << 27  # at most: 16 MB
_STEP = np.uint64(0x9E6C63D0876A9A47)
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_PIECE
_WORD[[9, 32]] = False


def joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a prefix with one more word."""
    return mix(prefix * _STEP + word)


class _Slice:
    """Words of some documents as keys of their languages, and which of them follow one another in a piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.data = data
        self.found: Words = words(data, offsets, lower=True, letters=_WORD)
        doc = self.found.documents()
        self.doc = doc
        self.key = mix(self.found.hash ^ lang[doc])
        cuts = np.concatenate([[0], np.cumsum(_PIECE[data], dtype=np.int32)])
        start, end = self.found.start, self.found.end
        self.follows = (cuts[start[1:]] == cuts[end[:-1]]) & (doc[1:] == doc[:-1])

    def phrases(self, size: int, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Prefix and next word of each window of ``size`` words whose parts are frequent."""
        n = len(self.key) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        part = self.key
        for k in range(1, size - 1):
            part = joined(part[: len(self.key) - k], self.key[k:])
        inside = self.follows[:n].copy()
        for k in range(1, size - 1):
            inside &= self.follows[k : k + n]
        known = frequent.has(part)
        at = np.flatnonzero(inside & known[:n] & known[1 : n + 1])
        return part[at], self.key[at + size - 1]


class Filter:
    """Two bits a key in a field of 64-bit words; has no key in it that it denies."""

    def __init__(self, bits: int, places: np.ndarray, masks: np.ndarray):
        self.bits = np.uint64(bits)
        self.field = np.zeros(bits // 64, np.uint64)
        self.field[places] = masks.view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for place in (keys & (self.bits - np.uint64(1)), keys >> np.uint64(36) & (self.bits - np.uint64(1))):
            out &= self.field[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) > 0
        return out


def _filter(frequent: DataFrame, most: int) -> Filter:
    """The filter of the column ``key``: 16 bits a key up to ``most`` in all; only its words reach the driver."""
    bits = 1 << 10
    count = frequent.count()
    while bits < min(most, 16 * count):
        bits *= 2
    place = F.explode(F.array(F.expr(f"key & {bits - 1}L"), F.expr(f"shiftrightunsigned(key, 36) & {bits - 1}L")))
    masks = frequent.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("mask"))
    table = masks.toArrow()
    return Filter(bits, table.column("slot").to_numpy(), table.column("mask").to_numpy())


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of each language with its key and count, summed within the task."""
    langs: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
    size = 0

    def summed() -> pa.RecordBatch:
        keys, first, inverse = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, inverse, np.concatenate([h[1] for h in held]))
        of = pa.array(np.concatenate([h[2] for h in held])[first])
        names = pa.array([x[0] for x in langs], pa.string()).take(of)
        spelt = pa.concat_arrays([h[3] for h in held]).take(pa.array(first))
        return pa.RecordBatch.from_arrays([names, spelt, pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "phrase", "key", "n"])

    for batch in batches:
        lang = codes(langs, batch.column("lang"))
        number = np.array([number_of(x[0]) for x in langs], np.uint64)
        data, offsets = utf8(batch.column("text"))
        for i, j in slices(offsets):
            where = offsets[i : j + 1]
            part = _Slice(data[where[0] : where[-1]], where - where[0], number[lang[i:j]])
            keys, first, n = np.unique(part.key, return_index=True, return_counts=True)
            held.append((keys, n, lang[i + part.doc[first]], spelled(part.data, part.found.start[first], part.found.end[first])))
            size += len(keys)
            if size > HELD:
                yield summed()
                held, size = [], 0
    if size:
        yield summed()


def _merged(prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal entries added up: key of the phrase, prefix, next word and count."""
    key = joined(prefix, word)
    order = np.argsort(key, kind="stable")
    key, prefix, word, n = key[order], prefix[order], word[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])])) if len(key) else np.zeros(0, int)
    return key[starts], prefix[starts], word[starts], np.add.reduceat(n, starts) if len(starts) else n


def _packed(bucket: np.ndarray, prefix: np.ndarray, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stripes of each bucket, one after another: prefixes, lengths, next words, counts."""
    order = np.lexsort((word, prefix, bucket))
    bucket, prefix, word, n = bucket[order], prefix[order], word[order], n[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        stripes, lengths = np.unique(prefix[a:b], return_counts=True)
        rows.append(b"".join(x.tobytes() for x in (np.array([len(stripes), b - a], np.int64), stripes, lengths.astype(np.uint32), word[a:b], n[a:b])))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int64()), pa.array(rows, pa.binary())], ["bucket", "stripes"])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stripes, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
    at = 16
    out = []
    for kind, many in ((np.uint64, stripes), (np.uint32, stripes), (np.uint64, size), (np.int64, size)):
        out.append(np.frombuffer(data, kind, many, at))
        at += many * np.dtype(kind).itemsize
    return np.repeat(out[0], out[1]), out[2], out[3]


def _stripes(size: int, buckets: int, frequent: Callable[[], Filter]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stripes of a task's texts for prefixes of ``size - 1`` words."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = frequent()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        entries = 0

        def packed() -> pa.RecordBatch:
            key, prefix, word, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return _packed((key >> np.uint64(20)).astype(np.int64) % buckets, prefix, word, n)

        for batch in batches:
            lang = np.array([number_of(x) for x in batch.column("lang").to_pylist()], np.uint64)
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                where = offsets[i : j + 1]
                prefix, word = _Slice(data[where[0] : where[-1]], where - where[0], lang[i:j]).phrases(size, keep)
                _, prefix, word, n = _merged(prefix, word, np.ones(len(prefix), np.int64))
                held.append((prefix, word, n))
                entries += len(prefix)
                if entries > HELD:
                    yield packed()
                    held, entries = [], 0
        if entries:
            yield packed()

    return lean(built)


def _frequent_entries(least: int) -> Callable[[pa.Table], pa.Table]:
    """Merge a bucket's stripes elementwise and keep the entries of at least ``least``."""

    def merged(cells: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py()) for chunk in cells.column("stripes").chunks for x in chunk]
        key, prefix, word, n = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        often = n >= least
        return pa.table([*(pa.array(x[often].view(np.int64)) for x in (key, prefix, word)), pa.array(n[often])], ["key", "prefix", "word", "n"])

    return lean(merged)


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", *, longest: int = LONGEST, least: int = LEAST, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words with a count of at least ``least`` (``lang``, ``phrase``, ``size``, ``n``), and the number of words of each language."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = chunk_count(plain, "text", BUCKET_BYTES)
    counted = materialise(plain.mapInArrow(lean(_counted_words), "lang string, phrase string, key long, n long").groupBy("lang", "phrase", "key").agg(F.sum("n").alias("n")), "words")
    langs = counted.groupBy("lang").agg(F.sum("n").alias("words"))
    met = counted.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.min(c).alias(c) for c in ("lang", "phrase", "n")])
    met = met.withColumn("n", F.when(F.col("c") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two words with one hash")).cast("long")))
    single = materialise(met.filter(F.col("n") >= least).select("key", "lang", "phrase", "n"), "phrases")
    ending = single.select(F.col("key").alias("word"), F.col("phrase").alias("__last"))
    level, levels = single, [single.select("lang", "phrase", F.lit(1).alias("size"), "n")]
    for size in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(_filter(level, filter_bits))  # at most filter_bits / 8 bytes
        cells = plain.mapInArrow(_stripes(size, buckets, lambda s=shared: s.value), "bucket long, stripes binary")
        entries = cells.groupBy("bucket").applyInArrow(_frequent_entries(least), "key long, prefix long, word long, n long")
        before = level.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("__first"))
        named = entries.join(before, "prefix").join(ending, "word")
        level = materialise(named.select("key", "lang", F.concat_ws(" ", "__first", "__last").alias("phrase"), "n"), "phrases")
        levels.append(level.select("lang", "phrase", F.lit(size).alias("size"), "n"))
    found = levels[0]
    for each in levels[1:]:
        found = found.unionByName(each)
    return found, langs


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", *, longest: int = LONGEST, least: int = LEAST, subsumed: int = SUBSUMED,
    ranks: int = RANKS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """The first ``ranks`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase has 2 to ``longest`` words and ``a >= least`` occurrences. Of its cuts into two parts with ``l`` and ``r``
    occurrences the one with the lowest score, floor(2,000,000 a / (l + r)), counts, ties to the one with the shortest first
    part. Phrases within a longer one that has at least ``subsumed`` percent of their occurrences are left out. ``n`` is
    the number of words of the language. Ranks follow score, ``a`` and the phrase's UTF-8 bytes. A null language is
    ``und``; null and empty texts hold no words; every row counts, whatever its id, also repeated ones; an empty table gives no rows.
    Further columns of ``docs`` are ignored.
    """
    found, langs = frequent_phrases(docs, lang, text, longest=longest, least=least, filter_bits=filter_bits)
    long = found.filter("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = "flatten(transform(sequence(1, size - 1), k -> array(struct(k, 0 AS side, k AS m, array_join(slice(w, 1, k), ' ') AS part), struct(k, 1 AS side, size - k AS m, array_join(slice(w, k + 1, size - k), ' ') AS part))))"
    parts = long.select("lang", "phrase", "size", F.col("n").alias("a"), F.inline(F.expr(cuts)))
    # every part of a frequent phrase is frequent, so each finds its entry
    known = parts.join(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{name}{k}") for k in range(1, longest) for side, name in enumerate("lr")]
    split = known.groupBy("lang", "phrase", "size", "a").agg(*sides)
    score = "cast({scale} AS decimal(7, 0)) * cast(a AS decimal(19, 0)) div (cast(l{k} AS decimal(19, 0)) + cast(r{k} AS decimal(19, 0)))"
    each = ", ".join(f"struct({score.format(scale=SCALE, k=k)} AS score, {k} AS k, l{k} AS l, r{k} AS r)" for k in range(1, longest))
    lowest = split.withColumn("cut", F.expr(f"array_min(slice(array({each}), 1, size - 1))")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    extended = parts.filter("m = size - 1").groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    left = lowest.join(extended, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR cast(100 AS decimal(3, 0)) * longer < cast({subsumed} AS decimal(3, 0)) * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= ranks)
    return ranked.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
