"""How far the word counts of sources diverge, by hash-consed segment trees over term ids.

Terms are runs of letters. Tasks count them per (language, source) and pass on sums, so a source that
holds a third of all rows is never gathered. The terms a language keeps are numbered from its most
frequent one down, and every (language, source) group has a segment tree over these numbers whose
leaves are its counts. Trees are cut into blocks of ``BLOCK`` leaves and sources into tiles of ``TILE``, so a
task holds two tiles of one block, however many terms and sources there are.

Within a task equal subtrees are one node: each level names its distinct pairs of children once, over
all groups and places, so the long tail of terms that a source does not have is a node a level. Two
trees are walked together from their roots; a pair of nodes that is met again, at whatever place, only adds to
its multiplicity, so each distinct pair is expanded once and each distinct pair of counts priced once.
All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.chunks import chunk_count
from cohortry.llm.sharding import numbered
from cohortry.llm.terms import codes, number_of, spelled
from cohortry.llm.words import LETTERS, Words, lean, mix, slices, utf8, words
from cohortry.sources.workspace import materialise

BLOCK = 4096
TILE = 32
LEAST_DOCS = 3
SCALE = 1_000_000_000
HELD = 1_500_000  # sums that a task holds before it passes them on
BUCKET_BYTES = 16 << 20  # of text, for each bucket that sums are merged in
TERM_RANKS = 200


class _Tally:
    """Sums of a task, passed on when many are held."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.sums: list[np.ndarray] = []  # rows: group, term's place, occurrences, documents
        self.hashes: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.places = self.size = self.read = 0

    def add(self, group: np.ndarray, doc: np.ndarray, found: Words, data: np.ndarray) -> None:
        """A slice: the group of each document, and the document of each word."""
        terms, first, term = np.unique(found.hash, return_index=True, return_inverse=True)
        in_doc, times = np.unique(doc * len(terms) + term, return_counts=True)
        kinds, inverse, docs = np.unique(group[in_doc // len(terms)] * len(terms) + in_doc % len(terms), return_inverse=True, return_counts=True)
        n = np.zeros(len(kinds), np.int64)
        np.add.at(n, inverse, times)
        self.sums.append(np.stack([kinds // len(terms), self.places + kinds % len(terms), n, docs]))
        self.hashes.append(terms)
        self.words.append(spelled(data, found.start[first], found.end[first]))
        self.places += len(terms)
        self.size += len(kinds)
        self.read += len(doc)

    def cells(self, buckets: int) -> pa.RecordBatch:
        """The sums dealt to buckets by group and term, so the counts of a frequent term or a large source are
        spread. A row for each bucket: its groups, its terms, and four numbers for each sum."""
        group, place, n, docs = np.concatenate(self.sums, axis=1)
        terms, first, term = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        names = list(self.groups)
        drawn = np.array([number_of("\0".join(g)) for g in names], np.uint64)
        key = group * len(terms) + term[place]
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        kinds = key[order][starts]
        group, term = kinds // len(terms), kinds % len(terms)
        n, docs = (np.add.reduceat(x[order], starts) for x in (n, docs))
        bucket = (mix(terms[term] ^ drawn[group]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((term, bucket))
        group, term, n, docs, bucket = (x[order] for x in (group, term, n, docs, bucket))
        spelt = pa.concat_arrays(self.words)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows: list[tuple] = []
        texts: list[pa.Array] = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            groups, g = np.unique(group[x:y], return_inverse=True)
            words_, w = np.unique(term[x:y], return_inverse=True)
            texts.append(spelt.take(pa.array(first[words_])))
            rows.append((bucket[x], [names[k][0] for k in groups], [names[k][1] for k in groups], np.stack([g, w, n[x:y], docs[x:y]]).astype(np.uint32).tobytes()))
        self.clear()
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in (1, 2)),
            pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(texts)), pa.array([r[3] for r in rows], pa.binary())],
            ["bucket", "langs", "sources", "words", "data"])


def _cells(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences and documents of each (language, source, term), summed within the task and dealt to buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            group = codes(tally.groups, batch.column("lang"), batch.column("source"))
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                where = offsets[i : j + 1]
                part = data[where[0] : where[-1]]
                found = words(part, where - where[0], lower=True, letters=LETTERS)
                if len(found.hash):
                    tally.add(group[i:j], found.documents(), found, part)
                if tally.size > HELD or tally.read > 1 << 31:  # counts of a cell fit 32 bits
                    yield tally.cells(buckets)
        if tally.size:
            yield tally.cells(buckets)

    return lean(counted)


def _summed(cells: pa.Table) -> pa.Table:
    """The sums of a bucket over all tasks."""
    groups: dict[tuple, int] = {}
    numbers, base = [], 0
    words_ = cells.column("words").combine_chunks().flatten().dictionary_encode()
    spelt, word = words_.dictionary, words_.indices.to_numpy()
    for langs, sources, data in zip(*(cells.column(c).to_pylist() for c in ("langs", "sources", "data")), strict=True):
        g, w, n, docs = np.frombuffer(data, np.uint32).reshape(4, -1).astype(np.int64)
        local = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], np.int64)
        numbers.append(np.stack([local[g], word[base + w], n, docs]))
        base += int(w.max()) + 1
    group, term, n, docs = np.concatenate(numbers, axis=1)
    key = group * len(spelt) + term
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    kinds = key[order][starts]
    langs, sources = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(kinds // len(spelt))) for k in (0, 1))
    sums = [pa.array(np.add.reduceat(x[order], starts)) for x in (n, docs)]
    return pa.table([langs, sources, spelt.take(pa.array(kinds % len(spelt))), *sums], ["lang", "source", "term", "n", "docs"])


class Forest:
    """Segment trees of several groups over the same leaves, equal subtrees shared.

    ``counts``: a row for each group and a column for each leaf; a negative count is a leaf without a term.
    """

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, counts.shape[1] - 1).bit_length()
        padded = np.full((len(counts), width), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # children of each node, lowest level first
        size = len(self.leaves)
        while nodes.shape[1] > 1:
            pairs, up = np.unique(nodes[:, ::2] * size + nodes[:, 1::2], return_inverse=True)
            self.levels.append((pairs // size, pairs % size))
            nodes = up.reshape(len(counts), -1)
            size = len(pairs)
        self.roots = nodes[:, 0]

    def leaf_pairs(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Walk pairs of trees (rows of ``one`` and ``two``) together.

        Returns each distinct pair of counts of each pair of trees: which pair of trees, the counts, how often.
        """
        pair, a, b, times = np.arange(len(one)), self.roots[one], self.roots[two], np.ones(len(one), np.int64)
        for left, right in reversed(self.levels):
            size = max(int(left.max()), int(right.max())) + 1
            key = np.concatenate([(pair * size + side[a]) * size + side[b] for side in (left, right)])
            known, inverse = np.unique(key, return_inverse=True)
            summed = np.zeros(len(known), np.int64)
            np.add.at(summed, inverse, np.concatenate([times, times]))
            pair, a, b, times = known // (size * size), known // size % size, known % size, summed
        a, b = self.leaves[a], self.leaves[b]
        real = a >= 0
        return pair[real], a[real], b[real], times[real]


def share(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / (total + terms)), in Python's whole numbers where 64 bits are too few."""
    if len(counts) and int(counts.max()) + 1 > (2**63 - 1) // SCALE:
        return np.array([1 + SCALE * (c + 1) // (n + v) for c, n, v in zip(counts.tolist(), total.tolist(), terms.tolist(), strict=True)], np.int64)
    return 1 + SCALE * (counts + 1) // (total + terms)


def _highest(value: np.ndarray, item: pa.Array, ranks: int) -> np.ndarray:
    """Where the first ``ranks`` values are, ties by the bytes of their items."""
    if len(value) > ranks:
        least = np.partition(value, len(value) - ranks)[len(value) - ranks]
        near = np.flatnonzero(value >= least)
    else:
        near = np.arange(len(value))
    spelt = [x.encode() for x in item.take(pa.array(near)).to_pylist()]
    return near[sorted(range(len(near)), key=lambda k: (-value[near[k]], spelt[k]))[:ranks]]


def _priced(held: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """A block's part of the divergence of each pair of sources of two tiles, in both directions, and the
    block's highest terms of each source where a tile meets itself."""
    names = ["lang", "source", "part", "item", "value"]
    kinds = [*[pa.string()] * 4, pa.int64()]
    if not groups.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    number, tile = groups.column("number").to_numpy(), groups.column("tile").to_numpy()
    order = np.argsort(number, kind="stable")
    number, tile = number[order], tile[order]
    total, terms = (groups.column(c).to_numpy()[order] for c in ("total", "terms"))
    counts = np.zeros((len(number), groups.column("width")[0].as_py()), np.int64)
    row, leaf, n = (held.column(c).to_numpy() for c in ("number", "leaf", "n"))
    row = np.searchsorted(number, row)
    counts[row, leaf] = n
    source = groups.column("source").combine_chunks().take(pa.array(order))
    one, two = np.triu_indices(len(number), 1)
    alone = tile[0] == tile[-1]
    if not alone:  # pairs within a tile are priced where the tile meets itself
        across = tile[one] != tile[two]
        one, two = one[across], two[across]
    pair, a, b, times = Forest(counts).leaf_pairs(one, two)
    p = share(a, total[one[pair]], terms[one[pair]])
    q = share(b, total[two[pair]], terms[two[pair]])
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    square = (p - q) * (p - q)
    values = [np.add.reduceat(times * (square // r), starts) if len(pair) else np.zeros(0, np.int64) for r in (q, p)]
    x, y = (source.take(pa.array(k[pair[starts]])) for k in (one, two))
    of, part, item, value = [x, y], ["pair"] * (2 * len(starts)), [y, x], values
    if alone and held.num_rows:
        p = share(n, total[row], terms[row])
        q = share(held.column("in_lang").to_numpy(), np.full(len(row), groups.column("lang_total")[0].as_py()), terms[row])
        spelt = held.column("term").combine_chunks()
        for k in range(len(number)):
            at = np.flatnonzero((row == k) & (p > q))
            apart = (p[at] - q[at]) * (p[at] - q[at]) // q[at]
            best = _highest(apart, spelt.take(pa.array(at)), ranks)
            of.append(source.take(pa.array(np.full(len(best), k))))
            part += ["term"] * len(best)
            item.append(spelt.take(pa.array(at[best])))
            value.append(apart[best])
    lang = groups.column("lang")[0].as_py()
    return pa.table([pa.array([lang] * len(part), pa.string()), pa.concat_arrays(of), pa.array(part, pa.string()), pa.concat_arrays(item), pa.array(np.concatenate(value), pa.int64())], names)


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", *, least_docs: int = LEAST_DOCS,
    term_ranks: int = TERM_RANKS, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """What sets each source of a language apart: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: ``item`` is another source of the language and ``value`` how far it is, summed over all terms that the
    language keeps (those in ``least_docs`` of its documents). Part ``term``: ``item`` is a term more frequent here than in
    the language, the first ``term_ranks`` of them. A null language, source or text counts as an empty one. Every
    row is a document, whatever its id, so repeated rows count repeatedly. A source without terms has shares like any
    other (each term's count is 0); a language that keeps no term has pairs of value 0 and no terms; a source that is alone in its language has no
    pairs; an empty table gives no rows. Further columns of ``docs`` are ignored. Ties go by the item's UTF-8 bytes.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    cells = plain.mapInArrow(_cells(chunk_count(plain, "text", BUCKET_BYTES)), "bucket long, langs array<string>, sources array<string>, words array<string>, data binary")
    counts = materialise(cells.groupBy("bucket").applyInArrow(lean(_summed), "lang string, source string, term string, n long, docs long"), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    ordered = materialise(numbered(kept.select("lang", "term", "in_lang", (-F.col("in_lang")).alias("less")), ["lang", "less", "term"], "id"), "terms")
    langs = ordered.groupBy("lang").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    held = materialise(
        counts.select("lang", "source", "term", "n").join(ordered.select("lang", "term", "in_lang", "id"), ["lang", "term"]).join(langs, "lang")
        .select("lang", "source", "term", "n", "in_lang", (F.col("id") - F.col("first")).alias("id"), "terms"), "held")

    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    listed = numbered(plain.select("lang", "source").distinct(), ["lang", "source"], "at")
    groups = listed.join(listed.groupBy("lang").agg(F.min("at").alias("base"), F.count(F.lit(1)).alias("sources")), "lang").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.select(
        "lang", "source", (F.col("at") - F.col("base")).alias("number"), F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total", F.expr(f"(sources + {tile - 1}) div {tile}").alias("tiles")), "groups")
    numbers = groups.withColumn("tile", F.expr(f"number div {tile}"))

    # every tile meets every tile of its language once, itself included, in each block of leaves
    meets = F.explode(F.expr("transform(sequence(0L, tiles - 1), t -> struct(least(t, tile) AS i, greatest(t, tile) AS j))"))
    met = numbers.withColumn("m", meets).select("*", "m.i", "m.j").drop("m")
    per_block = met.filter("terms > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (terms - 1) div {block})")))
    per_block = per_block.withColumn("width", F.expr(f"least({block}L, terms - block * {block})"))
    leaves = held.select("lang", "source", F.expr(f"id div {block}").alias("block"), F.expr(f"id % {block}").alias("leaf"), "n", "term", "in_lang")
    leaves = leaves.join(met.select("lang", "source", "number", "i", "j"), ["lang", "source"])
    leaves = leaves.select(*[F.col(c).alias(c) for c in ("lang", "block", "i", "j", "number", "leaf", "n", "term", "in_lang")])  # columns of their own for the cogroup
    keys = ["lang", "block", "i", "j"]

    def step(held: pa.Table, groups: pa.Table) -> pa.Table:
        return _priced(held, groups, term_ranks)

    priced = materialise(
        leaves.groupBy(*keys).cogroup(per_block.groupBy(*keys)).applyInArrow(lean(step), "lang string, source string, part string, item string, value long"), "priced")
    sums = priced.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    ranked = priced.filter("part = 'term'").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= term_ranks)
    return pairs.withColumn("rank", F.row_number().over(ranks)).unionByName(ranked)
