"""Toxicity by the nearest labelled examples.

A text is the vector of its words, each weighted (1 + ln count) * idf * rf ** 2 and scaled to length 1. idf = ln((1 + N) / (1 + df))
counts all documents; rf = log2(2 + odds) is the relevance frequency of a word, its share among the examples of label 1 over its
share among the others. rf stretches the axes by what the labels say of them and removes none: every word of every
example is in the index, and only words that no example has have no axis.

The index is inverted, in two parts. A rare word has a list of the examples that hold it, which a search adds up whole. The
lists of frequent words lie block by block of examples, with the largest weight of each word in each block.
The sum over the rare words plus those maxima bounds the cosine of any example of a block, so after the most promising
blocks only those are read that may still hold a nearer example. The search is exact. Examples that resemble one another share blocks,
which keeps the bounds low.

The nearest vote with their cosine, and the votes are calibrated on the examples themselves, each scored without itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.words import LETTERS, lean, slices, utf8, words

SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 96 << 20
NEIGHBOURS = 15
BLOCK = 64
FREQUENT = 0.05  # of the examples hold a word whose list is cut in blocks
COLUMNS = 1024  # words at most whose lists are
THRESHOLD = 0.3
_SHRINK = 0.5
_UNSEEN = 3  # added to the examples of label 0 that hold a word, so that few examples prove little
_TOGETHER = 128  # texts searched for at a time
_FIRST = 8  # blocks read before the others are judged
_ERROR = 1e-4  # more than sums in single precision can be off
_PLACES = 1 << 16  # words whose document frequencies are added up together


def _counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first document, then the document, word and count of each word in a document, by document and word."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        where = offsets[i : j + 1]
        found = words(data[where[0] : where[-1]], where - where[0], lower=True, letters=LETTERS)
        known, word = np.unique(found.hash, return_inverse=True)
        pair, count = np.unique(found.documents() * max(1, len(known)) + word, return_counts=True)
        yield i, pair // max(1, len(known)), known[pair % max(1, len(known))] if len(known) else known, count


def _lists(first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists of some words lie, one after another, and the length of each."""
    size = first[place + 1] - first[place]
    return np.repeat(first[place] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()), size


def _small(numbers: np.ndarray) -> np.ndarray:
    """The same whole numbers in as few bytes as the largest takes."""
    return numbers.astype(np.min_scalar_type(int(numbers.max()) if len(numbers) else 0))


@dataclass
class Examples:
    """Words, their weights, and the index of the labelled examples.

    Only counts travel; each worker works the weights out from them.
    """

    terms: np.ndarray
    gain: np.ndarray  # idf * rf ** 2
    ids: np.ndarray
    labels: np.ndarray
    norm: np.ndarray  # of each example before it is scaled to 1
    sizes: np.ndarray  # of the lists of the words, 0 for a frequent one
    rows: np.ndarray
    counts: np.ndarray
    often: np.ndarray  # places of the frequent words
    dense_rows: np.ndarray  # their postings: example, frequent word, count
    dense_columns: np.ndarray
    dense_counts: np.ndarray
    rate: float = 0.0  # of label 1 among the examples
    prior: float = 0.0  # of label 1 among labelled texts without a word
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))

    def __post_init__(self) -> None:
        self.sent: Broadcast | None = None
        self.ready = False

    def open(self) -> None:
        """Work out the weights, on the worker that searches first."""
        if self.ready:
            return
        self.ready = True
        n, blocks = len(self.ids), max(1, -(-len(self.ids) // BLOCK))
        self.first = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        gain = np.repeat(self.gain, self.sizes)
        self.weights = ((1 + np.log(self.counts.astype(np.float32))) * gain / self.norm[self.rows]).astype(np.float32)
        self.column = np.full(len(self.terms), -1, np.int16)
        self.column[self.often] = np.arange(len(self.often))
        self.table = np.zeros((blocks * BLOCK, len(self.often)), np.float32)  # examples, filled up to whole blocks, by frequent words
        weight = (1 + np.log(self.dense_counts.astype(np.float32))) * self.gain[self.often][self.dense_columns] / self.norm[self.dense_rows]
        self.table[self.dense_rows, self.dense_columns] = weight
        self.table[n:] = 0
        self.highest = self.table.reshape(blocks, BLOCK, -1).max(axis=1) if len(self.often) else np.zeros((blocks, 0), np.float32)

    def __getstate__(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def broadcast(self, spark: SparkSession) -> Broadcast:
        """The index, sent once: at most ``rows`` examples of ``text_bytes``."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights, of unit length, of the words that some example has."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        known = self.terms[place] == terms if len(self.terms) else np.zeros(len(terms), bool)
        place = place[known]
        weight = (1 + np.log(counts[known])) * self.gain[place]
        norm = math.sqrt(weight @ weight)
        return place, weight / norm if norm else weight

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of largest cosine above 0 and the cosines; ties to the lower id.

        ``without``: an id for each vector whose examples do not count.
        """
        self.open()
        m, blocks = len(texts), len(self.highest)
        rare = np.zeros((m, blocks * BLOCK))
        frequent = np.zeros((m, self.table.shape[1]), np.float32)
        for i, (place, weight) in enumerate(texts):
            column = self.column[place]
            frequent[i, column[column >= 0]] = weight[column >= 0]
            at, size = _lists(self.first, place[column < 0])
            rare[i] = np.bincount(self.rows[at], self.weights[at] * np.repeat(weight[column < 0], size), blocks * BLOCK)
            if without is not None and without[i] is not None:
                rare[i, : len(self.ids)][self.ids == without[i]] = -np.inf
        bound = rare.reshape(m, blocks, BLOCK).max(axis=2) + frequent @ self.highest.T + _ERROR
        total = np.full((m, blocks * BLOCK), -np.inf)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                q, rows = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                total[q, rows] = rare[q, rows] + frequent[q] @ self.table[rows].T

        promising = np.zeros((m, blocks), bool)
        np.put_along_axis(promising, np.argsort(-bound, axis=1, kind="stable")[:, :_FIRST], True, axis=1)
        read(promising)
        size = min(blocks, _FIRST) * BLOCK
        floor = np.zeros(m)
        if k <= size:
            floor = np.partition(total[np.repeat(promising, BLOCK, axis=1)].reshape(m, size), size - k, axis=1)[:, size - k]
        floor = np.maximum(floor, 0) - 2 * _ERROR
        read((bound > np.maximum(floor, _ERROR)[:, None]) & ~promising)
        out = []
        for i, (place, weight) in enumerate(texts):
            near = np.flatnonzero(total[i] > floor[i])
            if len(near) > k:
                near = near[total[i, near] > np.partition(total[i, near], len(near) - k)[len(near) - k] - 2 * _ERROR]
            column = self.column[place]
            score = np.round(rare[i, near] + self.table[np.ix_(near, column[column >= 0])].astype(np.float64) @ weight[column >= 0], 12)
            near, score = near[score > 0], score[score > 0]
            best = np.lexsort((near, self.ids[near], -score))[:k]
            out.append((near[best], score[best]))
        return out

    def vote(self, rows: np.ndarray, scores: np.ndarray) -> float:
        return (scores @ self.labels[rows] + _SHRINK * self.rate) / (scores.sum() + _SHRINK)

def _alike(table: np.ndarray, groups: int = 16, rounds: int = 4) -> np.ndarray:
    """Order of rows that puts like ones together: rows by their nearest of a few means."""
    if len(table) <= groups:
        return np.arange(len(table))
    middle = table[np.linspace(0, len(table) - 1, groups).astype(int)]
    for _ in range(rounds):
        near = (table @ middle.T).argmax(axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, table)
        middle = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-9)
    return np.lexsort((-(table @ middle.T)[np.arange(len(table)), near], near))


def index(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, known: np.ndarray, idf: np.ndarray) -> Examples:
    """The index of examples whose words lie one after another. ``known``: all of these words, sorted, and their ``idf``."""
    n = len(ids)
    place, doc = np.searchsorted(known, terms).astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), sizes)
    toxic = labels > 0.5
    p, q = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    with_, without = (np.bincount(place[m[doc]], minlength=len(known)) for m in (toxic, ~toxic))
    gain = idf * np.log2(2 + (with_ / p) / ((without + _UNSEEN) / q)) ** 2
    gain = gain.astype(np.float32)
    weight = (1 + np.log(counts.astype(np.float32))) * gain[place]
    norm = np.sqrt(np.bincount(doc, weight * weight, n))
    df = with_ + without
    often = np.argsort(-df, kind="stable")[:COLUMNS]
    often = np.sort(often[df[often] >= max(2, FREQUENT * n)])
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    dense = column[place] >= 0
    weight = weight[dense] / np.where(norm > 0, norm, 1)[doc[dense]]
    table = np.zeros((n, len(often)), np.float32)
    table[doc[dense], column[place[dense]]] = weight
    order = _alike(table)
    del table, weight
    at = np.empty(n, np.int32)
    at[order] = np.arange(n)
    rare = np.flatnonzero(~dense)
    rare = rare[np.argsort(place[rare].astype(np.int64) * max(1, n) + at[doc[rare]], kind="stable")]
    return Examples(
        known, gain, ids[order], labels[order], np.where(norm > 0, norm, 1)[order].astype(np.float32), _small(np.bincount(place[rare], minlength=len(known))),
        _small(at[doc[rare]]), _small(counts[rare]), often, _small(at[doc[dense]]), _small(column[place[dense]]), _small(counts[dense]), float(toxic.mean()) if n else 0.0)


def _rising(x: np.ndarray, y: np.ndarray, least: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y over x (pooled adjacent violators), as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, max(1, len(order) // least)):
        pools.append([x[part].sum(), y[part].sum(), len(part)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def sample(labels: DataFrame, id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id; an id labelled twice keeps the larger label."""
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("double").alias("__label"))
    return known.orderBy(F.xxhash64("__id"), "__id").limit(rows)


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", *,
    rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_BYTES, neighbours: int = NEIGHBOURS,
) -> Examples:
    """Learn from a sample of labelled documents; document frequencies count all of ``docs``.

    The sample holds at most ``rows`` documents, taken in the order of a hash of their ids; one whose text would
    bring all texts above ``text_bytes`` is passed over. Rows without id or label are no examples. Of those without a word only the rate of
    label 1 is kept, (label 1) / (all + 1), for texts without evidence; it is 0 where there are none. Without
    examples every score is 0. An empty table gives no examples. Further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    # at most `rows` pairs of numbers: small whatever the size of the tables
    drawn = texts.join(F.broadcast(sample(labels, id, label, rows)), "__id")
    sizes = drawn.groupBy("__id").agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("size")).orderBy(F.xxhash64("__id"), "__id").toArrow()
    chosen, room = [], text_bytes
    for each, size in zip(sizes.column("__id").to_pylist(), sizes.column("size").to_pylist(), strict=True):
        if size <= room:
            chosen.append(each)
            room -= size
    examples = drawn.join(F.broadcast(spark.createDataFrame(pa.table({"__id": pa.array(chosen, pa.int64())}))), "__id", "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = ([b""] * batch.num_rows for _ in range(2))
            for i, d, word, count in _counts(batch.column("__text")):
                edges = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    terms[i + d[a]], counts[i + d[a]] = word[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["id", "label", "terms", "counts"])

    found = examples.mapInArrow(lean(vectors), "id long, label double, terms binary, counts binary").toArrow()
    order = pc.sort_indices(found, [("id", "ascending"), ("terms", "ascending"), ("counts", "ascending")])
    ids, given, many = (found.column(c).take(order).to_numpy().copy() if c else pc.binary_length(found.column("terms")).take(order).to_numpy() // 8 for c in ("id", "label", None))
    blank = given[many == 0]
    ids, given, many = (x[many > 0] for x in (ids, given, many))

    def joined(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(found.column(name)[k].as_buffer(), kind) for k in order.to_pylist()] or [np.zeros(0, kind)])

    terms, counts = joined("terms", np.uint64), _small(joined("counts", np.uint32))
    del found
    known = np.unique(terms)
    held = spark.sparkContext.broadcast(known)  # at most the words of `text_bytes`

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, word, _ in _counts(batch.column(0)):
                words_, many = np.unique(word, return_counts=True)
                place = np.minimum(np.searchsorted(held.value, words_), max(0, len(held.value) - 1))
                same = held.value[place] == words_ if len(held.value) else np.zeros(len(words_), bool)
                df[place[same]] += many[same]
        parts = [df[k : k + _PLACES].tobytes() for k in range(0, len(df), _PLACES)]
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1, *range(len(parts))], pa.int64()), "df": pa.array([np.int64(n).tobytes(), *parts], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("df"))
        return pa.table({"part": table.column("part").slice(0, 1), "df": pa.array([sums.tobytes()], pa.binary())})

    summed = texts.select("__text").mapInArrow(lean(frequencies), "part long, df binary").groupBy("part").applyInArrow(lean(added), "part long, df binary").toArrow()
    held.destroy()
    parts = {p: np.frombuffer(x, np.int64) for p, x in zip(summed.column("part").to_pylist(), summed.column("df").to_pylist(), strict=True)}
    n = int(parts.pop(-1, np.zeros(1, np.int64))[0])
    df = np.concatenate([parts[p] for p in sorted(parts)] or [np.zeros(0, np.int64)])
    model = index(ids, given, many, terms, counts, known, np.log((1 + n) / (1 + df)))
    del terms, counts, known
    model.prior = float(blank.sum() / (len(blank) + 1))
    shared = model.broadcast(spark)

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes, evidence = _votes(batch.column("__text"), shared.value, neighbours, batch.column("__id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(votes), batch.column("__label")], ["vote", "label"]).filter(pa.array([bool(e) for e in evidence], pa.bool_()))

    votes = examples.mapInArrow(lean(without_itself), "vote double, label double").toArrow()
    if votes.num_rows:
        model.steps = _rising(votes.column("vote").to_numpy(), votes.column("label").to_numpy())
    return model


def _votes(texts: pa.Array, model: Examples, neighbours: int, without: list[int | None] | None = None) -> tuple[np.ndarray, list[list[dict]]]:
    """The vote on each text, not calibrated, and its three nearest examples; NaN without any."""
    votes = np.full(len(texts), np.nan)
    evidence: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(model.ids):
        return votes, evidence
    for i, d, word, count in _counts(texts):
        edges = np.flatnonzero(np.diff(d, prepend=-1, append=-1))
        spans = list(zip(edges[:-1], edges[1:], strict=True))
        for at in range(0, len(spans), _TOGETHER):
            some = spans[at : at + _TOGETHER]
            docs = [int(i + d[a]) for a, _ in some]
            found = model.nearest([model.vector(word[a:b], count[a:b]) for a, b in some], neighbours, [without[k] for k in docs] if without else None)
            for k, (rows, cosines) in zip(docs, found, strict=True):
                if len(rows):
                    votes[k] = model.vote(rows, cosines)
                    evidence[k] = [{"id": int(model.ids[r]), "cosine": float(s), "label": float(model.labels[r])} for r, s in zip(rows[:3], cosines[:3], strict=True)]
    return votes, evidence


def _scores(texts: pa.Array, model: Examples, steps: tuple[np.ndarray, np.ndarray], neighbours: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text and its three nearest examples."""
    votes, evidence = _votes(texts, model, neighbours)
    found = np.array([bool(e) for e in evidence], bool)
    scores = np.full(len(texts), model.prior)
    scores[found] = np.interp(votes[found], *steps) if len(steps[0]) else votes[found]
    return np.clip(scores, 0, 1), evidence


def score(docs: DataFrame, model: Examples, id: str = "doc_id", text: str = "text", *, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Per document the score (0 to 1) and the evidence: its nearest examples with cosine and label.

    A text that shares no word with any example, an empty or a null one among them, has no evidence and gets the rate of label 1 among
    labelled texts without a word. Texts of any length are scored whole; an id may be null or repeated, each row is scored for itself. An empty table
    stays empty. Further columns of ``docs`` are ignored.
    """
    shared, steps = model.broadcast(docs.sparkSession), model.steps

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = _scores(batch.column("__text"), shared.value, steps, neighbours)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["__id", "score", "evidence"])

    kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.float64())]))
    found = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return found.mapInArrow(lean(scored), "__id long, score double, evidence array<struct<id: long, cosine: double, label: double>>").withColumnRenamed("__id", id)


def without_toxic(docs: DataFrame, model: Examples, id: str = "doc_id", text: str = "text", *, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns as they are.

    Null and empty texts score like any text without a word of an example (see ``score``) and stay unless that rate reaches the threshold. Ids play no part.
    Texts of any length are scored whole. An empty table stays empty.
    """
    shared, steps = model.broadcast(docs.sparkSession), model.steps

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            for i in range(0, batch.num_rows, 1000):
                scores, _ = _scores(texts.slice(i, 1000), shared.value, steps, neighbours)
                yield batch.slice(i, 1000).filter(pa.array(scores < threshold))

    return docs.mapInArrow(lean(kept), docs.schema)
