"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes, counted over a sample of its texts and
frozen. A byte costs what an arithmetic coder would spend on it: in its longest known context, or an
escape (as frequent as the context has distinct followers) and its cost in the next shorter one,
without the bytes that the longer one would have coded; in the end all bytes are equal. These costs
are computed once for every context and byte, so a text's exact code length in every
language is a sum of table entries. The language with the shortest code wins; the score is its
probability under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.words import lean, slices, utf8

SAMPLE_ROWS = 2000  # different texts of a language
MAX_LANGUAGES = 256
ORDER = 3
LEAST = 8  # occurrences of a context of full order; rarer ones give way to the next shorter
UNIT = 256  # costs are whole 1/256 bits
UNKNOWN = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text (0 before the first)."""
    out = data.astype(np.uint32)
    starts = np.unique(offsets[:-1])
    for k in range(1, ORDER + 1):
        earlier = np.zeros(len(data), np.uint32)
        earlier[k:] = data[:-k] if k < len(data) else 0
        for j in range(k):
            earlier[starts[starts + j < len(data)] + j] = 0
        out |= earlier << np.uint32(8 * k)
    return out


@dataclass
class Model:
    """Languages, the number of each byte in the table's alphabet, the state of each context and the costs."""

    languages: list[str]
    symbol: np.ndarray  # 256; the last number is any byte never seen
    state: np.ndarray  # by three symbols
    cost: np.ndarray  # languages, states * symbols

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts by languages: code length in bits."""
        n, size = len(offsets) - 1, int(self.symbol.max()) + 1
        full = np.flatnonzero(np.diff(offsets))
        out = np.zeros((n, len(self.languages)))
        if len(full):
            own = self.symbol[data].astype(np.int32)
            context = np.zeros(len(data), np.int32)
            first = offsets[:-1][full]
            for k in range(ORDER, 0, -1):
                earlier = np.zeros(len(data), np.int32)
                earlier[k:] = own[:-k] if k < len(data) else 0
                for j in range(k):
                    earlier[first[first + j < len(data)] + j] = self.symbol[0]
                context = context * size + earlier
            at = self.state[context] * size + own
            for k, cost in enumerate(self.cost):
                out[full, k] = np.add.reduceat(cost[at], first, dtype=np.int64) / UNIT
        return out


def _model(counted: list[tuple[str, int, int]]) -> Model:
    """The table for counts of (language, three bytes and the next, number)."""
    languages = sorted({c[0] for c in counted})
    number = {name: k for k, name in enumerate(languages)}
    lang = np.array([number[c[0]] for c in counted], np.int64)
    gram = np.array([c[1] for c in counted], np.int64)
    times = np.array([c[2] for c in counted], np.float64)
    seen = np.zeros(256, bool)
    seen[0] = True
    for k in range(ORDER + 1):
        seen[gram >> (8 * k) & 255] = True
    symbol = np.full(256, seen.sum(), np.int64)
    symbol[seen] = np.arange(seen.sum())
    size = int(seen.sum()) + 1
    parts = [symbol[gram >> (8 * k) & 255] for k in range(ORDER, -1, -1)]  # oldest byte first

    def context(k: int) -> np.ndarray:
        """The last k bytes before the coded one as a number."""
        value = np.zeros(len(gram), np.int64)
        for part in parts[ORDER - k : ORDER]:
            value = value * size + part
        return value

    deepest = context(ORDER)
    names, inverse = np.unique(deepest, return_inverse=True)
    often = names[np.bincount(inverse, times) >= LEAST]
    # states: every context that precedes a byte in some language, the deepest if frequent
    states = [np.zeros(1, np.int64), *(np.unique(context(k)) for k in range(1, ORDER)), often]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in states])])
    cost = np.empty((len(languages), begin[-1], size), np.int16)
    for l in range(len(languages)):
        mine = lang == l
        tables, parents = [], []
        for k, known in enumerate(states):
            here = context(k)[mine]
            place = np.minimum(np.searchsorted(known, here), max(len(known) - 1, 0))
            good = known[place] == here if len(known) else np.zeros(len(here), bool)
            table = np.zeros((len(known), size), np.float32)
            np.add.at(table, (place[good], parts[ORDER][mine][good]), times[mine][good])
            tables.append(table)
            parents.append(np.searchsorted(states[k - 1], known % size ** (k - 1)) if k else np.zeros(1, np.int64))
        for k, table in enumerate(tables):
            bits = np.zeros(table.shape, np.float32)
            spent = np.zeros(len(table), np.float32)
            before = np.zeros(table.shape, bool)
            up, row = k, np.arange(len(table))
            while up >= 0:
                here = tables[up][row]
                open_ = (here > 0) & ~before
                distinct = open_.sum(1)
                whole = np.where(open_, here, 0).sum(1) + distinct
                bits = np.where(open_, spent[:, None] - np.log2(np.where(open_, here, 1) / np.maximum(whole, 1)[:, None]), bits)
                spent = spent + np.where(distinct > 0, -np.log2(np.maximum(distinct, 1) / np.maximum(whole, 1)), 0)
                before |= here > 0
                row = parents[up][row]
                up -= 1
            bits = np.where(before, bits, (spent + np.log2(np.maximum(256 - before.sum(1), 1)))[:, None])
            cost[l, begin[k] : begin[k + 1]] = np.minimum(np.rint(bits * UNIT), np.iinfo(np.int16).max)
    state = np.zeros(size**ORDER, np.int32)
    value = np.arange(size**ORDER)
    for k in range(1, ORDER + 1):
        tail = value % size**k
        place = np.minimum(np.searchsorted(states[k], tail), max(len(states[k]) - 1, 0))
        good = states[k][place] == tail if len(states[k]) else np.zeros(len(tail), bool)
        state[good] = (begin[k] + place[good]).astype(np.int32)
    return Model(languages, symbol, state, cost.reshape(len(languages), -1))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", *, rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from a sample of ``rows`` different texts of each language, chosen by a hash of the text; None without any.

    Rows without text or language are left out. Copies of a text count once, and a language with fewer texts
    gives all of them, so every language is learned.
    """
    known = docs.select(F.col(text).alias("__text"), F.col(lang).alias("__lang")).filter("__text IS NOT NULL AND __lang IS NOT NULL").withColumn("__h", F.xxhash64("__text"))
    # Spark cuts every language to `rows` hashes before the shuffle
    within = F.row_number().over(Window.partitionBy("__lang").orderBy("__h"))
    drawn = known.select("__lang", "__h").distinct().withColumn("__rn", within).filter(F.col("__rn") <= rows).drop("__rn")
    names = known.select("__lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if names > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not names:
        return None
    # at most rows * MAX_LANGUAGES pairs of a language and a hash
    sample = known.join(F.broadcast(drawn), ["__lang", "__h"]).dropDuplicates(["__lang", "__h"]).select("__text", "__lang")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("__lang").to_pylist(), object)
            data, offsets = utf8(batch.column("__text"))
            grams = _grams(data, offsets)
            whose = np.repeat(np.arange(len(names)), np.diff(offsets))
            for name in sorted(set(names)):
                found, n = np.unique(grams[(names == name)[whose]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    totals = sample.mapInArrow(lean(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return _model([(r["lang"], r["gram"], r["n"]) for r in totals.collect()])


def predict(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the language of its whole text, its probability and the bits a byte it costs.

    A null text and one without a letter are ``und`` with score 0, and so is every text of a model
    without languages. Ties go to the language first in order. Further columns are ignored; an id
    may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LANGUAGES tables made from a bounded sample
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column("__text"))
            for i, j in slices(offsets):
                where = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                some = np.concatenate([[0], np.cumsum(letters[part])])[where]
                spoken = np.diff(some) > 0
                for k in np.flatnonzero(~spoken & (np.diff(where) > 0)):
                    spoken[k] = any(c.isalpha() for c in part[where[k] : where[k + 1]].tobytes().decode("utf-8", "replace"))
                if m is None:
                    spoken[:] = False
                names, scores, rates = np.full(j - i, UNKNOWN, object), np.zeros(j - i), np.zeros(j - i)
                if spoken.any():
                    bits = m.code_lengths(part, where)
                    best = bits.argmin(1)
                    least = bits[np.arange(j - i), best]
                    names[spoken] = np.array(m.languages, object)[best[spoken]]
                    scores[spoken] = (1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1))[spoken]
                    rates[spoken] = (least / np.maximum(np.diff(where), 1))[spoken]
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, j - i), pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], ["__id", "lang_pred", "score", "bits_per_byte"])

    found = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    return found.mapInArrow(lean(predicted), "__id long, lang_pred string, score double, bits_per_byte double").withColumnRenamed("__id", id)
