"""Near duplicates: minhash signatures in a multi-index Hamming join, confirmed on the full sets.

A signature has 24 symbols of 16 bits in 6 chunks of 4. Two signatures at a distance of at most
``6 * 2 - 1 = 11`` symbols have, by pigeonhole, a chunk with at most one differing symbol; each
chunk is therefore indexed four times, once without each symbol, and all such pairs share a key. At the
similarity asked for the expected distance is 3.6, and a pair without a common key has a chance of
2e-6. Further symbols (64 of 8 bits) discard pairs before their texts are compared: the bound is
missed by a linked pair with a chance below 1e-7.

Equal sets are one class and enter once. Keys that few classes share give their pairs; a key that
many share (a large group of near copies) is dealt in blocks, each pair of blocks compared by one task
on the full sets, which returns only links that join what was not joined. So no group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.components import components
from cohortry.llm.words import constants, lean, mix, slices, utf8, windows, words
from cohortry.sources.workspace import materialise

SHINGLE = 5
PERCENT = 85
CHUNKS, SYMBOLS = 6, 4
MORE = 64
MOST_DIFFERENT = 33  # of the 24 + 64 symbols
FEW = 32
BLOCK = 512
_SEARCH = CHUNKS * SYMBOLS
_SCALE = constants(3, _SEARCH + MORE)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first and last document, the distinct shingle hashes by document, and where each document's start."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        where = offsets[i : j + 1]
        found = words(data[where[0] : where[-1]], where - where[0], lower=True)
        hashed, at = windows(found, size)
        doc = found.documents()
        owner = doc[at]
        few = np.flatnonzero((found.counts > 0) & (found.counts < size))
        if len(few):  # the whole text as one shingle
            scale = constants(11, size)
            whole = np.array([(found.hash[a:b] * scale[: b - a]).sum() + np.uint64(b - a) for a, b in zip(found.first[few], found.first[few + 1], strict=True)], np.uint64)
            hashed, owner = np.concatenate([hashed, mix(whole)]), np.concatenate([owner, few])
        order = np.lexsort((hashed, owner))
        hashed, owner = hashed[order], owner[order]
        if len(hashed):
            new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])])
            hashed, owner = hashed[new], owner[new]
        yield i, j, hashed, np.searchsorted(owner, np.arange(j - i + 1))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("__id")
        for i, j, hashed, first in shingle_sets(batch.column("__text")):
            n = np.diff(first)
            full = np.flatnonzero(n)
            out = np.zeros((j - i, 2), np.uint64)
            signature = np.zeros((j - i, 2 * _SEARCH + MORE), np.uint8)
            if len(full):
                at = first[:-1][full]
                out[full, 0] = np.add.reduceat(hashed, at)
                out[full, 1] = np.bitwise_xor.reduceat(mix(hashed + np.uint64(1)), at)
                for k, scale in enumerate(_SCALE):
                    least = mix(np.minimum.reduceat(hashed * scale, at))
                    if k < _SEARCH:
                        signature[full, 2 * k] = least & np.uint64(255)
                        signature[full, 2 * k + 1] = (least >> np.uint64(8)) & np.uint64(255)
                    else:
                        signature[full, _SEARCH + k] = least & np.uint64(255)
            yield pa.RecordBatch.from_arrays([
                ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(out[:, 0].view(np.int64)), pa.array(out[:, 1].view(np.int64)),
                pa.array([x.tobytes() for x in signature], pa.binary())], ["id", "n", "s1", "s2", "signature"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class under its 24 keys: per chunk the symbols without one."""
    for batch in batches:
        rep = batch.column("rep").to_numpy()
        raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(len(rep), -1)
        symbols = raw[:, : 2 * _SEARCH].copy().view("<u2").astype(np.uint64)
        for chunk in range(CHUNKS):
            for without in range(SYMBOLS):
                key = np.full(len(rep), chunk * SYMBOLS + without, np.uint64)
                for s in range(SYMBOLS):
                    if s != without:
                        key = mix(key * np.uint64(65537) + symbols[:, chunk * SYMBOLS + s] + np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep)], ["key", "rep"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures and sizes do not rule them out."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
        wide = (one[:, : 2 * _SEARCH].copy().view("<u2") != two[:, : 2 * _SEARCH].copy().view("<u2")).sum(1)
        keep = wide + (one[:, 2 * _SEARCH :] != two[:, 2 * _SEARCH :]).sum(1) <= MOST_DIFFERENT
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _sets(size: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashed, first in shingle_sets(batch.column("__text"), size):
                data = [hashed[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, j - i), pa.array(data, pa.binary())], ["id", "shingles"])

    return made


def _confirmed(percent: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return kept


def _linked_in_blocks(percent: int):
    def linked(table: pa.Table) -> pa.Table:
        """Links that join the members of two blocks of a key (or of one with itself)."""
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        holders = owner[np.argsort(which, kind="stable")]
        begin = np.cumsum(times) - times
        edge = np.concatenate([[0], np.cumsum(sizes)])
        label = np.arange(len(sets))
        links = []
        for x in range(len(sets)):
            if i != j and own[x] != i:
                continue
            mine = which[edge[x] : edge[x + 1]]
            n = times[mine]
            ends = np.cumsum(n)
            both = np.bincount(holders[np.repeat(begin[mine] - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets))
            near = (100 * both >= percent * (sizes[x] + sizes - both)) & (label != label[x])
            if i != j:
                near &= own == j
            found = np.flatnonzero(near)
            if len(found):
                joined, first = np.unique(label[found], return_index=True)
                links += [(rep[x], rep[y]) for y in found[first]]
                label[np.isin(label, joined)] = label[x]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return linked


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", *, percent: int = PERCENT, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Per document ``n_shingles``, ``component_id`` (the smallest id it is linked with, over any number of links) and ``kept``.

    Sets are the distinct runs of five words, A-Z in lower case; a shorter text is one shingle whole;
    a null or empty one has none, is linked with nothing and kept. Linked are sets whose
    intersection is at least ``percent`` hundredths of their union (80 or more). Rows that share an id
    are one document and kept or dropped together; a row without id is linked with nothing and kept.
    Further columns are ignored.
    """
    if percent < 80:
        raise ValueError("signatures are laid out for similarities of 0.8 and more")
    texts = docs.select(F.col(id).cast("long").alias("__id"), F.col(text).alias("__text"))
    signed = materialise(texts.mapInArrow(lean(_signed), "id long, n long, s1 long, s2 long, signature binary"), "signed")
    known = signed.filter("id IS NOT NULL AND n > 0")
    classes = materialise(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("signature").alias("signature")), "classes")

    entries = classes.select("rep", "signature").mapInArrow(lean(_keys), "key long, rep long")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    entries = materialise(entries.join(materialise(shared, "keys"), "key"), "entries")

    listed = entries.filter(F.col("members") <= few).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("r"))
    pairs = listed.select(F.explode(F.expr("flatten(transform(r, (a, i) -> transform(slice(r, i + 2, size(r)), b -> struct(a, b))))")).alias("p"))
    pairs = pairs.select(F.col("p.a").alias("a"), F.col("p.b").alias("b")).distinct()
    sides = [classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")) for c in ("a", "b")]
    signs = pairs.join(sides[0], "a").join(sides[1], "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = materialise(signs.select("a", "b", "sa", "sb").mapInArrow(lean(_alike), "a long, b long"), "pairs")

    many = entries.filter(F.col("members") > few).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    dealt = many.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    wanted = pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).union(many.select("rep")).distinct()
    sets = materialise(texts.join(wanted, "__id").mapInArrow(lean(_sets(SHINGLE)), "id long, shingles binary"), "sets")
    first = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b")
    whole = first.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
    links = whole.select("a", "b", "one", "two").mapInArrow(lean(_confirmed(percent)), "a long, b long")
    in_blocks = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").groupBy("key", "i", "j").applyInArrow(lean(_linked_in_blocks(percent)), "a long, b long")
    found = components(links.unionByName(in_blocks))

    joined = classes.drop("signature").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("class"))
    of_class = signed.drop("signature").join(materialise(joined, "joined"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return of_class.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
