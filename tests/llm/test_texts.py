"""Operators on texts against plain Python, with the odd cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cohortry.llm.components import components
from cohortry.llm.near_dedup import near_duplicates
from cohortry.llm.packing import fit, pack, sequences, tokenizer_path
from cohortry.llm.substring_dedup import drop_repeats
from cohortry.llm.words import slices, utf8, windows, words
from tests.llm.data import by_id, corpus, documents


def split(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


def test_words_and_windows_follow_their_text():
    import pyarrow as pa

    texts = ["a bb  ccc a", None, "", "\n\t ", "bb ccc a bb", "é bb ccc"]
    data, offsets = utf8(pa.array(texts))
    found = words(data, offsets)
    assert found.counts.tolist() == [len(split(t)) for t in texts]
    names = [w for t in texts for w in split(t)]
    for i, a in enumerate(names):
        assert [found.hash[i] == h for h in found.hash] == [a == b for b in names]
    hashed, at = windows(found, 3)
    runs = [tuple(split(t)[k : k + 3]) for t in texts for k in range(len(split(t)) - 2)]
    assert len(hashed) == len(runs) and len(set(hashed.tolist())) == len(set(runs))
    assert [i for i, j in slices(offsets, 5)] == sorted({i for i, j in slices(offsets, 5)})


@pytest.mark.parametrize("chunks", [1, 4])
def test_repeats_are_cut_as_by_brute_force(docs, rows, chunks):
    found = by_id(drop_repeats(docs, chunks=chunks, join_words=True), "n_words", "n_removed", "kept")
    lowest = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            lowest[key] = min(lowest.get(key, i), i)
    assert len(found) == len(rows)
    for i, text in rows:
        w = split(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if lowest[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        assert found[i] == (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    assert any(f[1] for f in found.values())


def test_cutting_keeps_layout_and_carried_columns(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"a {passage} b"), (2, f"x\n  y {passage}\n\n z\n"), (2, passage), (None, passage), (5, None)]
    found = drop_repeats(documents(spark, rows), carry=("source", "score"), chunks=2)
    got = sorted(((r.doc_id, r.source, r.n_removed, r.kept) for r in found.collect()), key=str)
    assert got == sorted([
        (1, "s1", 0, f"a {passage} b"), (2, "s2", 20, "x\n  y z\n"), (2, "s2", 20, ""), (None, "s0", 0, passage), (5, "s2", 0, "")], key=str)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert drop_repeats(none).count() == near_duplicates(none).count() == pack(none).count() == 0
    with pytest.raises(ValueError):
        drop_repeats(none, window=2)


def shingles(text):
    w = split(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def groups(sets):
    """Smallest id reachable over links, by comparing all pairs."""
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("few, block", [(32, 512), (1, 4)])
def test_near_duplicates_as_by_brute_force(docs, rows, few, block):
    found = by_id(near_duplicates(docs, few=few, block=block), "n_shingles", "component_id", "kept")
    sets = {i: shingles(t) for i, t in rows}
    want = groups(sets)
    assert found == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want) - 10


def test_near_duplicates_without_id_or_words(spark):
    found = near_duplicates(documents(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (5, " "), (6, None), (7, "one"), (8, "ONE")]))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (9, 2, 4, False), (9, 2, 4, False), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False)], key=str)


def test_a_large_group_of_near_copies_is_one_component(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: k % 110] + [f"own{k}"] + base[k % 110 + 1 :])) for k in range(150)]
    found = by_id(near_duplicates(documents(spark, rows), few=8, block=16), "component_id")
    want = groups({i: shingles(t) for i, t in rows})
    assert {i: c for i, (c,) in found.items()} == want


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 103), (103, 101), (7, 7), (200, 199), (200, 199)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(2, 41)}, 101: 100, 103: 100, 200: 199}


def test_packing_places_every_id_once(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    packed = pack(docs, with_ids=True, tasks=2).cache()
    got = defaultdict(list)
    for r in packed.collect():
        got[r.doc_id].append(r)
    total = 0
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        parts = sorted(got[i], key=lambda r: r.piece)
        assert b"".join(r.ids for r in parts) == ids.tobytes()
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, 4096 * k, min(4096, len(ids) - 4096 * k)) for k in range(-(-len(ids) // 4096))]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in parts)
        total += len(ids)
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    by_sequence = defaultdict(list)
    for r in packed.collect():
        by_sequence[r.sequence_id].append(r)
    for number, parts in by_sequence.items():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert whole[number].length == sum(r.length for r in parts) <= 4096
        assert bytes(whole[number].ids) == b"".join(r.ids for r in parts)
    assert len(whole) <= -(-total // 4096) + 2
    packed.unpersist()


def test_special_strings_and_odd_words_are_ordinary_text(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    texts = ["<|endoftext|> it's A b 漢字 ẞtraße é I'LL ''s", "x" * 20_000, "İstanbul 12,345 !!!a?b", None]
    got = by_id(pack(documents(spark, list(enumerate(texts))), with_ids=True), "ids")
    for i, text in enumerate(texts[:1] + texts[2:]):
        k = texts.index(text)
        assert bytes(got[k][0]) == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_the_fullest_bin_closes_first():
    number, offset = fit(np.array([6, 5, 8, 2, 5, 4]), 10, 2)
    # 8 finds two open bins; the one with 4 left is fuller than that with 5 and closes
    assert number.tolist() == [0, 1, 2, 2, 1, 3]
    assert offset.tolist() == [0, 0, 0, 8, 5, 0]


def test_kept_words_have_the_digest_of_the_contract(spark, docs, rows):
    from pyspark.sql import functions as F

    found = by_id(drop_repeats(docs, join_words=True).withColumn("d", F.sha2("kept", 256)), "kept", "d")
    assert all(d == hashlib.sha256(kept.encode()).hexdigest() for kept, d in found.values())
