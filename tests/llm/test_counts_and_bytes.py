"""Collocations, byte strings that repeat, and divergence of sources, against their definitions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortry.llm.collocations import Filter, collocations, joined
from cohortry.llm.divergence import Forest, audit, share
from cohortry.llm.suffix_dedup import Spec, _Chunk, drop_repeated_bytes, string_classes
from cohortry.llm.words import mix
from tests.llm.data import SCHEMA, corpus, documents


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """Documents from (id, text, lang, source), with columns named like results."""
    return spark.createDataFrame([(i, t, la, so, None, "k", 0.5, 1) for i, t, la, so in rows], SCHEMA).repartition(3)


# phrases


def phrases_by_definition(rows, least, subsumed, ranks, longest=4):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            words["und" if lang is None else lang] += len(w)
            for size in range(1, longest + 1):
                for k in range(len(w) - size + 1):
                    counts["und" if lang is None else lang][tuple(w[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if any(100 * b >= subsumed * a for b in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:ranks], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def prose(rng, n, vocabulary):
    return rng.choice([" ", "  ", "\t"]).join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize(("least", "ranks", "bits"), [(3, 2000, 1 << 20), (2, 7, 1 << 10)])
def test_collocations_by_definition(spark, least, ranks, bits):
    rng = random.Random(ranks)
    vocabulary = ["a", "b", "c", "New", "york", "É", "cat", "x y", "--", "\x00"]
    rows = []
    for k in range(60):
        text = rng.choice([". ", ", ", "\n", "!"]).join(prose(rng, rng.randint(0, 9), vocabulary) for _ in range(rng.randint(1, 5)))
        rows.append((k, text + rng.choice(["", " new york cat b", " New York cat"]), rng.choice(["en", "fr", None]), "s"))
    rows += [(None, None, "en", "s"), (1, "", None, None), (1, " \t", "de", "s"), (3, rows[3][1], rows[3][2], "s"), (99, "cat a " * 20_000, "en", "s")]
    found = collocations(table(spark, rows), least=least, ranks=ranks, filter_bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = phrases_by_definition([(r[1], r[2]) for r in rows], least, 80, ranks)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert len(expected) > 10


def test_collocations_of_nothing(spark):
    assert collocations(documents(spark, [])).count() == 0
    assert collocations(documents(spark, [(1, None), (2, "")]), least=1).count() == 0


def test_a_filter_denies_no_key_it_holds():
    keys = mix(np.arange(1, 500, dtype=np.uint64))
    bits = 1 << 10
    masks = Counter()
    for key in keys.tolist():
        for place in (key & (bits - 1), key >> 36 & (bits - 1)):
            masks[place >> 6] |= 1 << (place & 63)
    held = Filter(bits, np.array(list(masks)), np.array(list(masks.values()), np.uint64).view(np.int64))
    assert held.has(keys).all()
    assert not Filter(1 << 10, np.zeros(0, np.int64), np.zeros(0, np.int64)).has(keys).any()
    assert len(set(joined(keys, keys[::-1]).tolist())) == len(keys)


# bytes


def bytes_by_definition(texts, length):
    coded = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in coded for k in range(len(x) - length + 1))
    out = []
    for x in coded:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out.append((len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out


def made_texts(seed, n=40):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzé\x00 "])
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(4)]
    texts = []
    for _ in range(n):
        source = rng.choice(base)
        a = rng.randrange(len(source))
        ends = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2)]
        texts.append(rng.choice([ends[0] + source[a : a + rng.randint(0, 200)] + ends[1], source, source * 2, ends[0] * 3, rng.choice(alphabet) * rng.randint(1, 300), None, ""]))
    return texts


@pytest.mark.parametrize(("seed", "length"), [(1, 16), (2, 24), (3, 40)])
def test_repeated_bytes_by_definition(spark, seed, length):
    texts = made_texts(seed)
    rows = [(None if k % 9 == 4 else k // 2, t) for k, t in enumerate(texts)]
    found = drop_repeated_bytes(documents(spark, rows), length=length, chunks=3).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)
    expected = sorted((-1 if i is None else i, *e) for (i, _), e in zip(rows, bytes_by_definition(texts, length), strict=True))
    assert got == expected


def test_repeated_bytes_of_a_corpus_with_long_texts(spark):
    rows = corpus(n=60)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeated_bytes(documents(spark, rows), length=100, chunk_bytes=20_000).collect()}
    assert found == dict(zip([i for i, _ in rows], bytes_by_definition([t for _, t in rows], 100), strict=True))
    assert drop_repeated_bytes(documents(spark, [])).count() == 0
    alone = drop_repeated_bytes(documents(spark, [(1, "x" * 400), (1, "x" * 399), (2, None)])).collect()
    assert {(r.n_bytes, r.n_removed) for r in alone} == {(400, 0), (399, 0), (0, 0)}
    assert {r.n_removed for r in drop_repeated_bytes(documents(spark, [(1, "x" * 401)])).collect()} == {401}


def test_equal_strings_of_a_chunk_share_a_class():
    import pyarrow as pa

    texts = [t or "" for t in made_texts(5, 30)]
    spec = Spec(32)
    chunk = _Chunk(pa.table({"__text": pa.array(texts)}), spec)
    begins, classes, places, counts = string_classes(chunk, np.flatnonzero(chunk.triggered), spec)
    strings = [chunk.data[b : b + 32].tobytes() for b in begins]
    assert len(set(begins.tolist())) == len(begins) == counts.sum()
    by_class = defaultdict(set)
    for c, s in zip(classes.tolist(), strings, strict=True):
        by_class[c].add(s)
    assert all(len(s) == 1 for s in by_class.values()) and len(by_class) == len(places) == len(set(strings))


# sources


def divergence_by_definition(rows, ranks, least=3):
    docs, counts, groups = defaultdict(set), Counter(), set()
    for k, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)):
            docs[lang, term].add(k)
            counts[lang, source, term] += 1
    out = []
    for lang in {la for la, _ in groups}:
        kept = sorted(t for (la, t), d in docs.items() if la == lang and len(d) >= least)
        names = sorted(s for la, s in groups if la == lang)
        shares = {}
        for s in [*names, None]:
            n = [sum(counts[lang, x, t] for x in names) if s is None else counts[lang, s, t] for t in kept]
            shares[s] = [1 + 10**9 * (c + 1) // (sum(n) + len(kept)) for c in n]
        for s in names:
            pairs = [(-sum((p - q) ** 2 // q for p, q in zip(shares[s], shares[x], strict=True)), x.encode()) for x in names if x != s]
            out += [(lang, s, "pair", x.decode(), -v, k) for k, (v, x) in enumerate(sorted(pairs), 1)]
            terms = [(-((p - q) ** 2 // q), t.encode()) for t, p, q in zip(kept, shares[s], shares[None], strict=True) if counts[lang, s, t] and p > q]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "tile", "ranks"), [(4096, 32, 200), (8, 2, 5), (3, 1, 200)])
def test_divergence_by_definition(spark, block, tile, ranks):
    rng = random.Random(block)
    vocabulary = ["the", "The", "a", "é", "Éa", "naïve", "x1y", "中文", *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", "", None, "é"])) for k in range(80)]
    rows += [(None, None, "en", "empty"), (1, "", "en", "empty"), (1, "123 ...", "de", "only"), (2, "rare", "it", "p"), (2, "rare", "it", "q"), (9, "the w " * 30_000, "en", "a")]
    found = audit(table(spark, rows), block=block, tile=tile, term_ranks=ranks)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = divergence_by_definition([r[1:] for r in rows], ranks)
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert {r[2] for r in expected} == {"pair", "term"} and ("it", "p", "pair", "q", 0, 1) in expected


def test_divergence_of_nothing(spark):
    assert audit(documents(spark, [])).count() == 0


def test_equal_subtrees_are_one_node_and_priced_once():
    counts = np.zeros((2, 1024), np.int64)
    counts[0, 5], counts[1, 700] = 3, 9
    forest = Forest(counts)
    assert all(len(left) <= 4 for left, _ in forest.levels)
    pair, a, b, times = forest.leaf_pairs(np.array([0]), np.array([1]))
    assert sorted(zip(a.tolist(), b.tolist(), times.tolist(), strict=True)) == [(0, 0, 1022), (0, 9, 1), (3, 0, 1)] and set(pair.tolist()) == {0}
    odd = Forest(np.array([[1, 2, 3], [4, 5, 6]])).leaf_pairs(np.array([0]), np.array([1]))
    assert sorted(zip(odd[1].tolist(), odd[2].tolist(), strict=True)) == [(1, 4), (2, 5), (3, 6)]


def test_shares_beyond_64_bits():
    got = share(np.array([10**13, 0]), np.array([3 * 10**13] * 2), np.array([7, 7]))
    assert got.tolist() == [1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7), 1]
