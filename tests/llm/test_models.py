"""Operators that learn: held-out accuracy, exactness of the search, and the odd cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import langid, toxicity
from cohortry.llm.neighbours import cut_graph, search, train
from cohortry.llm.queries import QUERIES
from tests.llm.data import by_id, documents


def sentences(seed, n=400):
    """Texts of two made-up languages; those with several of three words are toxic."""
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "ra", "to"], "bb": ["sch", "ein", "ung", "ver", "ß"]}
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "nasty"]))
        rows.append((k, " ".join(words), lang))
        labels.append((k, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def given(spark):
    rows, labels = sentences(1)
    docs = documents(spark, [r[:2] for r in rows]).drop("lang").join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, lang string"), "doc_id")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels), {r[0]: r[2] for r in rows}


@pytest.fixture(scope="module")
def model(given):
    docs, labels, _, _ = given
    return toxicity.fit(docs, labels.filter("doc_id % 4 <> 2"))


def test_toxicity_on_held_out_texts(given, model):
    docs, _, toxic, _ = given
    found = by_id(toxicity.score(docs, model), "score", "evidence")
    held = [k for k in toxic if k % 4 == 2]
    assert sum((found[k][0] >= 0.3) == bool(toxic[k]) for k in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s, _ in found.values())
    shown = next(e for k, (s, e) in found.items() if toxic[k])
    assert shown[0]["label"] == 1 and 0 < shown[0]["cosine"] <= 1 + 1e-9
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert kept == {k for k, (s, _) in found.items() if s < 0.3}


def by_definition(rows, labels, examples):
    """TF-IDF vectors of the examples and a function from a text to its cosines, from the texts alone."""
    counts = {k: Counter(re.findall("[a-zß]+", (t or "").lower())) for k, t in enumerate(t for _, t in rows)}
    df = Counter(w for c in counts.values() for w in c)
    known = {w for k in examples for w in counts[k]}
    toxic = [k for k in examples if labels[k] and counts[k]]
    clean = [k for k in examples if not labels[k] and counts[k]]

    def gain(word):
        odds = (sum(word in counts[k] for k in toxic) / max(1, len(toxic))) / ((sum(word in counts[k] for k in clean) + 3) / max(1, len(clean)))
        return math.log((1 + len(rows)) / (1 + df[word])) * math.log2(2 + odds) ** 2

    gains = {w: gain(w) for w in known}

    def vector(count):
        v = {w: (1 + math.log(n)) * gains[w] for w, n in count.items() if w in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vectors = {k: vector(counts[k]) for k in examples if counts[k]}

    def cosines(k):
        own = vector(counts[k])
        return {e: sum(x * v.get(w, 0.0) for w, x in own.items()) for e, v in vectors.items()}

    return vectors, cosines


def test_cosines_of_all_words_by_definition(spark, monkeypatch):
    # more examples than the blocks that are read first, some words frequent and most rare
    rng = random.Random(8)
    made, labels = sentences(8, 1000)
    rows = [(k, t + " " + " ".join(rng.choice(["der", "die", "das", "und"]) for _ in range(3))) for k, t, _ in made]
    rows[5], rows[6], rows[9] = (5, None), (6, "... 123"), (9, "unheard xyzzy")
    examples = [k for k in range(1000) if k % 10 != 3]
    toxic = dict(labels)
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(k, toxic[k]) for k in examples], "doc_id long, toxic int"))
    vectors, cosines = by_definition(rows, toxic, examples)
    model.open()
    assert len(model.terms) == len({w for v in vectors.values() for w in v}) and sorted(model.ids.tolist()) == sorted(vectors)
    assert 0 < model.table.shape[1] < len(model.terms) and len(model.highest) > 8
    found = by_id(toxicity.score(docs, model), "evidence", "score")
    for k in range(0, 1000, 7):
        want = sorted(((-round(c, 9), e) for e, c in cosines(k).items() if c > 1e-9))[:3]
        got = [(e["id"], e["cosine"]) for e in found[k][0]]
        assert len(got) == len(want)
        for (_, score), (c, _) in zip(got, want, strict=True):
            assert abs(score + c) < 1e-6
        assert all(abs(cosines(k)[e] - score) < 1e-6 for e, score in got)
    assert found[5] == found[6] == ([], model.prior)
    held = [k for k in range(1000) if k % 10 == 3]
    assert sum((found[k][1] >= 0.3) == bool(toxic[k]) for k in held) >= 0.95 * len(held)


def test_blocks_are_passed_over_and_the_search_stays_exact():
    rng = np.random.default_rng(2)
    n, words_ = 1500, 400
    sizes = rng.integers(1, 30, n)
    share = 1 / np.arange(1, words_ + 1) ** 0.8
    terms = [np.sort(rng.choice(words_, s, replace=False, p=share / share.sum())).astype(np.uint64) for s in sizes]
    counts = rng.integers(1, 5, sizes.sum())
    known = np.unique(np.concatenate(terms))
    labels = (rng.random(n) < 0.2).astype(float)
    model = toxicity.index(np.arange(n) * 3, labels, sizes, np.concatenate(terms), counts, known, rng.random(len(known)) * 5 + 0.1)
    model.open()
    dense = np.zeros((n, len(known)))
    for r in range(n):
        dense[r, model.column >= 0] = model.table[r, model.column[model.column >= 0]]
    for t in range(len(known)):
        s = slice(model.first[t], model.first[t + 1])
        dense[model.rows[s], t] = model.weights[s]
    assert np.allclose((dense**2).sum(axis=1), 1)
    texts = [model.vector(t[: max(1, len(t) // 2)], np.ones(max(1, len(t) // 2), np.int64)) for t in terms[:60]]
    for k, without in ((5, None), (15, [int(i) * 3 for i in range(60)]), (5000, None)):
        for i, (rows, scores) in enumerate(model.nearest(texts, k, without)):
            cosine = np.round(dense[:, texts[i][0]] @ texts[i][1], 12)
            if without:
                cosine[model.ids == without[i]] = 0
            want = [r for r in np.lexsort((model.ids, -cosine))[:k] if cosine[r] > 0]
            assert np.allclose(scores, cosine[want]) and np.allclose(cosine[rows], cosine[want])


def test_toxicity_without_labels_texts_or_ids(spark, given, model):
    docs, labels, _, _ = given
    blank = toxicity.fit(docs, labels.limit(0))
    odd = documents(spark, [(1, None), (1, ""), (None, "vile rotten nasty vile"), (2, "...")])
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.0}
    scores = sorted((r.doc_id is None, r.score) for r in toxicity.score(odd, model).collect())
    assert [s for none, s in scores if not none] == [model.prior] * 3 == [0.0] * 3 and scores[-1][1] >= 0.3
    assert toxicity.without_toxic(documents(spark, []), model).count() == 0
    kept = toxicity.without_toxic(documents(spark, [(None, None), (1, ""), (1, "vile " * 100_000), (None, "ka lo " * 100_000)]), model)
    assert sorted((r.doc_id is None, len(r.text or "")) for r in kept.collect()) == [(False, 0), (True, 0), (True, 600_000)] and "kept" in kept.columns
    assert toxicity.score(documents(spark, []), model).count() == 0
    twice = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.sample(twice).collect()] == [(1, 1.0)]
    wordless = toxicity.fit(documents(spark, [(1, None), (2, "!"), (3, "ka lo")]), spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert wordless.prior == 1 / 3 and wordless.ids.tolist() == [3]
    few = toxicity.fit(docs, labels, text_bytes=2_000)
    assert 0 < len(few.ids) < len(toxicity.fit(docs, labels, rows=100).ids) <= 100


def test_toxic_terms_are_found_when_half_of_the_labels_are_toxic(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        words = ["".join(rng.choice(["ka", "lo", "mi", "ra", "to"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
        rows.append((k, " ".join([*words, *(rng.choice(["vile", "rotten", "nasty"]) for _ in range(3 * (k % 2)))])))
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(400) if k % 4 < 2], "doc_id long, toxic int"))
    assert len(model.terms) and len(model.ids)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, model).collect()}
    assert sum((k in kept) == (k % 2 == 0) for k in range(400)) >= 0.97 * 400


def test_language_sample_counts_copies_once(spark):
    rows = [(k, f"mikalo rato {k % 3}", "aa") for k in range(300)] + [(k, f"verschein ungein {k}", "bb") for k in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    # a bound far below the rows: three texts of 100 copies each, and 40 texts
    model, once = (langid.fit(d, rows=3) for d in (docs, docs.dropDuplicates(["text"])))
    assert model.languages == once.languages == ["aa", "bb"]
    assert np.array_equal(model.cost, once.cost)
    assert all(len(langid.fit(docs, rows=k).languages) == 2 for k in (1, 2))


def test_language_on_held_out_texts(given):
    docs, _, _, lang = given
    learned = langid.fit(docs.filter("doc_id % 5 <> 0"))
    found = by_id(langid.predict(docs, learned), "lang_pred", "score")
    held = [k for k in lang if k % 5 == 0]
    assert sum(found[k][0] == lang[k] for k in held) >= 0.99 * len(held)


def code_length(text, tree):
    """Bits of a text, byte by byte, from counts of contexts: the definition, without tables."""
    bits, history = 0.0, b"\0\0\0"
    for byte in text:
        left, k = set(range(256)), 3
        done = False
        while k >= 0 and not done:
            counts = tree[k].get(history[3 - k :])
            if counts:
                open_ = {s: n for s, n in counts.items() if s in left}
                total = sum(open_.values()) + len(open_)
                if byte in open_:
                    bits -= math.log2(open_[byte] / total)
                    done = True
                elif open_:
                    bits -= math.log2(len(open_) / total)
                left -= counts.keys()
            k -= 1
        if not done:
            bits += math.log2(len(left))
        history = (history + bytes([byte]))[-3:]
    return bits


def test_code_lengths_follow_the_definition(spark):
    texts = ["banana bandana", "ananas banal", "cabana " * 6]
    docs = documents(spark, list(enumerate(texts)))
    model = langid.fit(docs)
    tree = [{} for _ in range(4)]
    for text in texts:
        history = b"\0\0\0"
        for byte in text.encode():
            for k in range(4):
                counts = tree[k].setdefault(history[3 - k :], {})
                counts[byte] = counts.get(byte, 0) + 1
            history = (history + bytes([byte]))[-3:]
    tree[3] = {c: n for c, n in tree[3].items() if sum(n.values()) >= langid.LEAST}
    for text in (b"banana", b"xyz banana", "é".encode(), b"cab", b"\0\0"):
        got = model.code_lengths(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0, 0]
        assert got == pytest.approx(code_length(text, tree), abs=0.01 * len(text) + 0.01)


def test_language_of_odd_texts(spark, given):
    docs, _, _, _ = given
    learned = langid.fit(docs)
    odd = documents(spark, [(1, None), (2, ""), (3, " 12 %%% —"), (None, "kalomi rato"), (5, "漢字"), (6, "ka" * 50_000)])
    found = {(r.doc_id, r.lang_pred, r.score > 0) for r in langid.predict(odd, learned).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (None, "aa", True), (6, "aa", True)} < found
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(odd.filter("false"))).collect()} == {"und"}
    assert langid.predict(documents(spark, []), learned).count() == 0


def vectors(spark, x, extra=()):
    return spark.createDataFrame([(k, [float(v) for v in row], 9, 1.0) for k, row in enumerate(x)] + list(extra), "vec_id long, embedding array<float>, rank int, score double").repartition(3)


def test_neighbours_found_ties_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # many equal vectors
    found = search(vectors(spark, x), F.col("vec_id") % 50 == 0, k=10, parts=12, block_rows=500).collect()
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    for q in range(0, 3000, 50):
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11)) and q not in {r.vec_id for r in got}
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(r.score == pytest.approx(exact[q, r.vec_id], rel=1e-12) for r in got)
        scores = exact[q].copy()
        scores[q] = -np.inf
        best = np.sort(scores)[-10]
        hits += sum(exact[q, r.vec_id] >= best - 1e-9 for r in got)
    assert hits >= 0.9 * 600


def test_vectors_that_take_no_part(spark):
    odd = [(100, None, 0, 0.0), (200, [0.0, 0.0], 0, 0.0), (300, [None, 1.0], 0, 0.0), (400, [float("nan"), 1.0], 0, 0.0), (500, [float("inf"), 1.0], 0, 0.0), (None, [1.0, 1.0], 0, 0.0), (600, [1.0, 2.0, 3.0], 0, 0.0)]
    found = search(vectors(spark, [[1, 0], [1, 0], [0, 2]], odd), F.col("vec_id") % 100 == 0, k=5)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert search(vectors(spark, []), F.lit(True)).count() == 0
    assert search(vectors(spark, [[1, 2]]), F.lit(True)).count() == 0


def test_parts_are_balanced_and_learned():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(8, 10)), 200, 0) + 0.2 * rng.normal(size=(1600, 10))
    graph = np.argsort(-(x @ x.T), axis=1)[:, 1:11]
    sizes = np.bincount(cut_graph(x, graph, 8), minlength=8)
    assert sizes.max() <= math.ceil(1.1 * 200)
    assert 1 <= train(x, 8).probes <= 8


def test_registered_queries_find_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = QUERIES["op5_language_id"](spark, folder).filter("held_out").join(docs, "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count()
    scored = QUERIES["op6_toxicity"](spark, folder)
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1").count() == 0
    near = QUERIES["op3_nearest_neighbours"](spark, folder).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    hits = total = 0
    for q in (i for i in rows if i % 20 == 0):
        best = sorted((i for i in rows if i != q), key=lambda i: (-(rows[q] @ rows[i]), i))[:20]
        hits += len(set(best) & {r.vec_id for r in near if r.query_id == q})
        total += len(best)
    assert hits >= 0.9 * total
