"""Mixing, sharding, archives, fingerprints and the pipeline."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import warc
from cohortry.llm.fingerprints import _alike, against_next, edit_distances, fingerprint, likeness, parse
from cohortry.llm.mixing import MAX_SOURCES, mix
from cohortry.llm.queries import ORACLES, QUERIES
from cohortry.llm.sharding import permuted, row_at, shard
from tests.llm.data import by_id, corpus, documents

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def sources(spark, counts):
    rows = [(k, s, 7, 0.5) for k, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id long, source string, slot int, block double").repartition(4)


def earliest_deadline_first(units):
    """Slots of one period by the definition."""
    q, done, out = sum(units), [0] * len(units), []
    for t in range(q):
        due = [(-(-(d + 1) * q // u), s) for s, (u, d) in enumerate(zip(units, done, strict=True)) if d < u and d * q // u <= t]
        s = min(due)[1]
        done[s] += 1
        out.append(s)
    return out


def test_mixing_follows_the_weights_while_all_sources_last(spark):
    counts, weights = {"a": 300, "b": 200, "c": 100, "d": 61}, {"a": 5.0, "b": 3.0, "c": 1.5}
    found = mix(sources(spark, counts), weights, block_rows=5, resolution=22).collect()
    assert len({r.doc_id for r in found}) == len(found) == sum(counts.values())
    slots = {}
    for r in found:
        assert r.release <= r.slot < r.deadline and slots.setdefault(r.slot, r.source) == r.source
    assert sorted(slots) == list(range(len(slots)))
    # units of 22 by weight, d taking the smallest: 10, 6, 3, 3
    units = dict(zip("abcd", (10, 6, 3, 3), strict=True))
    pattern = earliest_deadline_first(list(units.values()))
    assert [slots[t] for t in range(22)] == ["abcd"[s] for s in pattern]
    taken = Counter()
    for t in range(22 * 4):
        taken[slots[t]] += 1
        assert all(abs(taken[s] - (t + 1) * units[s] / 22) < 1 for s in units)


def test_every_row_is_mixed_once_when_sources_run_short(spark):
    counts = {"a": 903, None: 7, "": 40, "c": 1}
    found = mix(sources(spark, counts), {"a": 1, "": 8, "c": 1}, block_rows=4, resolution=50).collect()
    assert Counter(r.source for r in found) == Counter(counts)
    by_slot = defaultdict(list)
    for r in found:
        by_slot[r.slot].append(r)
        assert r.release <= r.slot < r.deadline
    assert sorted(by_slot) == list(range(sum(-(-n // 4) for n in counts.values())))
    assert all(len({(r.source, r.block) for r in rows}) == 1 and sorted(r.row_in_block for r in rows) == list(range(len(rows))) for rows in by_slot.values())
    assert mix(sources(spark, {})).count() == 0


def test_mixing_is_repeatable_native_and_bounded_in_sources(spark):
    given = sources(spark, {"a": 50, "b": 20})
    first, second = ({r.doc_id: (r.slot, r.row_in_block) for r in mix(d, block_rows=3).collect()} for d in (given, given.repartition(7)))
    assert first == second
    assert "Python" not in mix(given)._jdf.queryExecution().executedPlan().toString()
    many = spark.range(MAX_SOURCES + 1).selectExpr("id AS doc_id", "cast(id AS string) AS source")
    with pytest.raises(Exception, match="more than"):
        mix(many).collect()


@pytest.mark.parametrize("rows", [1, 2, 5, 64, 1000])
def test_the_permutation_can_be_undone(rows):
    to = permuted(np.arange(rows), rows, seed=3)
    assert sorted(to) == list(range(rows))
    assert (permuted(to, rows, seed=3, back=True) == np.arange(rows)).all()


def test_shards_of_odd_rows(spark):
    given = [(5, "b"), (5, "a"), (5, "a"), (None, "x"), (1, None), (9, "é")]
    found = shard(documents(spark, given), 4, seed=1).collect()
    assert sorted(r.row_number for r in found) == list(range(6))
    assert Counter(r["shard"] for r in found) == {0: 2, 1: 2, 2: 1, 3: 1}
    assert all(row_at(np.array([r["shard"]]), np.array([r.slot]), 4, 6, seed=1)[0] == r.row_number for r in found)
    assert next(r for r in found if r.doc_id is None).row_number == 5
    assert {(r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id in (1, 9)} == {(1, 8, 0), (9, 10, zlib.crc32("é".encode()))}
    assert shard(documents(spark, []), 3).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, record_type string").repartition(3)


def test_archives_return_what_was_written(spark):
    long, longer = "é<p>" * 400, "x" * 300_000
    rows = [(1, "http://a", long), (2, None, long), (3, "http://c d", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", longer), (8, "u", longer), (9, "u", "y" * 1000)]
    found = warc.payload_bytes(warc.read(warc.write(pages(spark, rows), archive_bytes=500))).collect()
    assert len(found) == len(rows)
    latest = {long: 3, longer: 8}
    for i, _, html in rows:
        body = (html or "").encode()
        for r in (r for r in found if r.page_id == i and r.payload_digest == hashlib.sha1(body).hexdigest()):
            again = latest.get(html)
            revisits = again is not None and again != i
            assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", again, len(body)) if revisits else ("response", None, len(body)))
            assert r.payload is None if revisits else bytes(r.payload) == body
    assert {r.url for r in found if r.page_id in (2, 3)} == {None, "http://c d"}
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_damaged_archives_are_told():
    good = warc.record(1, "u", b"payload " * 50, None, 0) + warc.record(2, "u", b"", None, 1)
    assert [r.payload for r in warc.records(good, step=7)] == [b"payload " * 50, b""]
    assert len(list(warc.records(b""))) == 0
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\nWARC-Block-Digest: sha1:%s\r\nWARC-Payload-Digest: sha1:x\r\n\r\nabc\r\n\r\n"
    packer = lambda n, digest: zlib.compress(plain % (n, digest), wbits=31)
    right = hashlib.sha1(b"abc").hexdigest().encode()
    for bad in (good[:-9], packer(2, right), packer(9, right), packer(3, b"0"), packer(3, right), zlib.compress(b"HTTP\r\n\r\n", wbits=31), zlib.compress(b"no end", wbits=31)):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances_as_by_the_table():
    rng = random.Random(2)
    given = [[bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 4, 31, 63, 64]))) for _ in range(2)] for _ in range(200)]
    a, b = (np.array([np.frombuffer(g[k].ljust(64, b"\0"), np.uint8) for g in given]) for k in (0, 1))
    assert edit_distances(a, b).tolist() == [distance(x, y) for x, y in given]
    assert ((_alike(a, b) >= 0) & (_alike(a, b) <= 1)).all() and (_alike(a, a) == 1).all()


def test_fingerprints_of_edited_texts(spark):
    rows = corpus(seed=8, n=80)
    found = by_id(against_next(documents(spark, rows), range_bytes=50_000), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(rows)
    prints = defaultdict(set)
    for k, (i, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + other[:quarter]
        assert found[i][:2] == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(found[i][2])
        prints[edited].add(found[i][3])
        after = order[(k + 1) % len(order)][0]
        own, changed, following = (parse([f]) for f in (found[i][2], found[i][3], found[after][2]))
        assert found[i][4] == likeness(own, changed)[0] and found[i][5] == likeness(own, following)[0]
    assert all(len(p) == 1 for p in prints.values())
    long = [found[i] for i, t in rows if t and len(t) > 400]
    assert np.mean([f[4] for f in long]) > 0.6
    assert {r.fingerprint for r in fingerprint(documents(spark, rows)).collect()} == {f[2] for f in found.values()}


def test_fingerprints_of_few_and_odd_rows(spark):
    one = against_next(documents(spark, [(4, "alone in here")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"alone in halo").hexdigest() and one[0].near_next == 1
    odd = against_next(documents(spark, [(None, "x" * 5000), (1, None), (1, ""), (2, "ab"), (2, "ab")])).collect()
    assert sorted((r.n_chars, r.doc_id is None) for r in odd) == [(0, False), (0, False), (2, False), (2, False), (5000, True)]
    assert against_next(documents(spark, [])).count() == 0


def test_the_pipeline_keeps_its_promises(spark, folder):
    import corpus_pipeline
    from cohortry.llm.near_dedup import near_duplicates
    from cohortry.llm.packing import pieces
    from cohortry.llm.substring_dedup import drop_repeats
    from cohortry.llm.toxicity import score
    from cohortry.sources.workspace import materialise

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(materialise(stage(spark, stages[-1], folder), name))
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    clean = {r.doc_id for r in score(docs, corpus_pipeline.toxicity_model(spark, folder)).filter("score < 0.3").collect()}
    assert ids[1] == clean < ids[0]
    assert ids[2] == {r.doc_id for r in near_duplicates(stages[1]).filter("kept").collect()} < ids[1]
    assert ids[2] == ids[3] == ids[4] == ids[5]
    assert all(s.columns == docs.columns for s in stages[1:5])
    cut = by_id(drop_repeats(stages[2]), "kept")
    for r in stages[4].collect():
        assert r.text == cut[r.doc_id][0] and r.n_chars == len(r.text)
    assert stages[5].agg(F.sum("length")).first()[0] == pieces(stages[4]).agg(F.sum("length")).first()[0]
    assert corpus_pipeline.run(spark, folder).count() == stages[5].count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted((tuple(r) for r in got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_stretches_of_sequences_keep_the_weights(spark, monkeypatch):
    import corpus_pipeline
    from cohortry.sources.workspace import materialise

    rows = [(k, f"word {k} " * 20, "xx", "a" if k < 896 else "b" if k < 1216 else "c", 9) for k in range(1344)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    monkeypatch.setattr(corpus_pipeline, "STRETCH_ROWS", 256)
    mixed = materialise(corpus_pipeline.mixed_sources(spark, docs, "").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id"), "unmixed")
    plain = corpus_pipeline.packed(spark, mixed, "")
    found = corpus_pipeline.packed(spark, materialise(corpus_pipeline.mixed_sources(spark, docs, ""), "mixed"), "")
    assert found.count() == plain.count() == len(rows)
    stretches = defaultdict(Counter)
    for r in found.collect():
        stretches[r.sequence_id >> 32][rows[r.doc_id][3]] += 1
    assert [sum(stretches[k].values()) for k in sorted(stretches)] == [256] * 5 + [64]
    weights = {s: n**0.5 for s, n in (("a", 896), ("b", 320), ("c", 128))}
    for k in (0, 1):  # all sources last so long; a stretch of four blocks is less than two blocks from the weights
        assert all(abs(stretches[k][s] - 256 * w / sum(weights.values())) < 128 for s, w in weights.items())
    taken = stretches[0] + stretches[1]
    assert all(abs(taken[s] - 512 * w / sum(weights.values())) < 64 for s, w in weights.items())
    assert {rows[r.doc_id][3] for r in plain.filter("sequence_id >> 32 = 0").collect()} == {"a"}


def test_rows_are_numbered_as_they_were_written(spark):
    from cohortry.llm.written import numbered_as_written
    from cohortry.sources.workspace import materialise

    written = materialise(spark.range(500).repartitionByRange(9, F.desc("id")).sortWithinPartitions("id"), "numbered")
    got = {r.n: r.id for r in numbered_as_written(written, "n").collect()}
    parts = sorted(written.select("id", "_metadata.file_name", "_metadata.row_index").collect(), key=lambda r: (r.file_name, r.row_index))
    assert got == {k: r.id for k, r in enumerate(parts)}
    assert numbered_as_written(materialise(spark.range(0), "none"), "n").count() == 0


def test_the_stages_of_the_pipeline_take_odd_rows(spark, folder):
    import corpus_pipeline
    from cohortry.sources.workspace import materialise

    long = " ".join(f"w{k % 997}" for k in range(60_000))
    rows = [(1, None, None, None, None, 7), (1, "", "en", "a", 0, 7), (None, "same words here again and again", "en", "a", 5, 7), (None, "same words here again and again", "en", None, 5, 7),
            (2, long, "xx", "b", 9, 7), (3, long, "xx", "b", 9, 7), (4, "\x00 odd \t", "", "", -1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int").repartition(3)
    for given, least in ((docs, 1), (docs.limit(0), 0)):
        stage = given
        for name, step in corpus_pipeline.STAGES:
            stage = materialise(step(spark, stage, folder), name)
            if name != "packed":
                assert stage.columns == corpus_pipeline.COLUMNS
        assert (stage.count() > 0) == bool(least)
    assert {r.doc_id for r in materialise(corpus_pipeline.toxicity(spark, docs, folder), "clean").collect()} == {None, 1, 2, 3, 4}
