"""The operators applied to the given tables, and the SQL each must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import langid, toxicity, warc
from cohortry.llm.collocations import collocations
from cohortry.llm.divergence import audit
from cohortry.llm.fingerprints import against_next
from cohortry.llm.mixing import mix
from cohortry.llm.near_dedup import near_duplicates
from cohortry.llm.neighbours import search
from cohortry.llm.packing import pack
from cohortry.llm.sharding import ROUNDS, round_keys, shard
from cohortry.llm.substring_dedup import drop_repeats
from cohortry.llm.suffix_dedup import drop_repeated_bytes
from cohortry.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Register a query under its own name, with the SQL for its rows."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


@query(r"""
    WITH listed AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    starts AS (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS s FROM listed),
    keyed AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS k FROM starts),
    firsts AS (SELECT k, min(doc_id) AS lowest FROM keyed GROUP BY k),
    cut AS (
        SELECT DISTINCT doc_id, s + unnest(range(0, 13)) AS pos FROM keyed JOIN firsts USING (k) WHERE lowest < doc_id),
    numbered AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM listed),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM numbered ANTI JOIN cut USING (doc_id, pos)
        GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM listed LEFT JOIN kept USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeats(load(spark, folder, "documents"), join_words=True).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def toxicity_model(spark: SparkSession, folder: str) -> toxicity.Examples:
    """Learned from the labelled documents outside the held-out fourth."""
    labels = load(spark, folder, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.fit(load(spark, folder, "documents"), labels)


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(load(spark, folder, "documents"), toxicity_model(spark, folder))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence",
    )


@query()
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix(load(spark, folder, "documents").select("doc_id", "source"))


@query()
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(load(spark, folder, "documents"))


@query(r"""
    WITH RECURSIVE listed AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM listed WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    links AS (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
        JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
    lowest AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
        doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
    FROM listed LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a = doc_id""")
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(load(spark, folder, "documents"))


@query("""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
    latest AS (SELECT d, max(page_id) AS latest FROM p WHERE strlen(body) >= 1000 GROUP BY d)
    SELECT page_id, strlen(body) AS payload_bytes, d AS payload_digest,
        CASE WHEN latest IS NULL OR latest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN latest <> page_id THEN latest END AS refers_to
    FROM p LEFT JOIN latest USING (d)""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.read(warc.write(load(spark, folder, "pages")))
    return warc.payload_bytes(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _feistel_sql(source: str) -> str:
    """SQL for one pass of the network over ``x`` of ``source``, which also has ``bits``."""
    sql = f"SELECT *, x >> bits AS l0, x & ((1::BIGINT << bits) - 1) AS r0 FROM {source}"
    for k, key in enumerate(round_keys(0)):
        product = f"((r{k} + {key}) * 1640531527)"
        stirred = f"((xor({product}, {product} >> 17) >> 5) & ((1::BIGINT << bits) - 1))"
        sql = f"SELECT *, r{k} AS l{k + 1}, xor(l{k}, {stirred}) AS r{k + 1} FROM ({sql})"
    return f"SELECT n, rows, bits, (l{ROUNDS} << bits) | r{ROUNDS} AS x FROM ({sql})"


_CRC32 = """
    WITH RECURSIVE steps(b, k, c) AS (
        SELECT b, 0, b::BIGINT FROM range(256) t(b)
        UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
    tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
    coded AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
    sums AS (
        SELECT doc_id, octet_length(raw) + 8 AS size,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)),
                lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32
        FROM coded, tab),"""


@query(f"""{_CRC32}
    numbered AS (
        SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS n, count(*) OVER () AS rows FROM sums),
    sized AS (
        SELECT n, rows, n AS x, greatest(1, ceil(length(ltrim(bin(greatest(rows - 1, 1)), '0')) / 2))::INTEGER AS bits FROM numbered),
    walk AS ({_feistel_sql("sized")} UNION ALL {_feistel_sql("walk WHERE x >= rows")})
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 24)::INTEGER AS shard, x // 24 AS slot, NULL::INTEGER AS grown_shard, n AS row_number
    FROM numbered JOIN walk USING (n) WHERE x < walk.rows""")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = shard(load(spark, folder, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


@query()
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return against_next(load(spark, folder, "documents"))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query()
def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(load(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(rf"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    counts AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    every AS (
        SELECT lang, source, term, coalesce(c.n, 0) AS n, k.n AS in_lang
        FROM groups JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
    totals AS (SELECT lang, source, sum(n) AS total FROM every GROUP BY ALL),
    shares AS (
        SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (t.total + v)::HUGEINT AS p,
            1 + (1000000000::HUGEINT * (in_lang + 1)) // (l.total + v)::HUGEINT AS q
        FROM every JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
    apart AS (
        SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (
        SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 200""")
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit(load(spark, folder, "documents"))


@query(rf"""
    WITH cut AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM cut),
    sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM pieces, range(1, 5) v(size) WHERE len(w) >= size),
    f AS (SELECT lang, size, array_to_string(w[s:s + size - 1], ' ') AS phrase, count(*) AS n FROM starts GROUP BY ALL),
    candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE size > 1 AND n >= 30),
    cuts AS (
        SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:size], ' ') AS two
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
    scored AS (
        SELECT c.lang, c.phrase, c.size, c.a, k, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n + y.n)::HUGEINT)::BIGINT AS score
        FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = one JOIN f y ON y.lang = c.lang AND y.phrase = two),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
    within AS (
        SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
        FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates)) GROUP BY ALL),
    kept AS (
        SELECT q.lang, q.phrase, a, l, r, score FROM lowest q LEFT JOIN within USING (lang, phrase)
        WHERE place = 1 AND (longer IS NULL OR 100 * longer < 80 * a))
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang)
    WHERE rank <= 2000""")
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(load(spark, folder, "documents"))


@query("""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    s AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
    found AS (SELECT r, i FROM s JOIN (SELECT k FROM s GROUP BY k HAVING count(*) > 1) USING (k)),
    steps AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM found),
    numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM steps),
    spans AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY ALL),
    placed AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
    cut AS (
        SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
            sum(b - a) AS n_removed, count(*) AS n_spans
        FROM placed JOIN d USING (r) GROUP BY r)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN cut USING (r)""")
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_repeated_bytes(load(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
