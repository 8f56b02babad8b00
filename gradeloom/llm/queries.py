"""The registered corpus queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, filteraudit, fingerprint, langid, linededup, lm, packing, sharding, simhash, toxicity, urlfilter, warc
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held))
    out = langid.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.arrivals_compacted(table(spark, sf_dir, "documents")).read()
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.fit_and_score(docs)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    kept = F.coalesce("__text", F.lit(""))
    return out.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.char_length(kept).cast("long").alias("kept_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: The rules that op11 is asked for.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_document_fingerprints, op3_benchmark_decontamination, op4_shard_compaction, op5_simhash_near_dedup, op6_toxicity, op7_lm_scoring, op8_line_dedup, op9_warc_round_trip, op10_best_fit_packing, op11_url_filter, op12_source_divergence, op13_filter_interactions, pipeline)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_benchmark_decontamination": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM items, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, least(len(w), 1)))) AS i)
),
sizes AS (SELECT DISTINCT n FROM wins),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
cut AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n
),
hits AS (SELECT c.r, c.i, c.n, x.item_id FROM cut c JOIN wins x ON c.win = x.win AND c.n = x.n),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY r),
met AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (r) LEFT JOIN met USING (r)""",
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
words AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM words GROUP BY ALL HAVING sum(df) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
used AS (SELECT words.lang, source, term, words.n FROM words JOIN kept USING (lang, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM used GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(s.v, 0) AS v, s.total AS all_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN sizes s ON s.lang = g.lang
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(u.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (g.all_total + 5 * g.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op13_filter_interactions": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
marked AS (
  SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM docs
),
tally AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM marked LEFT JOIN flags USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS INT) AS prior
  FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)
),
counted AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (prior + bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & prior = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & prior > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(n * good) FILTER (mask & bit > 0 AND mask & prior = 0) AS good_lost, sum(n * toxic) FILTER (mask & bit > 0 AND mask & prior = 0) AS toxic_lost
  FROM tally, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted""",
    "op4_shard_compaction": "SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op8_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (
  SELECT r, doc_id, source, line, pos, lower(trim(line, ' ')) AS bare
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs WHERE text IS NOT NULL)
),
boiler AS (SELECT bare, min(doc_id) FILTER (WHERE source IS NOT NULL) AS first_id FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 8),
marked AS (SELECT l.*, b.bare IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first_id AS gone FROM lines l LEFT JOIN boiler b USING (bare)),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t FROM marked GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(g, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(t, '')) AS BIGINT) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (r)""",
    "op9_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS d FROM p),
g AS (SELECT d, n, max(page_id) AS first, count(*) AS c FROM q WHERE n >= 1000 GROUP BY d, n)
SELECT q.page_id, CAST(q.n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN g.c > 1 AND q.page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.c > 1 AND q.page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM q LEFT JOIN g ON q.d = g.d AND q.n = g.n""",
}
