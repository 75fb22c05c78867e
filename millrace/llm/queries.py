"""Registered queries of the text operators, with the SQL of those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.decontamination import contamination_digest
from millrace.llm.html_text import page_digest
from millrace.llm.language_id import language_digest
from millrace.llm.ngram_join import jaccard_components
from millrace.llm.personal_data import personal_data_digest
from millrace.llm.pieces import piece_digest
from millrace.llm.quality_classifier import quality_digest
from millrace.llm.quality_rules import RuleSettings, apply_rules
from millrace.llm.resampling import resample_digest
from millrace.llm.sharding import place_rows
from millrace.llm.spelling import spelling_variants
from millrace.llm.toxicity import toxicity_digest
from millrace.llm.warc import archive_digest

QUERIES: dict = {}
SQL: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_digest(table(spark, sf_dir, "pages"))


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(table(spark, sf_dir, "documents"))


@_query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return place_rows(docs, F.col("doc_id"), SHARDS, fallback=F.col("text")).drop("text")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


@_query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


@_query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@_query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(table(spark, sf_dir, "pages"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Windows of 13 words, each with the places it covers.
SQL["op1_decontamination"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
cut AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT c.doc_id, c.i, c.k, x.item_id FROM cut c JOIN windows x ON x.t = c.t AND x.k = c.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

# Pairs that share a shingle are compared, links followed to all reachable rows.
SQL["op2_ngram_join"] = rf"""
WITH RECURSIVE base AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM base),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM shingles),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM shingles s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = s.doc_id
"""


def _rules_sql(settings: RuleSettings = RuleSettings()) -> str:
    rates = {
        "symbol_rate": "n_symbols / greatest(word_chars, 1)", "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
        "capital_rate": "n_capitals / greatest(word_chars, 1)", "line_rate": "n_dup_lines / greatest(n_lines, 1)",
    }
    share = settings.risk / len(rates)
    tested = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rate, {c} AS cutoff, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM good GROUP BY stratum"
        for r in rates for c in settings.cutoffs
    )
    over = " OR ".join(f"coalesce(m.{r} > c.{r}, false)" for r in rates)
    pivot = ", ".join(f"min(cutoff) FILTER (rate = '{r}') AS {r}" for r in rates)
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words))),
repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
measured AS (
  SELECT doc_id, stratum, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(coalesce(text, ''), '[A-Z]'))::BIGINT AS n_capitals,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated USING (doc_id)),
rated AS (SELECT *, {", ".join(f"{e} AS {r}" for r, e in rates.items())} FROM measured),
marks AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id % {settings.folds} <> 0 GROUP BY doc_id),
good AS (
  SELECT stratum, text, {", ".join(f"any_value({r}) AS {r}" for r in rates)}
  FROM rated JOIN marks USING (doc_id) GROUP BY stratum, text HAVING max(quality) > 0),
tests AS ({tested}),
tails AS (
  SELECT stratum, rate, cutoff, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p
  FROM tests),
cutoffs AS (SELECT stratum, {pivot} FROM tails WHERE p <= {settings.delta} / (SELECT count(*) FROM tests) GROUP BY stratum),
judged AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {over} AS above
  FROM rated m LEFT JOIN cutoffs c USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT above AS kept FROM judged
"""


SQL["op10_quality_rules"] = _rules_sql()


# CRC-32 of a text, byte by byte over a table that a rule fills.
_CRC_TABLE = (
    "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), "
    "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"
)


def _crc(text: str) -> str:
    code = f"hex(encode({text}))"
    digit = "(strpos('0123456789ABCDEF', substr({0}, {1}, 1)) - 1)"
    byte = f"16 * {digit.format(code, '2 * i + 1')} + {digit.format(code, '2 * i + 2')}"
    return (
        f"xor(list_reduce(list_transform(range(len({code}) // 2), lambda i: {byte}), "
        "lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
    )


SQL["op11_resampling"] = rf"""
WITH {_CRC_TABLE},
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
flat AS (SELECT doc_id, unnest(w) AS f FROM docs),
known AS (SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT f FROM flat UNION SELECT f FROM goal), crc),
source AS (SELECT bucket, count(*) AS s FROM flat JOIN known USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal JOIN known USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket), sums),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM flat JOIN known USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
noise AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, list_reduce(list_transform(range(1, 9), lambda i:
    (strpos('0123456789abcdef', substr(sha256('2024:' || doc_id), i, 1)) - 1)::BIGINT), lambda a, b: a * 16 + b) AS h FROM docs),
scored AS (
  SELECT doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM noise LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * 10 // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

SQL["op12_spelling"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM runs, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.rest
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.rest),
near AS (
  SELECT p.a AS word, p.b AS other, w.n AS other_n, count(*) OVER (PARTITION BY p.a) AS n_near,
    row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b COLLATE "C") AS r
  FROM pairs p JOIN words w ON w.word = p.b),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM near WHERE r = 1) x ON x.word = w.word),
paths(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.last WHERE f.form IS NOT NULL),
roots AS (SELECT p.word, p.last AS root FROM paths p JOIN forms f ON f.word = p.last WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN roots r USING (word)
""".replace(' COLLATE "C"', "")

# Base 32 of a SHA-1: five bits a digit.
SQL["op13_warc"] = r"""
WITH bytes AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
hashed AS (SELECT page_id, payload_bytes, sha1(html) AS x FROM bytes),
digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 1, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(x, (5 * i) // 4 + 2, 1)) - 1, 0))
        // power(2, 3 - (5 * i) % 4)::BIGINT) % 32 + 1, 1)), '') AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS low FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> low THEN low END AS refers_to FROM firsts
"""
