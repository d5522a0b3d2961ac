"""The thin queries over the synthetic tables: ``QUERIES`` and, where SQL can express them, ``ORACLES``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, fertility, html_text, language_id, language_model, phrases, sentencepiece_bpe, sharding, simhash, substring, suffix_array, whitening
from .common import table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), public_tokenizers.path(BYTE_RANKS))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_held_out(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a message of its own, also where rows tie on the turn or repeat; messages follow each other by turn, role and the text's hash."""
    said = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), said.alias("text"))
    says = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    copies = rows.unionByName(more).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    messages = copies.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return chat_format.digest(chat_format.read_back(chat_format.format_conversations(chat_format.streamed(messages))))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removal_digest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fertility, op2_substring, op3_language_model, op4_sharding, op5_chat_format, op6_sentencepiece, op7_html_text, op8_language_id, op9_simhash, op10_decontamination, op11_suffix_array, op12_whitening, op13_phrases)}

ORACLES = {
    "op5_chat_format": r"""
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
messages AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS turn, role, text FROM rows_),
escaped AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS r, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS t
  FROM messages)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + length('<turn role="">') + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op2_substring": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT r, words, unnest(generate_series(1, len(words) - 34)) AS i FROM d WHERE len(words) > 34)),
starts AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM starts),
kept AS (SELECT x.r, string_agg(x.w, ' ' ORDER BY x.p) AS t, count(*) AS n FROM (SELECT r, unnest(words) AS w, unnest(generate_series(1, len(words))) AS p FROM d) x ANTI JOIN gone g ON x.r = g.r AND x.p = g.p GROUP BY x.r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r""",
    "op10_decontamination": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT w, min(item_id) AS item_id FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 8 GROUP BY w),
places AS (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS j, least(len(w), 13) AS n FROM items),
item_words AS (SELECT item_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM items),
doc_words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM docs),
pairs AS (SELECT d.r, i.item_id, d.p - i.j AS off, i.j FROM doc_words d JOIN item_words i ON d.word = i.word),
diagonals AS (SELECT r, item_id, off, list_sort(list(j)) AS js FROM pairs GROUP BY r, item_id, off HAVING count(*) >= 8),
aligned AS (
  SELECT g.r, g.item_id, p.n, len(list_filter(g.js, lambda x: x >= p.j AND x < p.j + p.n)) AS same
  FROM diagonals g JOIN places p ON g.item_id = p.item_id),
found AS (SELECT r, item_id, max(same) AS same FROM aligned WHERE same >= CASE WHEN n < 13 THEN n ELSE 11 END GROUP BY r, item_id),
by_doc AS (SELECT r, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(same) AS overlap FROM found GROUP BY r)
SELECT d.doc_id, b.r IS NOT NULL AS contaminated, coalesce(b.items, '') AS items, CAST(coalesce(b.overlap, 0) AS INTEGER) AS overlap
FROM docs d LEFT JOIN by_doc b ON d.r = b.r""",
    "op11_suffix_array": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS bytes, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(array_slice(bytes, i, i + 399)) AS h FROM (SELECT r, bytes, unnest(generate_series(1, octet_length(bytes) - 399)) AS i FROM d WHERE octet_length(bytes) >= 400)),
starts AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
edges AS (SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -400) + 400 AS new FROM starts),
runs AS (SELECT r, i, sum(CAST(new AS INT)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM edges),
gone AS (SELECT r, k, min(i) AS a, max(i) + 399 AS b FROM runs GROUP BY r, k),
kept AS (
  SELECT g.r, sum(b - a + 1) AS n, count(*) AS spans, string_agg(substring(d.x, 2 * before - 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(d.x), 2 * max(b) + 1) AS x
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS before FROM gone) g JOIN d ON d.r = g.r GROUP BY g.r)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, x, y, count(*) AS a FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) > 1)) GROUP BY lang, x, y HAVING count(*) >= 10),
three AS (SELECT lang, x, y, z, count(*) AS a FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)) GROUP BY lang, x, y, z HAVING count(*) >= 10),
cuts AS (
  SELECT two.lang, concat_ws(' ', two.x, two.y) AS phrase, two.a, 1 AS k, l.f AS l, r.f AS r FROM two JOIN one l ON l.lang = two.lang AND l.x = two.x JOIN one r ON r.lang = two.lang AND r.x = two.y
  WHERE NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = two.lang AND t.x = two.x AND t.y = two.y AND 100 * t.a >= 50 * two.a) AND NOT EXISTS (SELECT 1 FROM three t WHERE t.lang = two.lang AND t.y = two.x AND t.z = two.y AND 100 * t.a >= 50 * two.a)
  UNION ALL SELECT t.lang, concat_ws(' ', t.x, t.y, t.z), t.a, 1, l.f, r.a FROM three t JOIN one l ON l.lang = t.lang AND l.x = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL SELECT t.lang, concat_ws(' ', t.x, t.y, t.z), t.a, 2, l.a, r.f FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.x = t.z),
scored AS (SELECT *, CAST(CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least s JOIN total t ON t.lang = s.lang QUALIFY rank <= 2000""",
}
