"""Corpus preparation over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.functions import text as X
from chartmill.operators import corpus as C


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")



def _sweep(spark, sf):
    """Every row of a vector that an earlier row of its label has must go at every threshold; the first row of each label must stay."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    copies = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"))
    again = rows.join(copies, ["label", "embedding"]).where("vec_id > first")
    return C.sweep_report(C.threshold_sweep(rows, "label", "vec_id", "embedding"), "vec_id", again, rows.groupBy("label").agg(F.min("vec_id").alias("vec_id")))


QUERIES = {
    "ded_exact": lambda spark, sf: C.first_of_key(_docs(spark, sf), C.content_key(F.col("lang"), F.col("text"), most=None), ["doc_id"]).select("doc_id"),
    "ded_vectors": lambda spark, sf: C.vector_leaders(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "vec_id", "embedding").select("vec_id", "duplicate_of"),
    "ded_sweep": _sweep,
    "qta_by_source": lambda spark, sf: C.within_quota(_docs(spark, sf), "source", ["doc_id"], 25).select("doc_id", "source"),
    "spl_stratified": lambda spark, sf: C.split(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 0.8),
    "flt_reasons": lambda spark, sf: _docs(spark, sf).groupBy(C.noise_reason(F.col("text"), 120, ["n a", "none"]).alias("reason"), "source").agg(F.count("*").alias("n")),
    "scl_compact": lambda spark, sf: _docs(spark, sf).select("doc_id", X.compact(F.col("text"), 120).alias("title"), X.slug(F.concat_ws(" ", "source", "lang")).alias("slug")),
    "set_missing": lambda spark, sf: _docs(spark, sf).select("doc_id").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_anti"),
    "qlt_lengths": lambda spark, sf: _docs(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.min("n_chars").alias("least"), F.percentile("n_chars", 0.5).alias("middle"), F.round(F.avg("n_chars"), 2).alias("mean"), F.max("n_chars").alias("most")
    ),
}
ORACLES = {
    "ded_exact": r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(lang), lower(trim(regexp_replace(coalesce(text, ''), '[\s]+', ' ', 'g')))",
    "qta_by_source": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 25",
    "spl_stratified": """SELECT doc_id, lang, CASE WHEN r <= CASE WHEN n = 1 THEN 1 ELSE greatest(1, least(n - 1, round_even(n * 0.8, 0))) END THEN 'train' ELSE 'test' END AS split
      FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS r FROM documents)""",
    "flt_reasons": r"""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 120 THEN 'short' WHEN trim(regexp_replace(lower(text), '[^a-zа-яё0-9]+', ' ', 'g')) IN ('n a', 'none') THEN 'low value'
      WHEN regexp_matches(text, '(?i)lorem ipsum|click here|subscribe now') THEN 'noise' END AS reason, source, count(*) AS n FROM documents GROUP BY 1, 2""",
    "scl_compact": r"""SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 119)) || '…' END AS title,
      substring(regexp_replace(regexp_replace(lower(concat_ws(' ', source, lang)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug
      FROM (SELECT *, trim(regexp_replace(text, '[\s]+', ' ', 'g')) AS t FROM documents)""",
    "set_missing": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "qlt_lengths": "SELECT source, count(*) AS n, min(n_chars) AS least, CAST(median(n_chars) AS DOUBLE) AS middle, round(avg(n_chars), 2) AS mean, max(n_chars) AS most FROM documents GROUP BY 1",
}
