"""Rules, cleaning and text functions: documents stand for rules, their languages for types and their sources for families."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.functions import scalars as X
from chartmill.operators import cleaning as C
from chartmill.operators import retrieval as R
from chartmill.operators import rules as U
from chartmill.queries.retrieval import CUTS


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _ranking(spark, sf):
    """Documents of the same language within ten ids of every fortieth document, the nearest best."""
    d = _docs(spark, sf)
    q = d.where("doc_id % 40 = 0").select(F.col("doc_id").alias("qid"), "lang", F.explode(F.sequence(F.col("doc_id") - 10, F.col("doc_id") + 10)).alias("doc_id"))
    rows = q.join(d, ["doc_id", "lang"]).select("qid", "doc_id", "lang", "source", "text", "n_chars", F.round(100 - F.abs(F.col("doc_id") - F.col("qid")) - F.col("doc_id") % 3, 6).alias("score"))
    return R.ranked(rows)


_REASONS = {"map": "{id} % 7 = 0", "line": "{id} % 5 = 0"}


def _reranked(spark, sf):
    reason = U.incompatible([(n, F.expr(x.format(id="doc_id"))) for n, x in _REASONS.items()])
    bonus = U.shared_groups(F.concat_ws(" ", "source", "lang"), F.col("lang"), {"a": ["en", "de"], "b": ["fr", "en"]}) + F.when(F.col("doc_id") % 2 == 0, 10).otherwise(0)
    return U.reranked(_ranking(spark, sf), reason, bonus).select("qid", "doc_id", "reason", "rank", F.round("score", 4).alias("score"))


def _taken(spark, sf):
    taken = spark.createDataFrame([("en", 2), ("de", 1), ("fr", 0), ("es", 2)], "lang string, k int")
    return U.taken_by_type(_ranking(spark, sf), "lang", taken).select("qid", "doc_id", "place", "status")


def _metric_rows(spark, sf):
    """Truth: the documents of even id among those ranked; metrics by the query's language."""
    ranking = _ranking(spark, sf)
    return R.metrics(ranking, ranking.where("doc_id % 2 = 0").select("qid", "doc_id"), CUTS).join(_docs(spark, sf).select(F.col("doc_id").alias("qid"), "lang"), "qid")


def _means(spark, sf):
    return U.means_by_type(_metric_rows(spark, sf), "lang", ["hit", "recall", "precision", "mrr"])


def _quality(spark, sf):
    d, t = _docs(spark, sf), F.col("text")
    score = C.quality(t, F.col("source"), F.concat_ws(" ", "text", "source"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("lang") == "en", F.col("source").endswith("1"))
    return d.select("doc_id", F.round(score, 6).alias("quality"))


_FAMILIES = {"question": r"\?", "digits": r"\d{3}", "marks": r"[#*$%&]{2}"}


def _clusters(spark, sf):
    d = _docs(spark, sf).withColumn("cluster", C.first_family(F.coalesce("text", F.lit("")), _FAMILIES))
    return C.over_quota(d, "cluster", ["doc_id"], 30, "over").groupBy("cluster", "over").agg(F.count("*").alias("n"))


def _keys(spark, sf):
    d = _docs(spark, sf).withColumn("key", C.duplicate_key(F.col("lang"), F.col("text")))
    return C.over_quota(d, "key", ["doc_id"], 1, "over").select("doc_id", "over")


def _reasons(spark, sf):
    d = _docs(spark, sf).select((F.col("doc_id") % 900).alias("ident"), F.col("doc_id").alias("ord"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    return C.exact_reasons(d, "ident", "key", ["ord"]).select("ord", "reason")


def _admitted(spark, sf):
    d = _docs(spark, sf).withColumn("cluster", C.first_family(F.coalesce("text", F.lit("")), _FAMILIES)).withColumn("key", C.duplicate_key(F.col("lang"), F.col("text")))
    return C.admitted(d, ["doc_id"], [("source", {"source1": 20, "source2": 9}, "source_limit"), ("cluster", 30, "noise_cluster_limit"), ("key", 1, "duplicate_key_limit")]).select("doc_id", "reason")


def _validated(spark, sf):
    d = _docs(spark, sf).withColumn("source", F.when(F.col("doc_id") % 17 != 0, F.col("source")).otherwise(F.lit(" ")))
    return d.select("doc_id", F.array_join(C.errors(["source", "text"], {"lang": ["en", "de", "fr"]}), ";").alias("errors"))


def _split(spark, sf):
    d = _docs(spark, sf)
    splits = d.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    truth = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<bigint>")).when(F.col("doc_id") % 10 == 0, F.array(F.col("doc_id"), F.col("doc_id") + 5)).otherwise(F.array(F.col("doc_id"), F.col("doc_id") + 1))
    return C.question_split(d.select(F.col("doc_id").alias("qid"), truth.alias("truth")), splits)


def _resumed(spark, sf):
    d, labels = _docs(spark, sf).select("doc_id"), spark.read.parquet(f"{sf}/labels.parquet")
    return C.to_run(d, labels.select("doc_id", F.when(F.col("toxic") == 1, "bad").alias("error")), "doc_id", True)


def _said(spark, sf):
    return _docs(spark, sf).select("doc_id", F.concat(F.lit("It is -1,5 and 2e3; @mean["), F.col("n_chars").cast("string"), F.lit("] @name["), F.col("source"), F.lit("] @mean[7]. `code` [a link](http://x) <b>bold</b>")).alias("said"), "source", "n_chars", "text")


QUERIES = {
    "rul_boosted": lambda spark, sf: _docs(spark, sf).select("doc_id", F.round(U.boosted(F.col("n_chars") / 1000, F.col("source") == "source1", F.col("lang") == "en", F.when(F.col("doc_id") % 3 == 0, "x").otherwise((F.col("doc_id") % 50 / 10).cast("string"))), 6).alias("score")),
    "rul_reranked": _reranked,
    "rul_taken": _taken,
    "ret_means_by_type": lambda spark, sf: _means(spark, sf).select("k", "lang", "n", *(F.round(c, 4).alias(c) for c in ("hit", "recall", "precision", "mrr"))),
    "ret_best_rows": lambda spark, sf: U.best_rows(_means(spark, sf).withColumn("recall", F.round("recall", 4)), "lang", "recall").select("lang", "recall", "k"),
    "ret_normalised": lambda spark, sf: U.normalised(_ranking(spark, sf).select("qid", "doc_id", "score"), "qid", "mm").unionByName(U.normalised(_ranking(spark, sf).select(F.col("qid") + 1000000, "doc_id", "score").toDF("qid", "doc_id", "score"), "qid", "z")).withColumn("score", F.round("score", 4)),
    "ret_candidates": lambda spark, sf: U.candidates(_docs(spark, sf).where("doc_id % 200 = 0").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 400 == 0, "xx").otherwise(F.col("lang")).alias("lang")), _docs(spark, sf), "lang").groupBy("qid").agg(F.count("*").alias("n")),
    "ded_quality": _quality,
    "ded_reasons": _reasons,
    "flt_admitted": _admitted,
    "flt_clusters": _clusters,
    "flt_duplicate_keys": _keys,
    "val_errors": _validated,
    "val_summary": lambda spark, sf: C.summary(_docs(spark, sf), ["lang", "source"], ["text"]),
    "spl_questions": _split,
    "set_resumed": _resumed,
    "set_unique": lambda spark, sf: C.ordered_unique(_docs(spark, sf).withColumn("name", F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source"))), "lang", "name", "doc_id"),
    "scl_numbers": lambda spark, sf: _said(spark, sf).select("doc_id", F.aggregate(X.numbers(F.regexp_extract("said", "^[^@]*", 0)), F.lit(0.0), lambda s, x: s + x).alias("total")),
    "scl_answers": lambda spark, sf: _said(spark, sf).select("doc_id", X.answers(F.col("said"))["mean"].alias("mean"), X.answers(F.col("said"))["name"].alias("name"), X.within(F.col("n_chars").cast("double"), F.col("n_chars") + F.lit(20.0)).alias("near")),
    "scl_markdown": lambda spark, sf: _said(spark, sf).select("doc_id", X.without_markdown(F.col("said")).alias("said")),
    "scl_labels": lambda spark, sf: _said(spark, sf).select("doc_id", X.human_name(F.concat(F.lit("mean_psnrValue-of "), F.col("source"))).alias("name"), X.token_estimate(F.col("text")).alias("tokens"), X.score_band((F.col("doc_id") % 101).cast("double")).alias("band")),
    "scl_times": lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.run_time(F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss")).alias("at"), X.seconds_of(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.col("event_id") - 50).alias("seconds")),
}

_RANKED = """q AS (SELECT doc_id AS qid, lang FROM documents WHERE doc_id % 40 = 0),
  s AS (SELECT q.qid, d.*, round(100 - abs(d.doc_id - q.qid) - d.doc_id % 3, 6) AS score FROM documents d JOIN q ON d.lang = q.lang AND d.doc_id BETWEEN q.qid - 10 AND q.qid + 10),
  k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""
_METRICS = f"""{_RANKED}, t AS (SELECT qid, lang, max(n) AS n FROM (SELECT qid, lang, count(*) OVER (PARTITION BY qid) AS n FROM k WHERE doc_id % 2 = 0) GROUP BY 1, 2),
  m AS (SELECT t.qid, t.lang, c.c AS k, t.n, count(k.rank) AS f, min(k.rank) AS first FROM t CROSS JOIN (SELECT unnest([1, 2, 3, 5, 8]) AS c) c LEFT JOIN k ON k.qid = t.qid AND k.doc_id % 2 = 0 AND k.rank <= c.c GROUP BY ALL),
  e AS (SELECT k, lang, CAST(f > 0 AS INT) AS hit, f / n AS recall, f / k AS precision, coalesce(1 / first, 0) AS mrr FROM m),
  a AS (SELECT k, coalesce(lang, '__all__') AS lang, count(*) AS n, avg(hit) AS hit, avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr FROM e GROUP BY GROUPING SETS ((k, lang), (k)))"""
_SAID = "SELECT doc_id, source, n_chars, text, 'It is -1,5 and 2e3; @mean[' || n_chars || '] @name[' || source || '] @mean[7]. `code` [a link](http://x) <b>bold</b>' AS said FROM documents"
ORACLES = {
    "rul_boosted": "SELECT doc_id, round((n_chars / 1000 + CASE WHEN source = 'source1' THEN 0.4 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.4 ELSE 0 END) * CASE WHEN doc_id % 3 = 0 THEN 1 ELSE greatest(0.1, least(3, (doc_id % 50) / 10)) END, 6) AS score FROM documents",
    "rul_reranked": f"""WITH {_RANKED}, c AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'map' WHEN doc_id % 5 = 0 THEN 'line' END AS reason, score + CASE WHEN lang IN ('en', 'de') THEN 25 ELSE 0 END + CASE WHEN lang IN ('en', 'fr') THEN 25 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 0 END AS total FROM k)
      SELECT qid, doc_id, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY qid, reason IS NULL ORDER BY total DESC, rank) END AS rank, round(total, 4) AS score FROM c""",
    "rul_taken": f"""WITH {_RANKED}, p AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid, lang ORDER BY rank) AS place, CASE lang WHEN 'en' THEN 2 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 0 END AS n FROM k)
      SELECT qid, doc_id, place, CASE WHEN place <= n THEN 'selected' ELSE 'below_top_k' END AS status FROM p WHERE n > 0 AND place <= n + 5""",
    "ret_means_by_type": f"WITH {_METRICS} SELECT k, lang, n, round(hit, 4) AS hit, round(recall, 4) AS recall, round(precision, 4) AS precision, round(mrr, 4) AS mrr FROM a",
    "ret_best_rows": f"WITH {_METRICS} SELECT lang, round(recall, 4) AS recall, k FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(recall, 4) DESC, mrr DESC, hit DESC, k) = 1",
    "ret_normalised": f"""WITH {_RANKED} SELECT qid, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 4) AS score FROM k WINDOW w AS (PARTITION BY qid)
      UNION ALL SELECT qid + 1000000, doc_id, round(CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 4) FROM k WINDOW w AS (PARTITION BY qid)""",
    "ret_candidates": "SELECT doc_id AS qid, CASE WHEN doc_id % 400 = 0 THEN (SELECT count(*) FROM documents) ELSE (SELECT count(*) FROM documents e WHERE e.lang = d.lang) END AS n FROM documents d WHERE doc_id % 200 = 0",
    "ded_quality": """SELECT doc_id, round(least(length(coalesce(text, '')), 500) / 500 * 4 + least(length(coalesce(source, '')), 250) / 250 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.8 ELSE 0 END
      + CASE WHEN source LIKE '%1' THEN 0.3 ELSE 0 END + least(length(concat_ws(' ', text, source)), 1000) / 1000, 6) AS quality FROM documents""",
    "ded_reasons": """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id % 900 AS ident, doc_id AS ord, md5(coalesce(text, '')) AS key, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
      s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS reason
        UNION ALL SELECT n, CASE WHEN r IS NULL THEN list_append(ids, ident) ELSE ids END, CASE WHEN r IS NULL THEN list_append(keys, key) ELSE keys END, ord, r
        FROM (SELECT d.*, s.ids, s.keys, CASE WHEN list_contains(s.ids, d.ident) THEN 'duplicate_doc_id' WHEN list_contains(s.keys, d.key) THEN 'duplicate_content' END AS r FROM s JOIN d ON d.n = s.n + 1))
      SELECT ord, reason FROM s WHERE n > 0""",
    "flt_admitted": r"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, CASE source WHEN 'source1' THEN 'source1' WHEN 'source2' THEN 'source2' END AS source, CASE source WHEN 'source1' THEN 20 ELSE 9 END AS most,
        CASE WHEN regexp_matches(coalesce(text, ''), '\?') THEN 'question' WHEN regexp_matches(coalesce(text, ''), '\d{3}') THEN 'digits' WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{2}') THEN 'marks' END AS cluster,
        coalesce(lang, '') || ':' || array_to_string(string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яё0-9]+', ' ', 'g')), ' +')[1:12], ' ') AS key FROM documents),
      s AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS sources, CAST([] AS VARCHAR[]) AS clusters, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS reason
        UNION ALL SELECT n, CASE WHEN r IS NULL THEN list_append(sources, source) ELSE sources END, CASE WHEN r IS NULL THEN list_append(clusters, cluster) ELSE clusters END, CASE WHEN r IS NULL THEN list_append(keys, key) ELSE keys END, doc_id, r
        FROM (SELECT d.*, s.sources, s.clusters, s.keys, CASE WHEN len(list_filter(s.sources, lambda x: x = d.source)) >= d.most THEN 'source_limit' WHEN len(list_filter(s.clusters, lambda x: x = d.cluster)) >= 30 THEN 'noise_cluster_limit' WHEN list_contains(s.keys, d.key) THEN 'duplicate_key_limit' END AS r FROM s JOIN d ON d.n = s.n + 1))
      SELECT doc_id, reason FROM s WHERE n > 0""",
    "flt_clusters": r"""WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\?') THEN 'question' WHEN regexp_matches(coalesce(text, ''), '\d{3}') THEN 'digits' WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{2}') THEN 'marks' END AS cluster FROM documents)
      SELECT cluster, cluster IS NOT NULL AND r > 30 AS over, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS r FROM c) GROUP BY 1, 2""",
    "flt_duplicate_keys": r"""SELECT doc_id, row_number() OVER (PARTITION BY lang, array_to_string(string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-zа-яё0-9]+', ' ', 'g')), ' +')[1:12], ' ') ORDER BY doc_id) > 1 AS over FROM documents""",
    "val_errors": "SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 17 = 0 OR trim(source) = '' THEN 'missing source' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing text' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unknown lang' END) AS errors FROM documents",
    "val_summary": "SELECT 'lang' AS level, lang AS value, count(*) AS n, round(avg(length(coalesce(text, ''))), 2) AS mean_text FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(length(coalesce(text, ''))), 2) FROM documents GROUP BY source",
    "spl_questions": """WITH n AS (SELECT doc_id AS qid, CASE WHEN doc_id % 11 = 0 THEN [] WHEN doc_id % 10 = 0 THEN [doc_id, doc_id + 5] ELSE [doc_id, doc_id + 1] END AS truth FROM documents),
      e AS (SELECT qid, unnest(truth) AS doc_id FROM n), j AS (SELECT e.qid, bool_and(d.doc_id IS NOT NULL AND d.doc_id % 5 <> 0) AS train, bool_and(d.doc_id IS NOT NULL AND d.doc_id % 5 = 0) AS test FROM e LEFT JOIN documents d USING (doc_id) GROUP BY 1)
      SELECT n.qid, CASE WHEN train THEN 'train' WHEN test THEN 'test' ELSE 'dropped' END AS split FROM n LEFT JOIN j USING (qid)""",
    "set_resumed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1)",
    "set_unique": "SELECT lang, first(name ORDER BY doc_id) AS name, min(doc_id) AS place FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS name FROM documents) GROUP BY lang, lower(name)",
    "scl_numbers": "SELECT doc_id, CAST(-1.5 + 2000 AS DOUBLE) AS total FROM documents",
    "scl_answers": f"SELECT doc_id, '7' AS mean, source AS name, 20 <= greatest(0.03, n_chars * 0.03) AS near FROM ({_SAID})",
    "scl_markdown": f"SELECT doc_id, 'It is -1,5 and 2e3; @mean[' || n_chars || '] @name[' || source || '] @mean[7]. code a link bold' AS said FROM ({_SAID})",
    "scl_labels": "SELECT doc_id, 'Mean Psnr Value Of ' || upper(source[1]) || substring(source, 2) AS name, greatest(1, length(coalesce(text, '')) // 4) AS tokens, CASE WHEN s >= 0.85 THEN 'good' WHEN s >= 0.65 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT *, CASE WHEN doc_id % 101 > 1 THEN (doc_id % 101) / 100 ELSE doc_id % 101 END AS s FROM documents)",
    "scl_times": "SELECT event_id, date_trunc('second', ts) AS at, greatest(0.0, CASE WHEN event_id % 2 = 0 THEN value ELSE (event_id - 50) / 1000 END) AS seconds FROM events",
}
