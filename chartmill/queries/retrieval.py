"""Retrieval over ``documents`` with the texts of ``benchmark`` as queries, and over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.functions.text import tokens
from chartmill.operators import retrieval as R

CUTS = [1, 2, 3, 5, 8]


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tokens(F.col("text")).alias("tokens"))


def _queries(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), tokens(F.col("text")).alias("terms"))


def _top(best):
    return lambda spark, sf: best(_docs(spark, sf), _queries(spark, sf), 8).select("qid", "doc_id", "rank")


def _vectors(spark, sf):
    """Queries: every vector whose id is divisible by 20, against all vectors."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    docs, queries = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return R.cosine_top(docs, queries, 5).select("qid", "doc_id", "rank")


def _fused(spark, sf):
    d, q = _docs(spark, sf), _queries(spark, sf)
    known = R.statistics(d)
    both = R.fuse([R.bm25_top(d, q, 50, known=known), R.keyword_top(d, q, 50, known)])
    return R.ranked(both, 8).select("qid", "doc_id", "rank")


def _metrics(spark, sf):
    d, q = _docs(spark, sf), _queries(spark, sf)
    known = R.statistics(d)
    best = R.keyword_top(d, q, 8, known)
    truth = R.bm25_top(d, q, 3, known=known).select("qid", "doc_id")
    return R.metrics(best, truth, CUTS).select("qid", "k", "hit", *(F.round(c, 4).alias(c) for c in ("recall", "precision", "mrr", "ndcg")))


QUERIES = {
    "ret_keyword": _top(R.keyword_top),
    "ret_bm25": _top(R.bm25_top),
    "ret_tfidf": _top(R.tfidf_top),
    "ret_cosine": _vectors,
    "ret_fusion": _fused,
    "ret_metrics": _metrics,
    "scl_tokens": lambda spark, sf: _docs(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.array_distinct("tokens")).cast("long").alias("kinds")),
}

_TOKENS = "list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-zА-Яа-я0-9_]+'), lambda t: length(t) > 1), lambda t: lower(t))"
_BASE = f"""d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), q AS (SELECT item_id AS qid, {_TOKENS} AS w FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY 1, 2),
qt AS (SELECT qid, term, count(*) AS qtf, any_value(n) AS qlen FROM (SELECT qid, len(w) AS n, unnest(w) AS term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
kw AS (SELECT qid, doc_id, count(*) / (SELECT count(*) FROM qt y WHERE y.qid = qt.qid) AS score FROM p JOIN qt USING (term) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS mean FROM d WHERE len(w) > 0),
bm AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * qtf) AS score FROM p JOIN qt USING (term) JOIN df USING (term), s GROUP BY 1, 2)"""


def _ranked(scores: str, k: int) -> str:
    return f"(SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {scores} WHERE round(score, 6) > 0) WHERE rank <= {k})"


ORACLES = {
    "ret_keyword": f"WITH {_BASE} SELECT * FROM {_ranked('kw', 8)}",
    "ret_bm25": f"WITH {_BASE} SELECT * FROM {_ranked('bm', 8)}",
    "ret_tfidf": f"""WITH {_BASE}, nn AS (SELECT count(*) AS n FROM d), idf AS (SELECT term, ln((n + 1) / (df + 1)) + 1 AS idf FROM df, nn),
      w AS (SELECT doc_id, term, tf / len * idf AS w FROM p JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1),
      qw AS (SELECT qid, qt.term, qtf / qlen * coalesce(idf, 1.0) AS qw FROM qt LEFT JOIN idf ON qt.term = idf.term), qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1),
      dots AS (SELECT qid, doc_id, sum(w * qw) AS dot FROM w JOIN qw USING (term) GROUP BY 1, 2), sc AS (SELECT qid, doc_id, dot / (dn * qn) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (qid))
      SELECT * FROM {_ranked('sc', 8)}""",
    "ret_cosine": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sc AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
      SELECT * FROM {_ranked('sc', 5)}""",
    "ret_fusion": f"WITH {_BASE}, u AS (SELECT qid, doc_id, sum(1 / (rank - 1 + 60)) AS score FROM (SELECT * FROM {_ranked('bm', 50)} UNION ALL SELECT * FROM {_ranked('kw', 50)}) GROUP BY 1, 2) SELECT * FROM {_ranked('u', 8)}",
    "ret_metrics": f"""WITH {_BASE}, r AS (SELECT * FROM {_ranked('kw', 8)}), t AS (SELECT * FROM {_ranked('bm', 3)}), n AS (SELECT qid, count(*) AS n FROM t GROUP BY 1),
      e AS (SELECT qid, n, unnest([1, 2, 3, 5, 8]) AS k FROM n), h AS (SELECT r.qid, r.rank FROM r JOIN t ON r.qid = t.qid AND r.doc_id = t.doc_id)
      SELECT e.qid, e.k, CAST(count(h.rank) > 0 AS INTEGER) AS hit, round(count(h.rank) / any_value(n), 4) AS recall, round(count(h.rank) / e.k, 4) AS precision, round(coalesce(1 / min(h.rank), 0.0), 4) AS mrr,
        round(coalesce(sum(1 / log2(h.rank + 1)), 0.0) / list_sum(list_transform(range(1, least(e.k, any_value(n)) + 1), lambda i: 1 / log2(i + 1))), 4) AS ndcg
      FROM e LEFT JOIN h ON e.qid = h.qid AND h.rank <= e.k GROUP BY e.qid, e.k""",
    "scl_tokens": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS kinds FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)",
}
