"""Lexical search in small blocks against plain loops, and what leaves a part."""

import math

import numpy as np
import pytest

from chartmill.operators import retrieval as R


@pytest.mark.parametrize("method", ["keyword_top", "bm25_top", "tfidf_top"])
def test_first_documents_of_small_blocks(spark, monkeypatch, method):
    for name, size in (("DOC_BLOCK", 7), ("TERM_BLOCK", 3), ("LEXICAL_BLOCK", 2), ("CELLS", 5)):
        monkeypatch.setattr(R, name, size)
    rng = np.random.default_rng(3)
    docs = {k: [f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 12))] for k in range(40)}
    docs.update({41: ["w1", "w2"], 42: ["w1", "w2"], 43: []})
    queries = {f"q{k}": [f"w{x}" for x in rng.integers(0, 11, 4)] for k in range(6)} | {"none": []}
    n, full = len(docs), [d for d in docs.values() if d]
    df = lambda t: sum(t in d for d in docs.values())
    idf = lambda t: math.log((n + 1) / (df(t) + 1)) + 1 if df(t) else 1.0
    norm = lambda ws: math.sqrt(sum((ws.count(t) / len(ws) * idf(t)) ** 2 for t in set(ws)))
    mean = sum(map(len, full)) / len(full)

    def score(q, d):
        if method == "keyword_top":
            return len(set(q) & set(d)) / len(set(q))
        if method == "bm25_top":
            return sum(math.log(1 + (len(full) - df(t) + 0.5) / (df(t) + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in q if t in d)
        return sum(q.count(t) / len(q) * d.count(t) / len(d) * idf(t) ** 2 for t in set(q)) / norm(q) / norm(d)

    rows = spark.createDataFrame(list(docs.items()), "doc_id long, tokens array<string>")
    asked = spark.createDataFrame(list(queries.items()), "qid string, terms array<string>")
    got = sorted((r["qid"], r["rank"], r["doc_id"]) for r in getattr(R, method)(rows, asked, 5).collect())
    want = []
    for q, terms in queries.items():
        best = sorted((-round(score(terms, d), 6), k) for k, d in docs.items() if set(terms) & set(d))[:5]
        want += [(q, i + 1, k) for i, (_, k) in enumerate(best)]
    assert got == sorted(want)


def test_equal_scores_leave_a_part_k_times():
    scores, ids = np.full((2, 1000), 0.5), np.arange(1000)[::-1]
    scores[1, 3] = 0.75
    q, d = R._leading(scores, ids, 4)
    assert sorted(zip(q, ids[d])) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (1, 996)]
    q, d = R._leading(scores, ids, 2, np.arange(1000) % 3)
    assert sorted(zip(q, ids[d]))[:2] == [(0, 0), (0, 1)]


def test_words_of_odd_letters(spark):
    from pyspark.sql import functions as F

    from chartmill.functions.text import tokens

    df = spark.createDataFrame([("aİbc Kab ЖЩ_1 x Ёж",), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(F.col("t"))).collect()] == [["bc", "ab", "жщ_1"], []]
