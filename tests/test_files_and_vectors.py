"""Files of one folder by their own dialects, and nearest vectors against brute force."""

import numpy as np
import pytest

from chartmill.operators import retrieval as R
from chartmill.sources.readers import dialect_of, read_files


def test_each_file_by_its_own_dialect(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Метод,Значение\nА,1\nБ,2\n".encode("cp1251"))
    (tmp_path / "b.csv").write_bytes("﻿Значение;Метод;Город\n3;В;\"Рига; центр\"\n4;Г\n".encode())
    (tmp_path / "c.csv").write_bytes("Метод\tЗначение\nД\t5\n\nЕ\t6\t7\n".encode())
    (tmp_path / "d.csv").write_bytes(b"")
    rows = read_files(spark, str(tmp_path))
    got = sorted((r["Значение"], r["Метод"], r["Город"], r["encoding"], r["delimiter"]) for r in rows.select("*").collect())
    assert set(rows.columns) == {"file", "encoding", "delimiter", "Метод", "Значение", "Город"}
    assert got == [("1", "А", None, "cp1251", ","), ("2", "Б", None, "cp1251", ","), ("3", "В", "Рига; центр", "utf-8", ";"), ("4", "Г", None, "utf-8", ";"), ("5", "Д", None, "utf-8", "\t"), ("6", "Е", None, "utf-8", "\t")]


def test_dialects():
    assert dialect_of(b"one\ntwo\n") == ("utf-8", ",") and dialect_of(b"") == ("utf-8", ",")
    assert dialect_of(b"a|b\n1|2\n") == ("utf-8", "|") and dialect_of(b"a;b,c\n1;2,3\n4;5\n")[1] == ";"


@pytest.mark.parametrize("keyed", [False, True])
def test_nearest_vectors(spark, monkeypatch, keyed):
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    monkeypatch.setattr(R, "ROW_BLOCK", 30)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(100, 6)).round(1)
    vectors[7] = vectors[3]
    vectors[9] = 0
    kinds = [None if k % 9 == 0 else f"g{k % 13}" for k in range(100)]
    docs = spark.createDataFrame([(k, v.tolist(), kinds[k]) for k, v in enumerate(vectors)] + [(200, None, "x"), (201, [1.0, None], "y")], "doc_id long, vector array<double>, kind string")
    queries = docs.where("doc_id % 10 = 3").selectExpr("doc_id AS qid", "vector")
    got = {}
    for r in R.cosine_top(docs, queries, 3, "kind" if keyed else None).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
    all_ = {**dict(enumerate(vectors)), 200: np.zeros(6), 201: np.array([1.0, 0, 0, 0, 0, 0])}
    kinds_ = {**dict(enumerate(kinds)), 200: "x", 201: "y"}
    unit = {k: v / np.linalg.norm(v) if v.any() else v for k, v in all_.items()}
    for q in range(3, 100, 10):
        near = sorted((-round(float(unit[q] @ unit[d]), 6), d) for d in unit if d != q and unit[q] @ unit[d] > 0)
        if keyed:
            seen = set()
            near = [(s, d) for s, d in near if kinds_[d] is None or not (kinds_[d] in seen or seen.add(kinds_[d]))]
        assert sorted(got[q]) == [(k + 1, d) for k, (_, d) in enumerate(near[:3])]
