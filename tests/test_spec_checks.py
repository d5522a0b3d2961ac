"""Repair, validity and emptiness of specifications on cases that the tables don't hold."""

import json

import pytest
from pyspark.sql import functions as F

from chartmill.operators import spec_checks as S
from chartmill.queries import matching, spec_checks


def fixed(spark, *specs):
    rows = [(i, json.dumps(s) if not isinstance(s, str) and s is not None else s, "own") for i, s in enumerate(specs)]
    got = S.repaired(spark.createDataFrame(rows, "id long, spec string, notes string")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(len(specs)))  # no row goes, and the column of the same name was replaced
    return [(json.loads(r.repaired), r.notes) for r in got]


def test_rules(spark):
    own = {"$schema": "own"}
    cases = [
        ({"mark": "SCATTER "}, {"$schema": S.SCHEMA, "mark": "point"}, [S.SCHEMA_ADDED, S.MARK_RENAMED]),
        (own | {"hconcat": [{"mark": {"type": "scatter", "size": 3}}, {"mark": "scatter"}, {"mark": "scatter"}]}, own | {"hconcat": [{"mark": {"type": "point", "size": 3}}, {"mark": "point"}, {"mark": "point"}]}, [S.MARK_TYPE_RENAMED, S.MARK_RENAMED]),
        (own | {"mark": "bar", "facet": "a"}, own | {"mark": "bar", "encoding": {"column": {"field": "a", "type": "nominal"}}}, [S.FACET_NAMED]),
        (own | {"facet": "a"}, own | {"facet": "a"}, []),
        (own | {"mark": "bar", "facet": {"row": "a", "column": {"field": "b", "type": "ordinal"}, "field": 3}, "encoding": {"column": "z"}}, own | {"mark": "bar", "encoding": {"row": {"field": "a", "type": "nominal"}, "column": {"field": "3", "type": "nominal"}}}, [S.FACET_MOVED]),
        (own | {"mark": "bar", "facet": {"row": None}}, own | {"mark": "bar", "facet": {"row": None}}, []),
        (own | {"mark": "bar", "facet": {"field": "a"}, "encoding": []}, own | {"mark": "bar", "facet": {"field": "a"}, "encoding": []}, []),
        (own | {"encoding": {"mark": "scatter"}}, own | {"encoding": {"mark": {"field": "point", "type": "nominal"}}}, [S.MARK_RENAMED, S.CHANNEL_BUILT.format("mark")]),
        (own | {"encoding": {"x": " a ", "shape": "b", "y": "  "}}, own | {"encoding": {"x": {"field": "a", "type": "quantitative"}, "shape": {"field": "b", "type": "nominal"}, "y": "  "}}, [S.CHANNEL_BUILT.format("x"), S.CHANNEL_BUILT.format("shape")]),
        (own | {"a": {"scale": {"domain": []}}, "b": {"scale": {"domain": [None, 0]}}, "c": [{"scale": {"domain": [None]}}], "d": {"scale": {"domain": None, "k": 1}}, "e": {"scale": {"domain": "x"}}, "f": {"scale": {}}},
         own | {"a": {"scale": {"domain": []}}, "b": {"scale": {"domain": [0]}}, "c": [{"scale": {}}], "d": {"scale": {"k": 1}}, "e": {"scale": {"domain": "x"}}, "f": {"scale": {}}}, [S.DOMAIN_CLEANED, S.DOMAIN_EMPTY, S.DOMAIN_NULL]),
        (own | {"transform": [{}, None, "x", {"loess": "a"}, {"sample": 3}], "datasets": {}, "spec": {"datasets": {}, "transform": {}}}, own | {"transform": [{"sample": 3}], "spec": {"datasets": {}, "transform": {}}}, [S.TRANSFORMS_CLEANED, S.DATASETS_EMPTY]),
    ]
    for (got, notes), (_, want, said) in zip(fixed(spark, *(c[0] for c in cases)), cases, strict=True):
        assert (got, notes) == (want, said)


def test_repair_settles(spark):
    """What was repaired needs no second repair."""
    given = {"mark": "scatter", "facet": {"field": "a"}, "encoding": {"x": "b"}, "transform": [3], "datasets": {}, "layer": [{"encoding": {"x": {"scale": {"domain": [None]}}}}]}
    (once, notes), = fixed(spark, given)
    assert len(notes) == 7
    assert fixed(spark, once) == [(once, [])]


def test_no_specification(spark):
    deep = "[" * 100_000 + "]" * 100_000
    for got in fixed(spark, None, "", "[1]", "{", "3", deep, "{}") [:-1]:
        assert got == ({}, [S.NOT_OBJECT])
    assert fixed(spark, "{}") == [({"$schema": S.SCHEMA}, [S.SCHEMA_ADDED])]
    assert S.repaired(spark.createDataFrame([], "spec string")).collect() == []


def test_long_and_nested(spark):
    inner = {"mark": "scatter"}
    for _ in range(300):
        inner = {"layer": [inner]}
    wide = {"mark": "bar", "title": "x" * 5_000_000, "encoding": {f"c{i}": "f" for i in range(5_000)}}
    (a, said), (b, notes) = fixed(spark, inner, wide)
    assert said[-1] == S.MARK_RENAMED and '"point"' in json.dumps(a)
    assert len(b["title"]) == 5_000_000 and len(notes) == 5_001


def test_validity(spark):
    columns = {"t": ["a", "b"], "none": []}
    cases = [
        ({"mark": "bar", "data": {"url": "t"}, "encoding": {"x": "a", "y": {"field": "*"}}}, []),
        ({"mark": "bar", "data": {"url": "t"}, "encoding": {"x": {"field": "z", "sort": ["q", 1]}, "y": {"field": "c"}}, "transform": [{"fold": ["a"], "as": ["c", ""]}]}, [S.NO_FIELD.format("q, z")]),
        ({"mark": "bar", "data": {"url": "none"}, "encoding": {"x": "z"}}, []),
        ({"data": {"url": "other"}}, [S.UNREADABLE.format("other"), S.NO_VIEW]),
        ({"data": {"url": "t"}, "key": "b", "lookup": "k"}, [S.NO_VIEW, S.NO_FIELD.format("k")]),
        ({"data": ["t"], "vconcat": []}, [S.NO_URL]),
    ]
    rows = [(2**60 + i, json.dumps(s)) for i, (s, _) in enumerate(cases)] + [(None, None)]
    got = {r.id: r for r in S.validity(spark.createDataFrame(rows, "id long, spec string"), columns).collect()}
    for i, (_, want) in enumerate(cases):
        r = got[2**60 + i]
        assert (r.errors, r.is_valid) == (want, not want)
        assert (S.HINT_FIELD in r.hints, r.hints[-1] == S.HINTS[-1]) == (any("references" in e for e in want), bool(want))
    assert (got[None].errors, got[None].hints, got[None].is_valid) == ([S.NO_OBJECT], [S.HINT_OBJECT], False)


@pytest.mark.parametrize("mark, where, want", [("bar", "datum.v > 2", False), ("bar", "datum.v > 9", True), ("line", "datum.v > 2", True), ({"type": "line"}, "datum.v > 0", False)])
def test_draws_nothing(spark, mark, where, want):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    encoding = {"x": {"field": "v"}, "color": {"field": "k"}}
    assert S.draws_nothing({"mark": mark, "transform": [{"filter": where}], "encoding": encoding}, df) is want
    assert S.draws_nothing({"transform": [{"filter": where}], "encoding": encoding, "layer": [{"mark": "line"}, {"mark": mark}]}, df) is want


def test_rows_of_a_small_file_are_worked_on_in_many_tasks(spark, tmp_path):
    """A part takes little room in its file and much work after it, so no task may hold them all."""
    spark.range(4000).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "cast(1 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (spec_checks._specs(spark, tmp_path), matching._side(spark, tmp_path, matching._GUESS), matching._matched(spark, tmp_path)):
        held = [r["count"] for r in query.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 4000 and max(held) < 3000
