"""Order-coupled admission and best-first matching against sequential loops."""

import json
import random

from pyspark.sql import functions as F

from chartmill.operators import cleaning as C
from chartmill.operators import encodings as E


def by_loop(rows, quotas):
    """rows: (ord, keys...); quotas: (place of the key, limit, reason)."""
    used, out = {}, {}
    for row in sorted(rows):
        limits = [(p, n[row[p]] if isinstance(n, dict) else n, r) for p, n, r in quotas if row[p] is not None and (not isinstance(n, dict) or row[p] in n)]
        out[row[0]] = next((r for p, n, r in limits if used.get((p, row[p]), 0) >= n), None)
        if out[row[0]] is None:
            for p, _, _ in limits:
                used[p, row[p]] = used.get((p, row[p]), 0) + 1
    return out


def test_a_row_that_goes_holds_nothing(spark):
    df = spark.createDataFrame([(1, 1, "A"), (2, 1, "B"), (3, 2, "B")], "ord long, ident long, key string")
    got = {r["ord"]: r["reason"] for r in C.exact_reasons(df, "ident", "key", ["ord"]).collect()}
    assert got == {1: None, 2: "duplicate_doc_id", 3: None}


def test_admission_equals_the_loop(spark):
    rnd = random.Random(3)
    for keys in (3, 12):
        rows = [(k, rnd.choice([None, *range(keys)]), rnd.choice([None, *"abcdef"]), rnd.randrange(9)) for k in range(120)]
        df = spark.createDataFrame([(*r, "extra") for r in rows], "ord long, ident long, kind string, part long, reason string").drop("reason")
        quotas = [(1, 1, "ident"), (2, {"a": 3, "b": 9}, "kind"), (3, 5, "part")]
        got = {r["ord"]: r["reason"] for r in C.admitted(df, ["ord"], [(c, n, r) for (_, n, r), c in zip(quotas, ("ident", "kind", "part"), strict=True)]).collect()}
        assert got == by_loop(rows, quotas)


def test_admission_of_nothing(spark):
    assert C.admitted(spark.createDataFrame([], "ord long, key string"), ["ord"], [("key", 2, "r")]).count() == 0


def alike(a, b):
    near = 100 if a["channel"] == b["channel"] else 85 if {a["channel"], b["channel"]} == {"x", "y"} else 0
    return 25 * near + sum(100 * w for c, w in E.SHARES.items() if c != "channel" and a[c] == b[c])


def greedy(guess, reference):
    pairs = sorted((-alike(a, b), g, r) for g, a in enumerate(guess) for r, b in enumerate(reference))
    gs, rs, total = set(), set(), 0
    for less, g, r in pairs:
        if less < 0 and g not in gs and r not in rs:
            gs.add(g)
            rs.add(r)
            total -= less
    if not guess or not reference:
        return 1.0 if not guess and not reference else 0.0
    p, q = total / 10_000 / len(guess), total / 10_000 / len(reference)
    return 5 * p * q / (4 * p + q) if p > 0 and q > 0 else 0.0


def turned(e):
    return {**e, "channel": {"x": "y", "y": "x"}.get(e["channel"], e["channel"])}


def test_matching_with_ties(spark):
    rnd = random.Random(8)
    some = lambda: [{"view": 0, "channel": rnd.choice(["x", "y", "color"]), "field": rnd.choice("ab"), "type": rnd.choice(["", "nominal"]), "aggregate": rnd.choice(["", "sum"]), "bin": "", "time_unit": ""} for _ in range(rnd.randrange(5))]
    cases = [(k, some(), some()) for k in range(60)]
    kind = f"array<struct<{E._colons(E.ENCODING)}>>"
    df = spark.createDataFrame(cases, f"k long, g {kind}, r {kind}")
    got = E.matched(df.select("k", F.col("g").alias("encodings")), df.select("k", F.col("r").alias("encodings")), "k").collect()
    assert len(got) == 60
    for row in got:
        _, g, r = cases[row["k"]]
        assert abs(row["f"] - max(greedy(g, r), greedy([turned(e) for e in g], r))) < 1e-9
        assert len({p["g"] for p in row["pairs"]}) == len({p["r"] for p in row["pairs"]}) == len(row["pairs"])


def test_views_of_odd_specifications(spark):
    deep = {"mark": "bar", "encoding": {"x": {"field": "a"}}}
    for _ in range(60):
        deep = {"hconcat": [deep], "transform": [{"filter": "f"}]}
    inner = {"facet": {"field": "f"}, "spec": {"layer": [{"mark": {"type": "line"}, "encoding": {"x": [{"field": "a"}, {"field": "b", "condition": [{"field": "c"}, {"value": 1}]}], "y": {"value": 3}, "shape": {"aggregate": "count"}}}]}}
    texts = [None, "", "no", "[1]", "{}", '{"transform": [{"filter": "x"}, 3, {"aggregate": [{"op": "sum", "field": "v", "as": "s"}], "groupby": ["b", "a", 1]}]}', json.dumps(deep), json.dumps(inner)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, spec string").withColumn("views", F.lit("mine"))
    got = {r["k"]: r for r in E.extracted(df, "spec").collect()}
    assert [len(got[k]["views"]) for k in range(8)] == [0, 0, 0, 0, 1, 1, 1, 2]
    assert [(t["kind"], t["field"], t["op"], t["groupby"]) for t in got[5]["transforms"]] == [("filter", "", "", []), ("aggregate", "v", "sum", ["a", "b"])]
    assert len(got[6]["transforms"]) == 60 and got[6]["encodings"][0]["field"] == "a"
    assert [(e["view"], e["channel"], e["field"]) for e in got[7]["encodings"]] == [(0, "x", "a"), (0, "x", "b"), (0, "x", "c"), (0, "shape", "*"), (1, "x", "a"), (1, "x", "b"), (1, "x", "c"), (1, "shape", "*"), (1, "facet", "f"), (1, "facet", "f"), (1, "facet", "f")]
