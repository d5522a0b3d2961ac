"""Every query over the analytic tables equals its SQL on the smallest data."""

import duckdb
import numpy as np
import pytest

from chartmill.operators import corpus as C
from chartmill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or v != v:
            return ""
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.project(quoted).fetchall())


def test_vector_leaders_against_brute_force(spark):
    import numpy as np

    from chartmill.operators.corpus import vector_leaders

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, i % 2, (base[i % 12] + rng.normal(size=8) * 0.02).tolist()) for i in range(48)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r["vec_id"]: r["duplicate_of"] for r in vector_leaders(df, "label", "vec_id", "embedding").collect()}
    want, leaders = {}, []
    for i, g, v in rows:
        v = np.array(v) / np.linalg.norm(v)
        near = next((k for k, h, u in leaders if h == g and u @ v >= 0.95), None)
        want[i] = near
        if near is None:
            leaders.append((i, g, v))
    assert got == want


def test_vector_leaders_of_large_groups(spark):
    from chartmill.operators.corpus import vector_leaders

    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 8))
    rows = [(i, int(i % 10 == 0), (base[rng.integers(700)] + rng.normal(size=8) * 0.02).tolist()) for i in rng.permutation(3000).tolist()]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    got = {r["vec_id"]: r["duplicate_of"] for r in vector_leaders(df, "label", "vec_id", "embedding").collect()}
    want, leaders = {}, {0: ([], []), 1: ([], [])}
    for i, g, v in sorted(rows):
        keys, units = leaders[g]
        v = np.array(v) / np.linalg.norm(v)
        near = np.flatnonzero(np.array(units) @ v >= 0.95) if keys else []
        want[i] = keys[near[0]] if len(near) else None
        if not len(near):
            keys.append(i)
            units.append(v)
    assert got == want and sum(x is not None for x in want.values()) > 1500


def test_readers(spark, tmp_path):
    from chartmill.sources.readers import TableReadError, encoding_of, read_container, read_lenient_lines, read_table, write_lines

    (tmp_path / "a.csv").write_bytes("Город;улица,Дом\nОмск,7\nТверь,12\n".encode("cp1251"))
    assert encoding_of(spark, str(tmp_path / "a.csv")) == "cp1251"
    table = read_table(spark, str(tmp_path / "a.csv"))
    assert table.columns == ["Город;улица", "Дом"] and table.count() == 2 and read_table(spark, str(tmp_path / "a.csv"), 1).count() == 1
    (tmp_path / "b.csv").write_bytes("plant,height\nfern,40\n".encode("utf-8-sig"))
    assert read_table(spark, str(tmp_path / "b.csv")).columns == ["plant", "height"]
    with pytest.raises(TableReadError):
        read_table(spark, str(tmp_path / "c.bin"))
    (tmp_path / "d.jsonl").write_text('{"text": "x"}\n\nnot json\n')
    assert [str(r[0]) for r in read_lenient_lines(spark, str(tmp_path / "d.jsonl")).collect()] == ['{"text":"x"}', '{"text":"not json"}']
    (tmp_path / "e.json").write_text('{"items": [{"a": 1}, {"a": 2}]}')
    assert read_container(spark, str(tmp_path / "e.json")).count() == 2
    write_lines(table, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from chartmill.streaming.feedback import follow, windowed

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    follow(spark, str(tmp_path / "in"), events, str(tmp_path / "out"), str(tmp_path / "cp"), "ts", "event_type").awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in windowed(events, "ts", "event_type").collect()}
    assert got and all(want[k] == n for k, n in got.items())  # windows behind the watermark have closed


def test_profile_rules(spark):
    from chartmill.operators.profile import profile

    df = spark.createDataFrame([(i, "true" if i % 2 else "no", float(i % 9), None) for i in range(20)] + [(99, "yes", 900.0, None)], "user_id int, flag string, value double, empty string")
    got = {r["column"]: r for r in profile(df).collect()}
    assert (got["user_id"]["role"], got["flag"]["dtype"], got["value"]["role"], got["value"]["outliers"]) == ("identifier", "boolean", "measure", 1)
    assert got["empty"]["missing"] == 21 and got["empty"]["dtype"] == "categorical"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_profile_of_years_and_nested_columns(spark):
    from chartmill.operators.profile import profile, safe_name_map, table_notes

    df = spark.createDataFrame([(1970 + i, str(i), "2024-01-%02d" % (i + 1), [i], "n/a" if i < 2 else "x") for i in range(12)], "model_year int, amount string, seen string, parts array<int>, note string")
    got = {r["column"]: r for r in profile(df).collect()}
    assert {c: r["dtype"] for c, r in got.items()} == {"model_year": "datetime", "amount": "numeric", "seen": "datetime", "parts": "categorical", "note": "categorical"}
    assert got["model_year"]["role"] == "temporal" and "numeric_string" in got["amount"]["flags"] and got["parts"]["flags"] == ["degraded_profile"]
    assert got["note"]["missing_like"] == 2 and "missing_like_strings" in got["note"]["flags"]
    assert {r["note"] for r in table_notes(profile(df), 12).collect()} == {"time-like: model_year, seen", "degraded_profile"}
    assert safe_name_map(["a b", "a-b", "a_b_2", "1", "%"]) == [("a b", "a_b"), ("a-b", "a_b_2"), ("a_b_2", "a_b_2_2"), ("1", "col_1"), ("%", "column")]


def test_quartiles_of_a_profile_without_gathering_a_column(spark):
    from pyspark.sql import functions as F

    from chartmill.operators import profile as P

    odd = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 7919 % 10007) / 8.0)
    df = spark.range(5000).select("id", odd.alias("x"), odd.cast("float").alias("f"), (F.col("id") % 3).cast("decimal(9,2)").alias("d"), F.lit(None).cast("int").alias("none"), F.lit(float("inf")).alias("inf"), F.col("id").cast("string").alias("s"))
    known = {c: F.col(c).isNotNull() & (~F.isnan(c) if c in "xf" else F.lit(True)) for c in df.columns}
    numeric = [c for c in df.columns if c != "s"]
    counts, quartiles = P._value_counts(df, known, numeric)
    want = df.agg(*(F.percentile(F.when(known[c], F.col(c).cast("double")), [0.25, 0.75]).alias(c) for c in numeric), *(F.count_distinct(F.when(known[c], F.col(c))).alias(f"n_{c}") for c in df.columns)).first()
    assert counts == {c: want[f"n_{c}"] for c in df.columns}
    assert quartiles == {c: want[c] for c in numeric if want[c]}


def test_runs_with_nulls_ties_and_thirteen_values(spark):
    from chartmill.operators import runs as R

    values = spark.createDataFrame([("a", float(i)) for i in range(13)] + [("b", 2.0), ("b", 2.0), ("c", None)], "g string, x double")
    assert {r["g"]: (r["p50"], r["p95"]) for r in R.rank_values(values, ["g"], "x", [0.5, 0.95]).collect()} == {"a": (6.0, 11.0), "b": (2.0, 2.0)}
    left = spark.createDataFrame([("1", None, False), ("2", 0.5, False), ("3", 0.5, True), ("4", 0.2, False)], "k string, s double, f boolean")
    right = spark.createDataFrame([("1", None, False), ("2", 0.5, True), ("3", 0.5, False), ("5", None, None)], "k string, s double, f boolean")
    r = R.compare_runs(left, right, "k", "s", "f").first().asDict()
    assert r == {"left_cases": 4, "right_cases": 4, "common": 3, "left_only": 1, "right_only": 1, "better": 1, "worse": 1, "unchanged": 1, "fixed": 1, "broken": 1, "mean_delta": 0.0, "median_delta": 0.0}


def test_window_peers_share_their_frame(spark):
    from chartmill.plans import chart

    df = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "t int, v int")
    step = {"window": [{"op": "sum", "field": "v", "as": "run"}], "sort": [{"field": "t"}]}
    assert sorted(r["run"] for r in chart.transform(df, step, {}).collect()) == [30, 30, 35]
    assert sorted(r["run"] for r in chart.transform(df, {**step, "ignorePeers": True}, {}).collect()) in ([10, 30, 35], [20, 30, 35])


def test_specification_scores_of_odd_specs(spark):
    from chartmill.operators import specs as S

    rows = [(1, '{"mark": "bar", "a": [1, {"b": []}, 1]}', '{"a": [1, 1, {"b": []}], "mark": "bar"}'), (2, "not json", '{"x": 1}'), (3, "{}", None), (4, '{"x": 1, "y": 2}', '{"x": 1}')]
    df = spark.createDataFrame(rows, "k int, ref string, guess string")
    ref, guess = S.nodes(df, "k", "ref"), S.nodes(df, "k", "guess")
    got = {r["k"]: (r["precision"], r["recall"], r["f"], r["jaccard"]) for r in S.f_beta(df, "k", S.items(ref, "k", S.path_item(), ref["leaf"]), S.items(guess, "k", S.path_item(), guess["leaf"])).collect()}
    assert got[1] == (1.0, 1.0, 1.0, 1.0) and got[2] == (0.0, 1.0, 0.0, 0.0) and got[3] == (1.0, 1.0, 1.0, None) and got[4][:2] == (1.0, 0.5)


def test_quotas_of_hot_keys(spark):
    from chartmill.operators.cleaning import over_quota

    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then cast(id as string) end as key")
    got = over_quota(df, "key", ["id"], 7, "over")
    assert got.count() == 5000 and sorted(r["id"] for r in got.where("not over and key = 'hot'").collect()) == [3 * i for i in range(7)] and got.where("over and (key is null or key <> 'hot')").count() == 0


@pytest.mark.parametrize("quota", [1, 7])
def test_keys_are_made_twice_at_most(spark, quota):
    from pyspark.sql import functions as F

    from chartmill.operators.cleaning import over_quota

    made = spark.sparkContext.accumulator(0)
    key = F.udf(lambda i: made.add(1) or f"k{i % 10}", "string").asNondeterministic()
    assert over_quota(spark.range(1000).withColumn("key", key("id")), "key", ["id"], quota, "over").where("not over").count() == 10 * quota
    assert made.value <= 2000


def test_first_words(spark):
    from pyspark.sql import functions as F

    from chartmill.functions.text import first_words, plain_words

    texts = ["", " ", "a", "--A-b--", "Ёлка и ёж\nдва", "İstanbul \u212a x", "word " * 30, "x" * 5000, "\U0001f600a\U0001f600b", "a b c d", " ΑΣ a Σ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 12):
        got = df.select(first_words(F.col("t"), n), F.array_join(F.slice(F.split(plain_words(F.col("t")), " +"), 1, n), " ")).collect()
        assert all(a == b for a, b in got), n


def test_split_ranks_each_stratum_in_hash_order(spark):
    """One large stratum, a single row and rows without a stratum, against a plain sort."""
    from hashlib import md5

    rows = [(i, "a" if i < 500 else "b" if i == 500 else None) for i in range(507)]
    got = {r["id"]: r["split"] for r in C.split(spark.createDataFrame(rows, "id int, g string"), "g", "id", 0.8).collect()}
    for g in ("a", "b", None):
        own = sorted((i for i, h in rows if h == g), key=lambda i: md5(f"{i}|42".encode()).hexdigest())
        take = 1 if len(own) == 1 else max(1, min(len(own) - 1, round(len(own) * 0.8)))
        assert [got[i] for i in own] == ["train"] * take + ["test"] * (len(own) - take)


def test_polynomial_fit_layers_and_top_on_odd_data(spark):
    from chartmill.plans import chart

    rng = np.random.default_rng(11)
    rows = [("a", x, 2.0 - x + 0.5 * x**3) for x in rng.uniform(-4, 9, 40).tolist()] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", 2.0, 5.0), (None, 0.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fit = {"regression": "y", "on": "x", "method": "poly", "order": 3, "groupby": ["g"]}
    got = {r["g"]: r["coef"] for r in chart.transform(df, fit, {}).collect()}
    assert np.allclose(got["a"], [2, -1, 0, 0.5], atol=1e-6) and got["b"] is None and None not in got
    assert chart.transform(df.limit(0), fit, {}).count() == 0
    ties = spark.createDataFrame([("q", 1), ("p", 1), ("r", 0)], "k string, n long")
    assert [r["k"] for r in chart.top(ties, 2, [{"field": "n", "order": "descending"}]).collect()] == ["p", "q"]
    nested = {"vconcat": [{"layer": [{"encoding": {"x": {"field": "k"}}}, {"encoding": {"x": {"field": "n"}}}]}, {"encoding": {"x": {"field": "k"}}}]}
    assert [v.columns for v in chart.layers(nested, ties)] == [["k"], ["n"], ["k"]]


def test_composite_score_of_a_specification(spark):
    """Missing and undrawable guesses, blank charts, needless transforms and requests that name a mark, by hand."""
    from pyspark.sql import functions as F

    from chartmill.operators import specs as S

    rows = [
        (1, "{}", "a bar", True, True, False, 1.0, 0, 0),
        (2, "{x}", "a bar", False, True, False, 1.0, 0, 0),
        (3, "{x}", "bars", True, True, False, 1.0, 0, 0),
        (4, "{x}", "a BAR, please", True, False, False, 0.5, 1, 1),
        (5, "{x}", None, True, True, True, 1.0, 0, 2),
        (6, "{x}", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, guess string, request string, drawable boolean, valid boolean, blank boolean, f double, r int, g int")
    score = S.composite_score(*(F.col(c) for c in ("guess", "request", "drawable", "valid", "blank")), {c: F.col("f") for c in ("encoding", "mark", "transform")}, {"reference": F.col("r"), "guess": F.col("g")})
    got = {r["k"]: r["s"] for r in df.select("k", score.alias("s")).collect()}
    want = {1: 0.0, 2: 0.0, 3: 1.0, 4: (0.005 + 0 + 0.005 + 1.5 + 0.5 + 0.5) / (0.005 + 1 + 0.005 + 3 + 1 + 1), 5: (0.01 + 2.25 + 0.5) / (0.01 + 1000 + 2.25 + 0.5 + 1), 6: 0.0}
    assert got == {k: round(x, 6) for k, x in want.items()}


def test_composite_scores_to_six_places(spark):
    """The query's shares are doubles, as in its SQL: decimals would be cut at six places before they are weighed."""
    con = duckdb.connect()
    con.sql("CREATE VIEW part AS SELECT * FROM '/root/testdata/sf0.01/part.parquet'")
    got = sorted(tuple(r) for r in QUERIES["spc_composite"](spark, "/root/testdata/sf0.01").select("p_partkey", "score").collect())
    assert got == sorted(con.sql(ORACLES["spc_composite"]).select("p_partkey", "score").fetchall())


def test_trees_of_odd_specs_in_one_pass(spark):
    """Brackets and quotes in strings, empty lists, nulls and deep trees; the rows of a specification are shuffled once, before they are opened."""
    from chartmill.operators import specs as S

    deep = "[" * 30 + "1" + "]" * 30
    rows = [(1, r'{"a": "[{\"[[", "b": [[], {"c": null}]}'), (2, deep), (3, "[[[" * 40), (4, None), (5, r'{"q": "\\", "r": [{"s": 1}]}')]
    tree = S.nodes(spark.createDataFrame(rows, "k int, spec string"), "k", "spec")
    got = sorted((r["k"], r["path"], r["leaf"]) for r in tree.collect() if r["k"] != 2)
    assert got == [(1, "$.a", True), (1, "$.b", False), (1, "$.b[*]", False), (1, "$.b[*]", True), (1, "$.b[*].c", True), (5, "$.q", True), (5, "$.r", False), (5, "$.r[*]", False), (5, "$.r[*].s", True)]
    assert [r["value"] for r in tree.where("k = 2 and leaf").collect()] == ["1"] and tree.where("k = 2").count() == 30
    items = S.items(tree, "k", S.path_item())
    assert items._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        S.nodes(spark.createDataFrame([(1, "[" * 32 + "1" + "]" * 32)], "k int, spec string"), "k", "spec")
