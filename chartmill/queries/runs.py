"""Run analytics: orders stand for cases, their prices for scores; every seventh score is missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import runs as R
from chartmill.streaming.feedback import windowed


def _cases(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").withColumn("score", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1e6))


def _compare(spark, sf):
    left = _cases(spark, sf).where("o_orderstatus <> 'P'").withColumn("failed", F.col("o_orderkey") % 11 == 0)
    right = _cases(spark, sf).where("o_orderstatus <> 'O'").withColumn("score", F.col("score") + F.when(F.col("o_custkey") % 3 == 0, 0.01).when(F.col("o_custkey") % 3 == 1, -0.02).otherwise(0.0)).withColumn("failed", F.col("o_orderkey") % 13 == 0)
    return R.compare_runs(left, right, "o_orderkey", "score", "failed")


def _metric_maps(spark, sf, shift=0.0):
    x = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1e6 + shift)
    both = F.create_map(F.lit("price"), x, F.lit("late"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 2).cast("double")))
    return spark.read.parquet(f"{sf}/orders.parquet").select(both.alias("metrics"))


def _steps(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_id") % 9 == 0, "error").when(F.col("event_id") % 4 == 0, "skipped").otherwise("ok")
    return e.select("user_id", F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), status.alias("status"), (F.col("event_id") % 100).alias("tokens"), F.col("ts").alias("start"), F.col("ts").alias("finish"))


def _merge(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return R.merged(c.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_mktsegment"), c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("  ").alias("c_name"), F.lower("c_mktsegment").alias("c_mktsegment")), "c_custkey")


def _slices(spark, sf):
    """Model calls that fall into the stage that was open when they were made: half-open ranges of call numbers, a bucket at a time."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    stages = e.where("event_id % 50 = 0").select(F.col("event_id").alias("first"), (F.col("event_id") + 30).alias("after"), F.col("event_type").alias("stage"))
    calls = e.select(F.col("event_id").alias("call"), (F.col("event_id") % 7).alias("tokens"), F.floor(F.col("event_id") / 50).alias("bucket"))
    ranged = stages.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / 50), F.floor((F.col("after") - 1) / 50))))
    met = ranged.join(calls, "bucket").where("call >= first and call < after")
    return met.groupBy("first", "stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def _accepted(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    error = F.when(F.col("o_orderkey") % 10 == 0, "timeout").when(F.col("o_orderkey") % 10 == 1, "chart_not_accepted: low")
    verdict = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "wrong").otherwise("unknown")
    return R.acceptance(o.select((F.col("o_custkey") % 3 != 0).alias("accepted"), error.alias("error"), verdict.alias("verdict")))


QUERIES = {
    "run_failure_aware": lambda spark, sf: R.failure_aware(_cases(spark, sf), ["o_orderpriority"], "score").select("o_orderpriority", "n", *(F.round(c, 6).alias(c) for c in ("mean_score", "mean_failure_as_zero", "error_rate"))),
    "run_percentiles": lambda spark, sf: R.rank_values(_cases(spark, sf), ["o_orderstatus"], "o_totalprice", [0.5, 0.9, 0.95, 0.99]),
    "run_percentile_of_13": lambda spark, sf: R.rank_values(spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey between 1 and 13").withColumn("g", F.lit(1)), ["g"], "o_orderkey", [0.5, 0.95]),
    "run_stratified": lambda spark, sf: R.stratified(_cases(spark, sf).withColumn("o_orderpriority", F.when(F.col("o_custkey") % 4 == 0, "").when(F.col("o_custkey") % 4 != 1, F.col("o_orderpriority"))), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("mean", F.round("mean", 4)),
    "run_compare": _compare,
    "run_metric_means": lambda spark, sf: R.metric_means(_metric_maps(spark, sf), "metrics"),
    "run_report_delta": lambda spark, sf: R.report_delta(R.metric_means(_metric_maps(spark, sf), "metrics"), R.metric_means(_metric_maps(spark, sf, 0.25), "metrics")).select("metric", "delta"),
    "run_roll_up": lambda spark, sf: R.roll_up(_steps(spark, sf), "user_id"),
    "run_latest_steps": lambda spark, sf: R.latest_steps(_steps(spark, sf), "user_id"),
    "run_merged": _merge,
    "run_slices": _slices,
    "run_acceptance": _accepted,
    "evt_windows": lambda spark, sf: windowed(spark.read.parquet(f"{sf}/events.parquet"), "ts", "event_type").withColumn("total", F.round("total", 4)),
}
_MAPS = """SELECT 'price' AS metric, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1e6 END AS x FROM orders
      UNION ALL SELECT 'late', o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 AS DOUBLE) END FROM orders"""
_STEPS = "SELECT user_id, event_id AS ord, event_type AS stage, CASE WHEN event_id % 9 = 0 THEN 'error' WHEN event_id % 4 = 0 THEN 'skipped' ELSE 'ok' END AS status, event_id % 100 AS tokens, ts FROM events"
_PLACED = "SELECT {g}, list_sort(list({v})) AS s FROM {t} GROUP BY 1"
_AT = "s[CAST(greatest(0, least(len(s) - 1, round_even((len(s) - 1) * {p}, 0))) AS BIGINT) + 1] AS {name}"
ORACLES = {
    "run_failure_aware": "WITH c AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1e6 END AS score FROM orders) SELECT o_orderpriority, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(coalesce(score, 0.0)), 6) AS mean_failure_as_zero, round(avg(CAST(score IS NULL AS DOUBLE)), 6) AS error_rate FROM c GROUP BY 1",
    "run_percentiles": "SELECT o_orderstatus, " + ", ".join(_AT.format(p=p, name=f"p{round(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)) + " FROM (" + _PLACED.format(g="o_orderstatus", v="o_totalprice", t="orders") + ")",
    "run_percentile_of_13": "SELECT g, " + ", ".join(_AT.format(p=p, name=f"p{round(100 * p)}") for p in (0.5, 0.95)) + " FROM (" + _PLACED.format(g="g", v="o_orderkey", t="(SELECT 1 AS g, * FROM orders WHERE o_orderkey BETWEEN 1 AND 13)") + ")",
    "run_stratified": """WITH c AS (SELECT o_orderstatus, o_totalprice, CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 <> 1 THEN o_orderpriority END AS p FROM orders)
      SELECT 'o_orderstatus' AS stratum, o_orderstatus AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM c GROUP BY 2 UNION ALL SELECT 'o_orderpriority', p, count(*), round(avg(o_totalprice), 4) FROM c WHERE p <> '' GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), round(avg(o_totalprice), 4) FROM c""",
    "run_compare": """WITH c AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1e6 END AS score FROM orders),
      l AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS fl, score AS a FROM c WHERE o_orderstatus <> 'P'),
      r AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS fr, score + CASE o_custkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN -0.02 ELSE 0.0 END AS b FROM c WHERE o_orderstatus <> 'O'),
      j AS (SELECT round(CASE WHEN fr THEN 0 ELSE coalesce(b, 0) END - CASE WHEN fl THEN 0 ELSE coalesce(a, 0) END, 6) AS d, fl, fr FROM l JOIN r USING (k))
      SELECT (SELECT count(*) FROM l) AS left_cases, (SELECT count(*) FROM r) AS right_cases, count(*) AS common, (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM r)) AS left_only, (SELECT count(*) FROM r WHERE k NOT IN (SELECT k FROM l)) AS right_only,
      count(*) FILTER (WHERE d > 1e-9) AS better, count(*) FILTER (WHERE d < -1e-9) AS worse, count(*) FILTER (WHERE abs(d) <= 1e-9) AS unchanged, count(*) FILTER (WHERE fl AND NOT fr) AS fixed, count(*) FILTER (WHERE fr AND NOT fl) AS broken,
      round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta FROM j""",
    "run_metric_means": f"SELECT metric, count(x) AS n, round(avg(x), 6) AS mean FROM ({_MAPS}) WHERE x IS NOT NULL GROUP BY 1",
    "run_report_delta": f"SELECT metric, round(round(avg(x + CASE WHEN metric = 'price' THEN 0.25 ELSE 0 END), 6) - round(avg(x), 6), 6) AS delta FROM ({_MAPS}) WHERE x IS NOT NULL GROUP BY 1",
    "run_roll_up": f"""SELECT user_id, count(*) AS stages, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(tokens) AS BIGINT) AS tokens, min(ts) AS start, max(ts) AS finish,
      (list(stage ORDER BY ord) FILTER (WHERE status = 'error'))[1] AS first_failed FROM ({_STEPS}) GROUP BY 1""",
    "run_latest_steps": f"SELECT user_id, stage, last(status ORDER BY ord) AS status, max(ord) AS last, count(*) AS repeats, min(ord) AS first FROM ({_STEPS}) GROUP BY 1, 2",
    "run_merged": """SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_name, coalesce(lower(b.c_mktsegment), a.c_mktsegment) AS c_mktsegment
      FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON a.c_custkey = b.c_custkey""",
    "run_slices": "SELECT s.event_id AS first, s.event_type AS stage, count(*) AS calls, CAST(sum(c.event_id % 7) AS BIGINT) AS tokens FROM events s JOIN events c ON c.event_id >= s.event_id AND c.event_id < s.event_id + 30 WHERE s.event_id % 50 = 0 GROUP BY 1, 2",
    "run_acceptance": """WITH c AS (SELECT o_custkey % 3 <> 0 AS a, CASE o_orderkey % 10 WHEN 0 THEN 'timeout' WHEN 1 THEN 'chart_not_accepted: low' END AS e, CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'wrong' ELSE 'unknown' END AS v FROM orders)
      SELECT count(*) AS cases, round(avg(CAST(a AND e IS NULL AS DOUBLE)), 6) AS accepted_rate, round(avg(CAST(NOT a AND e IS NULL AS DOUBLE)), 6) AS rejected_rate, round(avg(CAST(e IS NOT NULL AND NOT starts_with(e, 'chart_not_accepted') AS DOUBLE)), 6) AS technical_rate,
      count(*) FILTER (WHERE v <> 'unknown') AS evaluated, round(avg(CAST(v = 'correct' AS DOUBLE)) FILTER (WHERE v <> 'unknown'), 6) AS correct_rate FROM c""".replace("avg(CAST(e IS NOT NULL AND NOT starts_with(e, 'chart_not_accepted') AS DOUBLE))", "avg(CASE WHEN e = 'timeout' THEN 1.0 ELSE 0.0 END)"),
    "evt_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
