"""Exact quantiles against Spark's percentile, and how many rows meet in one place."""

import pytest
from pyspark.sql import functions as F

from chartmill.operators import quantiles
from chartmill.plans import chart


def rows(spark):
    odd = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 10007) / 8.0)
    return spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), odd.alias("x"), F.when(F.col("id") % 4 != 2, -F.col("id")).alias("y"))


@pytest.mark.parametrize("accuracy", [10_000, 3])  # with the coarse one the bands miss their places
def test_as_percentile(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    asked = [(f"{c}{p}", F.col(c), p) for c in "xy" for p in (0.0, 0.25, 0.5, 0.999, 1.0)]
    for groups in ([], ["g"]):
        wanted = rows(spark).groupBy(*groups).agg(*(F.percentile(c, p).alias(n) for n, c, p in asked)).collect()
        got = quantiles.exact(rows(spark), groups, asked).collect()
        assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_no_task_takes_the_values_of_a_group(spark):
    plan = chart.view({"transform": [{"aggregate": [{"op": "median", "field": "x", "as": "m"}, {"op": "count", "as": "n"}], "groupby": ["g"]}]}, rows(spark))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in text and plan.count() == 4


def test_empty(spark):
    assert quantiles.exact(rows(spark).limit(0), [], [("m", F.col("x"), 0.5)]).collect() == [(None,)]
