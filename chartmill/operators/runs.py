"""Benchmark and run analytics: failure-aware means, percentiles by place, stratified reports, paired comparison, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartmill.operators.lineage import numbered


def rank_values(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """For each share p the element at place (n - 1) p, rounded half to even, of the sorted values of a group, as columns p<percent>.

    Values are counted first, so only distinct values are ordered.
    """
    each = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*groups)
    run = each.withColumn("_after", F.sum("_n").over(part.orderBy(value))).withColumn("_all", F.sum("_n").over(part))
    places = [F.bround((F.col("_all") - 1) * p) for p in shares]
    return run.groupBy(*groups).agg(*(F.min(F.when(F.col("_after") > place, F.col(value))).alias(f"p{round(100 * p)}") for p, place in zip(shares, places, strict=True)))


def failure_aware(df: DataFrame, groups: list[str], score: str) -> DataFrame:
    """Mean of the scores there are, mean with a missing score as zero, and the share that is missing."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.coalesce(score, F.lit(0.0))).alias("mean_failure_as_zero"), F.avg(F.col(score).isNull().cast("double")).alias("error_rate")
    )


def stratified(df: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Means for every level alone and over all, as (stratum, level, n, mean); rows without a level, or with a blank one, are in none of its strata."""
    out = df.groupingSets([[x] for x in levels] + [[]], *levels).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *(F.grouping(x).alias(f"_g{i}") for i, x in enumerate(levels)))
    stratum, level, named = F.lit("all"), F.lit("all"), F.lit(True)
    for i, x in enumerate(levels):
        mine = F.col(f"_g{i}") == 0
        stratum, level = F.when(mine, F.lit(x)).otherwise(stratum), F.when(mine, F.col(x).cast("string")).otherwise(level)
        named &= ~mine | (F.coalesce(F.col(x).cast("string"), F.lit("")) != "")
    return out.where(named).select(stratum.alias("stratum"), level.alias("level"), "n", "mean")


def paired(left: DataFrame, right: DataFrame, key: str, score: str, failed: str) -> DataFrame:
    """Cases of two runs side by side: in which run they are, whether they failed, and the difference of the scores, a failure or missing score as zero."""
    side = lambda df, s: df.where(F.col(key).isNotNull()).select(key, F.lit(True).alias(f"in_{s}"), F.coalesce(F.col(failed), F.lit(False)).alias(f"failed_{s}"), F.col(score).alias(f"score_{s}"))
    both = side(left, "left").join(side(right, "right"), key, "full")
    zero = lambda s: F.when(~F.col(f"failed_{s}"), F.coalesce(f"score_{s}", F.lit(0.0))).otherwise(F.lit(0.0))
    met = F.col("in_left") & F.col("in_right")
    return both.withColumn("delta", F.when(met, F.round(zero("right") - zero("left"), 6)))


def compare_runs(left: DataFrame, right: DataFrame, key: str, score: str, failed: str) -> DataFrame:
    """One row: cases in both and in one only, cases that got better, worse or neither (beyond 1e-9), that were fixed or broken, and the differences."""
    both, delta = paired(left, right, key, score, failed), F.col("delta")
    return both.agg(
        F.count("in_left").alias("left_cases"), F.count("in_right").alias("right_cases"), F.count(delta).alias("common"),
        F.count_if(F.col("in_right").isNull()).alias("left_only"), F.count_if(F.col("in_left").isNull()).alias("right_only"),
        F.count_if(delta > 1e-9).alias("better"), F.count_if(delta < -1e-9).alias("worse"), F.count_if(F.abs(delta) <= 1e-9).alias("unchanged"),
        F.count_if(F.col("failed_left") & ~F.col("failed_right")).alias("fixed"), F.count_if(~F.col("failed_left") & F.col("failed_right")).alias("broken"),
        F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.percentile(delta, 0.5), 6).alias("median_delta"),
    )


#: Of the draws: a prime below 2^31, so that squares stay within 63 bits. Values that each task may get (a packed row at least), values of a packed row, and replicates of a task.
PRIME, BROADCAST, PACK, REPLICATES = 2_147_483_647, 67_108_864, 65_536, 20


def drawn(replicate: int, place, n: int):
    """Numbers from 0 to n - 1 for an array of places, the same in every run: a few squares modulo a prime of a replicate's number and a place in it."""
    p = np.uint64(PRIME)
    rest = lambda x, m: x - x // m * m  # noqa: E731  (faster than % on arrays)
    y = rest(np.uint64(replicate * 48271 + 12345) + rest(place, p) * np.uint64(40692), p)
    for more in (np.uint64(7), np.uint64(replicate), place):
        y = rest(y * y + more, p)
    return rest(y, np.uint64(n))


def bootstrap_interval(df: DataFrame, value: str, order: list[str], samples: int = 1000) -> DataFrame:
    """One row (n, mean, low, high): the mean of the values and the 95 % interval of the means of ``samples`` resamplings with replacement.

    Values are numbered in ``order``; a replicate draws n of these numbers. No draw is a row: a task holds packed values, :data:`BROADCAST` at most,
    and sums what some replicates draw of them. More values are held in parts, and each part makes the draws anew. Nulls are no values.
    """
    spark = df.sparkSession
    values, n = numbered(df.where(F.col(value).isNotNull()).select(*order, F.col(value).cast("double").alias("_v")).orderBy(*order), "_place")
    if not n:
        return spark.createDataFrame([(0, None, None, None)], "n long, mean double, low double, high double")
    held, pack, each = max(BROADCAST, PACK), PACK, REPLICATES
    packed = values.groupBy(F.floor(F.col("_place") / pack).alias("_at")).agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_p"))
    of_task = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // each))).alias("_g")
    rows = packed.select(F.floor(F.col("_at") * pack / held).alias("_part"), "_at", F.col("_p._v").alias("_v")).select("*", of_task)

    def sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group = key[0].as_py(), key[1].as_py()
        first = -(-part * held // pack) * pack
        until = min(-(-(part + 1) * held // pack) * pack, n)
        mine = np.zeros(until - first)
        for batch in batches:
            for at, vs in zip(batch["_at"].to_pylist(), batch["_v"]):
                mine[at * pack - first : at * pack - first + len(vs)] = vs.values.to_numpy()
        replicates, step = range(group * each, min(samples, (group + 1) * each)), 16_384  # arrays that stay in the cache
        totals = [0.0] * len(replicates)
        for begin in range(0, n, step):
            places = np.arange(begin, min(begin + step, n), dtype=np.uint64)
            for k, b in enumerate(replicates):
                at = drawn(b, places, n).astype(np.int64)
                if len(mine) < n:
                    at = at[(at >= first) & (at < until)] - first
                totals[k] += mine.take(at).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(replicates), pa.int64()), pa.array(totals, pa.float64())], ["_b", "_s"])

    sums.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    met = rows.groupBy("_part", "_g").applyInArrow(sums, "_b long, _s double")
    means = F.array_sort(F.collect_list("_m"))  # one number for each replicate
    interval = met.groupBy("_b").agg((F.sum("_s") / n).alias("_m")).agg(means.alias("_ms"))
    mean = values.agg(F.round(F.avg("_v"), 6).alias("mean"))
    at = lambda share: F.round(F.col("_ms")[int(share * (samples - 1))], 6)
    return interval.join(F.broadcast(mean)).select(F.lit(n).cast("long").alias("n"), "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def rolled_up(df: DataFrame, path: str, value: str, separator: str = "/") -> DataFrame:
    """(path, depth, n, total): the sums of everything at and below each path; "" is the root. Sums are taken before the shuffle; a null path lies at the root."""
    steps = F.filter(F.split(F.coalesce(path, F.lit("")), separator), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), separator).alias("path"), k.alias("depth")))
    return df.select(F.explode(above).alias("p"), F.col(value).alias("v")).groupBy("p.path", "p.depth").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def metric_means(df: DataFrame, metrics: str) -> DataFrame:
    """(metric, n, mean): means over all keys of a map column, without nulls and NaN."""
    each = df.select(F.explode(metrics).alias("metric", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return each.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


def report_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two reports (metric, mean) side by side with their difference; a metric of one report only has none."""
    both = left.select("metric", F.col("mean").alias("left")).join(right.select("metric", F.col("mean").alias("right")), "metric", "full")
    return both.withColumn("delta", F.round(F.col("right") - F.col("left"), 6))


def roll_up(steps: DataFrame, run: str) -> DataFrame:
    """One row for each run from its steps (ord, stage, status, tokens, start, finish)."""
    failed = F.col("status") == "error"
    return steps.groupBy(run).agg(
        F.count("*").alias("stages"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(failed).alias("errors"), F.sum("tokens").alias("tokens"),
        F.min("start").alias("start"), F.max("finish").alias("finish"), F.min_by("stage", F.when(failed, F.col("ord"))).alias("first_failed"),
    )


def latest_steps(steps: DataFrame, run: str) -> DataFrame:
    """The last step of each stage of a run with the number of its repeats, and the place at which the stage was first seen."""
    return steps.groupBy(run, "stage").agg(F.max_by("status", "ord").alias("status"), F.max("ord").alias("last"), F.count("*").alias("repeats"), F.min("ord").alias("first"))


def merged(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Full join of two tables of the same string columns; non-blank values of the second take the place of the first's."""
    columns = [c for c in primary.columns if c != key]
    both = primary.join(secondary.select(key, *(F.col(c).alias(f"_{c}") for c in columns)), key, "full")
    return both.select(key, *(F.coalesce(F.when(F.trim(f"_{c}") != "", F.col(f"_{c}")), F.col(c)).alias(c) for c in columns))


def acceptance(df: DataFrame) -> DataFrame:
    """Shares of accepted, rejected, technically failed and evaluated cases from (accepted, error, verdict); rounded to six places."""
    refused = F.coalesce(F.col("error"), F.lit("")).startswith("chart_not_accepted")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return df.agg(
        F.count("*").alias("cases"), share(F.col("accepted") & F.col("error").isNull()).alias("accepted_rate"), share(~F.col("accepted") & F.col("error").isNull()).alias("rejected_rate"),
        share(F.col("error").isNotNull() & ~refused).alias("technical_rate"), F.count_if(F.col("verdict") != "unknown").alias("evaluated"),
        F.round(F.avg(F.when(F.col("verdict") != "unknown", (F.col("verdict") == "correct").cast("double"))), 6).alias("correct_rate"),
    )
