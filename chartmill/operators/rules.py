"""Retrieved rules: metadata boost, compatibility, reranking, choice by type, and the evaluation of rankings by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rules of each type are taken, by default.
TAKEN = {"chart_pattern": 2, "encoding_rule": 2, "transform_rule": 1, "anti_pattern": 2, "vlm_rule": 1}


def boosted(score: Column, family: Column, task: Column, weight: Column) -> Column:
    """0.4 more for the wanted family and 0.4 for the wanted task (conditions; null: no), times the source's weight between 0.1 and 3 (1 if it isn't a number)."""
    more = lambda c: F.when(F.coalesce(c, F.lit(False)), 0.4).otherwise(0.0)
    factor = F.greatest(F.lit(0.1), F.least(F.coalesce(weight.try_cast("double"), F.lit(1.0)), F.lit(3.0)))
    return (score + more(family) + more(task)) * factor


def mentions(text: Column, markers: list[str]) -> Column:
    """Whether a text holds one of the markers."""
    said = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(said, m))


def incompatible(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null."""
    return F.coalesce(*(F.when(holds, F.lit(name)) for name, holds in rules))


def shared_groups(rule_text: Column, query_text: Column, groups: dict[str, list[str]], each: int = 25) -> Column:
    """So much for every group of markers that both texts mention."""
    return sum((F.when(mentions(rule_text, m) & mentions(query_text, m), each).otherwise(0) for m in groups.values()), F.lit(0))


def reranked(ranking: DataFrame, reason: Column, bonus: Column) -> DataFrame:
    """Compatible rows by score and bonus (ties keep their rank) get a new rank; the others keep their reason and have none."""
    scored = ranking.withColumn("reason", reason).withColumn("score", F.col("score") + bonus)
    order = Window.partitionBy("qid", F.col("reason").isNull()).orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.when(F.col("reason").isNull(), F.row_number().over(order)))


def taken_by_type(ranking: DataFrame, kind: str, taken: DataFrame, near: int = 5) -> DataFrame:
    """Rows of each type up to its number in ``taken`` (kind, k; 0 takes none) as selected, and the next ``near`` as below_top_k."""
    order = Window.partitionBy("qid", kind).orderBy("rank")
    placed = ranking.join(F.broadcast(taken), kind).withColumn("place", F.row_number().over(order)).where((F.col("k") > 0) & (F.col("place") <= F.col("k") + near))
    return placed.withColumn("status", F.when(F.col("place") <= F.col("k"), "selected").otherwise("below_top_k"))


def means_by_type(metrics: DataFrame, kind: str, figures: list[str]) -> DataFrame:
    """Means of each cut by type, and over all types as __all__."""
    out = metrics.groupingSets([["k", kind], ["k"]], "k", kind).agg(F.count("*").alias("n"), F.grouping(kind).alias("_all"), *(F.avg(c).alias(c) for c in figures))
    return out.withColumn(kind, F.when(F.col("_all") == 1, "__all__").otherwise(F.col(kind))).drop("_all")


def best_rows(rows: DataFrame, kind: str, metric: str) -> DataFrame:
    """The row of each type with the greatest metric, then reciprocal rank, then hits, then the smallest cut."""
    return rows.groupBy(kind).agg(F.max(F.struct(metric, "mrr", "hit", (-F.col("k")).alias("_k"))).alias("b")).select(kind, F.col(f"b.{metric}").alias(metric), F.col("b.mrr").alias("mrr"), F.col("b.hit").alias("hit"), (-F.col("b._k")).alias("k"))


def candidates(queries: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """(qid, doc_id): the documents of a query's type, or all where there are none of it. Queries are a stated set, documents the large side."""
    have = docs.select(kind).distinct().withColumn("_has", F.lit(True))
    asked = queries.select("qid", kind).join(have, kind, "left")
    own = asked.where("_has").join(docs.select("doc_id", kind), kind).select("qid", "doc_id")
    rest = asked.where("_has is null").select(F.collect_list("qid").alias("qids"))  # of the queries alone
    return own.unionByName(docs.join(F.broadcast(rest)).select(F.explode("qids").alias("qid"), "doc_id"))


def normalised(scores: DataFrame, by: str, way: str) -> DataFrame:
    """Scores of each query by ``mm`` (least to greatest), ``tmm`` (zero to greatest), ``z`` (deviations) or ``dbsf`` (three deviations each way)."""
    figures = scores.groupBy(by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    lo, span = {
        "mm": (F.col("lo"), F.col("hi") - F.col("lo")),
        "tmm": (F.lit(0.0), F.col("hi")),
        "z": (F.col("mean"), F.col("dev")),
        "dbsf": (F.col("mean") - 3 * F.col("dev"), 6 * F.col("dev")),
    }[way]
    return scores.join(figures, by).withColumn("score", F.when(span > 0, (F.col("score") - lo) / span).otherwise(0.0)).drop("lo", "hi", "mean", "dev")
