"""Cleaning of rule records: duplicate keys, noise clusters, quotas, quality, validation, question splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.functions.text import first_words
from chartmill.operators.lineage import cut


def duplicate_key(kind: Column, *texts: Column, words: int = 12) -> Column:
    """The type and the first words of the texts, in plain form."""
    said = F.trim(F.concat_ws(" ", *(first_words(F.coalesce(t, F.lit("")), words) for t in texts)))
    return F.concat(F.coalesce(kind, F.lit("")), F.lit(":"), F.array_join(F.slice(F.split(said, " +"), 1, words), " "))


def first_family(text: Column, families: dict[str, str]) -> Column:
    """Name of the first family whose pattern is found, or null."""
    return F.coalesce(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in families.items()), F.lit(None))


def over_quota(df: DataFrame, key: str, order: list[str], quota: int, flag: str) -> DataFrame:
    """``flag``: the row is beyond the first ``quota`` rows of its key (rows without a key never are). Keys may hold any share of the rows: they
    are ranked in salted parts, of which each keeps ``quota`` candidates, and then among these."""
    last = cut(place_of_limit(df.select(key, F.struct(*order).alias("_o")), key, quota))
    return df.join(F.broadcast(last) if last.count() <= 1_000_000 else last, df[key] == F.col("_key"), "left").withColumn(flag, F.coalesce(F.struct(*order) > F.col("_last"), F.lit(False))).drop("_key", "_last")


def salt_of(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(64))


def quality(prompt: Column, retrieval: Column, text: Column, applies: Column, avoid: Column, core: Column, trusted: Column) -> Column:
    """Length-capped shares of three texts and bonuses; the last four are conditions."""
    share = lambda c, most: F.least(F.char_length(F.coalesce(c, F.lit(""))), F.lit(most)) / most
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), w).otherwise(0.0)
    return share(prompt, 500) * 4.0 + share(retrieval, 250) + yes(applies, 1.0) + yes(avoid, 1.0) + yes(core, 0.8) + yes(trusted, 0.3) + share(text, 1000)


def admitted(df: DataFrame, order: list[str], quotas: list[tuple[str, int | dict, str]]) -> DataFrame:
    """``reason``: the first of the quotas (key column, limit, reason) that a row finds used up by the admitted rows before it, or null.

    Rows come in ``order``, which must tell all rows apart. A row that goes uses up nothing, so every decision rests on those before it. They are
    settled in rounds: a row stays if its place is within the limit even with all open rows before it, and goes once the admitted ones
    alone fill a limit; the first open row of each key is always one of these. A key that is null has no limit; limits by key are a dict,
    and keys that it doesn't name have none. A round moves places and keys only, and finds the places that fill a limit from salted parts.
    """
    names = [f"_k{j}" for j in range(len(quotas))]
    limited = [F.when(F.col(k).isin(list(n)), F.col(k)) if isinstance(n, dict) else F.col(k) for k, n, _ in quotas]
    state = cut(df.select(F.struct(*order).alias("_o"), *(c.alias(n) for c, n in zip(limited, names, strict=True)), F.lit(None).cast("boolean").alias("_in")))

    def filled(rows: DataFrame, j: int, name: str) -> DataFrame:
        return place_of_limit(rows, names[j], quotas[j][1]).select(F.col("_key").alias(names[j]), F.col("_last").alias(name))

    while not state.where("_in is null").isEmpty():
        open_, stays, goes = state.where("_in is null"), F.lit(True), F.lit(False)
        for j, key in enumerate(names):
            for rows, name in ((state.where("coalesce(_in, true)"), f"_all{j}"), (state.where("_in"), f"_sure{j}")):
                open_ = open_.join(filled(rows, j, name), key, "left")
            stays &= F.coalesce(F.col("_o") <= F.col(f"_all{j}"), F.lit(True))
            goes |= F.coalesce(F.col("_o") > F.col(f"_sure{j}"), F.lit(False))
        settled = open_.select("_o", *names, F.when(stays, True).when(goes, False).alias("_in"))
        state = cut(state.where("_in is not null").unionByName(settled))
    for j, key in enumerate(names):
        state = state.join(filled(state.where("_in"), j, f"_sure{j}"), key, "left")
    reason = F.coalesce(*(F.when(F.col("_o") > F.col(f"_sure{j}"), F.lit(r)) for j, (_, _, r) in enumerate(quotas)), F.lit(None))
    return df.join(state.select(F.col("_o").alias("_o"), reason.alias("reason")), F.struct(*order) == F.col("_o")).drop("_o")


def place_of_limit(rows: DataFrame, key: str, limit: int | dict) -> DataFrame:
    """(_key, _last): the place ``_o`` of the row that fills the limit of its key; keys with fewer rows are left out. Each salted part of a key keeps no more rows than the limit."""
    part = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "_o")
    if limit == 1:
        return part.groupBy("_key").agg(F.min("_o").alias("_last"))
    most = F.lit(limit) if isinstance(limit, int) else F.create_map(*(F.lit(x) for pair in limit.items() for x in pair))[F.col("_key")]
    least = part.withColumn("_s", salt_of("_o")).withColumn("_r", F.row_number().over(Window.partitionBy("_key", "_s").orderBy("_o"))).where(F.col("_r") <= most)
    return least.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_o"))).where(F.col("_r") == most).select("_key", F.col("_o").alias("_last"))


def exact_reasons(df: DataFrame, ident: str, key: str, order: list[str]) -> DataFrame:
    """``reason``: duplicate_doc_id or duplicate_content of an earlier row that stays, or null; ids are looked at first, and a row that goes holds neither."""
    return admitted(df, order, [(ident, 1, "duplicate_doc_id"), (key, 1, "duplicate_content")])


def errors(required: list[str], vocabulary: dict[str, list[str]]) -> Column:
    """What is wrong with a record: blank required columns, and values outside their vocabulary."""
    blank = [F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"missing {c}")) for c in required]
    unknown = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(v), F.lit(f"unknown {c}")) for c, v in vocabulary.items()]
    return F.array_compact(F.array(*blank, *unknown))


def summary(df: DataFrame, levels: list[str], texts: list[str]) -> DataFrame:
    """Numbers and mean text lengths by each level alone: (level, value, n, mean lengths)."""
    out = df.groupingSets([[c] for c in levels], *levels).agg(F.count("*").alias("n"), *(F.round(F.avg(F.char_length(F.coalesce(t, F.lit("")))), 2).alias(f"mean_{t}") for t in texts), *(F.grouping(c).alias(f"_{c}") for c in levels))
    level, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in levels:
        level, value = F.when(F.col(f"_{c}") == 0, F.lit(c)).otherwise(level), F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return out.select(level.alias("level"), value.alias("value"), "n", *(f"mean_{t}" for t in texts))


def question_split(questions: DataFrame, splits: DataFrame) -> DataFrame:
    """(qid, split): train or test if all documents of a question (qid, truth array) are of that split, else dropped; so are questions without documents."""
    each = questions.select("qid", F.explode_outer("truth").alias("doc_id")).join(splits.select("doc_id", "split"), "doc_id", "left")
    share = lambda s: F.bool_and(F.coalesce(F.col("split") == s, F.lit(False)))
    return each.groupBy("qid").agg(F.when(share("train"), "train").when(share("test"), "test").otherwise("dropped").alias("split"))


def to_run(cases: DataFrame, done: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Cases without a result, and with ``retry_failed`` those whose result has an error."""
    good = done.where(F.col("error").isNull()) if retry_failed else done
    return cases.join(good.select(key).distinct(), key, "left_anti")


def ordered_unique(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The first spelling of each value of a group, by case-insensitive text, with its place."""
    kinds = df.where(F.col(value).isNotNull()).groupBy(group, F.lower(value).alias("_low")).agg(F.min_by(value, order).alias(value), F.min(order).alias("place"))
    return kinds.drop("_low")
