"""Scores of generated chart specifications against reference ones, as multisets of items of their JSON trees.

A specification is a JSON text; its tree is walked level by level with VARIANT functions, so every specification of a table takes part in the
same joins. Items carry a weight; two sides are compared by grouped sums, never spec by spec.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(spec: Column) -> Column:
    """Levels of a JSON text that hold something: brackets within brackets, without those in strings and without empty ones."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(spec, r"\\.", ""), '"[^"]*"', "s"), r"\s+", "")
    marks = F.split(F.regexp_replace(F.regexp_replace(bare, r"\{\}|\[\]", ""), r"[^\[\]{}]+", ""), "")
    step = lambda a, c: F.when(c.isin("{", "["), F.struct((a["now"] + 1).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))).when(c.isin("}", "]"), F.struct((a["now"] - 1).alias("now"), a["most"].alias("most"))).otherwise(a)
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def nodes(specs: DataFrame, key: str, spec: str, most_levels: int = 32) -> DataFrame:
    """(key, path, name, leaf, value): all values of the trees below the root; places in lists are written [*]; ``value`` is JSON text.

    ``leaf`` holds for scalars and for empty lists and objects. A tree of more than ``most_levels`` levels is an error. Specifications are shuffled by their key,
    and walked where they are in one pass: at each level what holds something stays as it is and is opened beside it.
    """
    spark, valid = specs.sparkSession, specs.where(F.try_parse_json(spec).isNotNull())
    levels = valid.agg(F.coalesce(F.max(depth(F.col(spec))), F.lit(0))).first()[0]
    if levels >= most_levels:
        raise ValueError(f"a specification has more than {most_levels} levels")
    walked = specs.select(key, spec).repartition(key).select(key, F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(spec).alias("v"), F.lit(True).alias("fresh")).where("v is not null")
    for _ in range(levels):
        kind = F.schema_of_variant("v")
        holder = F.col("fresh") & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        twice = walked.withColumn("_open", F.explode(F.when(holder, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        opened = spark.sql("SELECT t.*, x.key AS _step, x.value AS _v FROM {twice} t, LATERAL variant_explode_outer(CASE WHEN t._open THEN t.v END) x", twice=twice).where("not _open or _v is not null")
        step = F.when(F.col("_step").isNull(), "[*]").otherwise(F.concat(F.lit("."), F.col("_step")))
        below = lambda new, old: F.when(F.col("_open"), new).otherwise(F.col(old)).alias(old)
        walked = opened.select(key, below(F.concat("path", step), "path"), below(F.coalesce("_step", "name"), "name"), below(F.col("_v"), "v"), F.col("_open").alias("fresh"))
    kind, text = F.schema_of_variant("v"), F.to_json("v")
    holder = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~text.isin("{}", "[]")
    return walked.where("path <> '$'").select(key, "path", "name", (~holder).alias("leaf"), text.alias("value"))


def items(tree: DataFrame, key: str, item: Column, where: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(key, item, w): the items of each specification with their summed weights."""
    chosen = tree.where(where) if where is not None else tree
    return chosen.select(key, item.alias("item"), (weight if weight is not None else F.lit(1.0)).alias("w")).where("w > 0").groupBy(key, "item").agg(F.sum("w").alias("w"))


def path_item() -> Column:
    return F.concat_ws("=", "path", "value")


def key_value_item() -> Column:
    return F.concat_ws("=", "name", "value")


def f_beta(keys: DataFrame, key: str, reference: DataFrame, guess: DataFrame, beta: float = 1.0) -> DataFrame:
    """(key, precision, recall, f, jaccard) of every key: shared weight by the guess's, by the reference's, and shared items by all items.

    A guess without items has precision 1, a reference without items recall 1; two of them have no Jaccard similarity (null).
    """
    side = lambda df, r, g: df.select(key, "item", r.cast("double").alias("r"), g.cast("double").alias("g"))
    either = side(reference, F.col("w"), F.lit(None)).unionByName(side(guess, F.lit(None), F.col("w")))
    both = either.groupBy(key, "item").agg(F.sum("r").alias("r"), F.sum("g").alias("g"))
    sums = both.groupBy(key).agg(
        F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum(F.least(F.coalesce("r", F.lit(0.0)), F.coalesce("g", F.lit(0.0)))).alias("both"),
        F.count_if(F.col("r").isNotNull() & F.col("g").isNotNull()).alias("shared"), F.count("*").alias("all"),
    )
    met = keys.select(key).distinct().join(sums, key, "left")
    precision, recall = (F.coalesce(F.col("both") / F.when(F.col(c) > 0, F.col(c)), F.lit(1.0)) for c in ("g", "r"))
    f = F.when(precision + recall > 0, (1 + beta * beta) * precision * recall / (beta * beta * precision + recall)).otherwise(0.0)
    return met.select(key, precision.alias("precision"), recall.alias("recall"), f.alias("f"), (F.col("shared") / F.when(F.col("all") > 0, F.col("all"))).alias("jaccard"))


#: Weights of the parts of an encoding, and of the criteria of a picture.
HALF = ["type", "timeUnit"]
PICTURE = {"visualization_type": 1.0, "data_encoding": 2.0, "data_transformation": 1.0, "aesthetics": 0.75, "prompt_compliance": 1.5}


def encoding_scores(keys: DataFrame, key: str, reference: DataFrame, guess: DataFrame, beta: float = 2.0) -> DataFrame:
    """(key, f): F-beta of the encodings' parts, where types and time units weigh half; x and y of the guess may be swapped."""
    inside, weight = F.col("leaf") & F.col("path").startswith("$.encoding."), F.when(F.col("name").isin(HALF), 0.5).otherwise(1.0)
    as_is = items(reference, key, path_item(), inside, weight)
    swapped = F.when(F.col("path").startswith("$.encoding.x."), F.regexp_replace("path", r"^\$\.encoding\.x\.", r"\$.encoding.y.")).when(F.col("path").startswith("$.encoding.y."), F.regexp_replace("path", r"^\$\.encoding\.y\.", r"\$.encoding.x.")).otherwise(F.col("path"))
    scores = [f_beta(keys, key, as_is, items(guess, key, i, inside, weight), beta).select(key, "f") for i in (path_item(), F.concat_ws("=", swapped, "value"))]
    return scores[0].unionByName(scores[1]).groupBy(key).agg(F.max("f").alias("f"))


def mark_scores(keys: DataFrame, key: str, reference: DataFrame, guess: DataFrame) -> DataFrame:
    """(key, f): mean of the F1 of the marks as they are and with circles and squares as points."""
    mark = F.col("leaf") & F.col("path").rlike(r"^(\$|.*\.)(\.)?mark(\.type)?$")
    loose = F.when(F.col("value").isin('"circle"', '"square"'), '"point"').otherwise(F.col("value"))
    scores = [f_beta(keys, key, items(reference, key, i, mark), items(guess, key, i, mark)).select(key, "f") for i in (F.col("value"), loose)]
    return scores[0].unionByName(scores[1]).groupBy(key).agg(F.avg("f").alias("f"))


def picture_score(blank: Column, **criteria: Column) -> Column:
    """Weighted share of the criteria (0, 1 or 2 each, beyond is cut); a blank picture is divided by a thousand more. Six places."""
    total = sum(PICTURE.values())
    said = sum((F.greatest(F.lit(0), F.least(F.lit(2), criteria[c])) / 2 * w for c, w in PICTURE.items()), F.lit(0.0))
    return F.round(said / F.when(blank, total + 1000).otherwise(total), 6)


# Marks and other words for them that a request may use.
MARK_WORDS = [
    "bar", "circle", "square", "tick", "line", "area", "point", "geoshape", "rule", "text", "boxplot", "errorband", "errorbar",
    "donut", "map", "pie", "heatmap", "dot", "array", "scatterplot", "scatter", "histogram", "column", "row", "cluster",
]
#: Weight of what is as it should be, of a blank chart, of the encoding, of a mark that wasn't asked for, and the encoding's loss by a needless transform.
SLIGHT, BLANK, ENCODING, UNASKED_MARK, NEEDLESS = 0.005, 1000.0, 3.0, 0.5, 0.25


def asks_for_mark(request: Column) -> Column:
    """A run of Latin letters in the request is a mark or another word for one, in any case; a null request asks for none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(request, F.lit(""))), F.lit("[a-z]+"), 0)
    return F.arrays_overlap(words, F.array(*map(F.lit, MARK_WORDS)))


def composite_score(guess: Column, request: Column, drawable: Column, valid: Column, blank: Column, f: dict[str, Column], transforms: dict[str, Column]) -> Column:
    """Weighted mean of a specification's parts, to six places: 0 if it is missing or can't be drawn.

    ``f`` has the scores of encoding, mark and transform, ``transforms`` the numbers of transforms of the reference and the guess. What is in order weighs next to nothing,
    an invalid schema as much as a part, a blank chart more than all parts together. Null conditions don't hold, null scores and numbers are zero.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    needless = none(transforms["reference"]) & ~none(transforms["guess"])
    unused = none(transforms["reference"]) & none(transforms["guess"])
    score = {k: F.coalesce(c, F.lit(0.0)) for k, c in f.items()}
    parts = [  # (weight, share of it that is reached)
        (F.lit(SLIGHT), F.lit(1.0)),
        (F.when(yes(valid), SLIGHT).otherwise(1.0), yes(valid).cast("double")),
        (F.when(yes(blank), BLANK).otherwise(SLIGHT), (~yes(blank)).cast("double")),
        (F.when(needless, ENCODING * (1 - NEEDLESS)).otherwise(ENCODING), score["encoding"]),
        (F.when(asks_for_mark(request), 1.0).otherwise(UNASKED_MARK), score["mark"]),
        (F.when(unused, SLIGHT).otherwise(1.0), F.when(unused, 1.0).when(needless, 0.0).otherwise(score["transform"])),
    ]
    reached, whole = (sum(x[1:], x[0]) for x in ([w * share for w, share in parts], [w for w, _ in parts]))
    return F.round(F.when(yes(drawable) & ~F.coalesce(F.trim(guess), F.lit("")).isin("", "{}", "null"), reached / whole).otherwise(0.0), 6)
