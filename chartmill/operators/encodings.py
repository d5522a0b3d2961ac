"""Views, encodings and transforms of chart specifications, and the best-first matching of two specifications' encodings.

A specification is walked once, by a small function over its parsed tree, which carries down what holds for everything below: the transforms of
outer levels, and the facets. What it finds are arrays of the specification's own row, and matching is a fold over the pairs of one row, so comparing
two tables of specifications takes their join and no other shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chartmill.operators.lineage import spread

ENCODING = "view int, channel string, field string, type string, aggregate string, bin string, time_unit string"
TRANSFORM = "view int, kind string, field string, op string, as_field string, groupby array<string>, signature string"
VIEW = "view int, mark string"

#: Keys that hold views side by side, in the order in which they are read; channels that stand for a facet; kinds of transforms.
SIDE_BY_SIDE = ("layer", "concat", "hconcat", "vconcat")
FACETS = ("row", "column", "facet")
KINDS = ("filter", "calculate", "lookup", "window", "fold", "pivot", "impute", "density", "loess", "regression")
#: The shares of an encoding's parts in its similarity, in hundredths, and that of an exchanged x and y in the channel's.
SHARES = {"channel": 25, "field": 35, "type": 15, "aggregate": 10, "bin": 10, "time_unit": 5}
EXCHANGED = 85


def stable(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def word(value) -> str:
    """A value as text: nothing for null, false, 0 and empty ones, JSON for lists and objects."""
    return "" if not value else value if isinstance(value, str) else stable(value)


def definitions(channel) -> Iterator[dict]:
    """Field definitions of a channel: its own, those of its list, and those of its conditions."""
    waiting = [channel]
    while waiting:
        value = waiting.pop(0)
        if isinstance(value, list):
            waiting[:0] = value
        elif isinstance(value, dict):
            if "field" in value or value.get("aggregate") == "count":
                yield value
            waiting[:0] = [value["condition"]] if isinstance(value.get("condition"), (dict, list)) else []


def encoding_of(channel: str, said: dict) -> dict:
    aggregate, channel, bins = word(said.get("aggregate")).strip().lower(), channel.strip().lower(), said.get("bin")
    aggregate = "mean" if aggregate in ("avg", "average") else aggregate
    return {
        "channel": "facet" if channel in FACETS else channel,
        "field": "*" if aggregate == "count" and not said.get("field") else word(said.get("field")).strip(),
        "type": word(said.get("type")).strip().lower(),
        "aggregate": aggregate,
        "bin": "" if bins is None or bins is False else "true" if bins is True else stable(bins),
        "time_unit": word(said.get("timeUnit") or said.get("timeunit")).strip().lower(),
    }


def first_field(value) -> str:
    """The first text under a key ``field``, outer ones first."""
    if isinstance(value, dict) and isinstance(value.get("field"), str):
        return value["field"]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return next((found for found in map(first_field, inner) if found), "")


def transform_of(kind: str, field: str = "", op: str = "", as_field: str = "", groupby=None, signature: str = "") -> dict:
    names = sorted(g for g in groupby if isinstance(g, str)) if isinstance(groupby, list) else []
    return {"kind": kind, "field": field, "op": op, "as_field": as_field, "groupby": names, "signature": signature}


def transforms_of(said: dict) -> list[dict]:
    summed = next((k for k in ("aggregate", "joinaggregate") if k in said), None)
    if summed:
        each = [i for i in said[summed] or [] if isinstance(i, dict)] if isinstance(said[summed], list) else []
        return [transform_of(summed, word(i.get("field")) or "*", word(i.get("op")), word(i.get("as")), said.get("groupby")) for i in each]
    for key in ("bin", "timeUnit", "timeunit"):
        if key in said:
            return [transform_of("bin" if key == "bin" else "timeUnit", word(said.get("field")), stable(said[key]), word(said.get("as")))]
    kind = next((k for k in KINDS if k in said), "unknown")
    return [transform_of(kind, first_field(said), "", word(said.get("as")), said.get("groupby") if kind != "unknown" else None, stable(said))]


def views(spec, outer: tuple = (), facets: tuple = ()) -> Iterator[tuple[str, list[dict], list[dict]]]:
    """(mark, encodings, transforms) of each view. ``outer``: transforms of the levels above; ``facets``: their encodings.

    A view that is repeated by a facet is found as it is, and again with the facet's encodings.
    """
    if not isinstance(spec, dict):
        return
    own = spec.get("transform") if isinstance(spec.get("transform"), list) else []
    given = (*outer, *(t for said in own if isinstance(said, dict) for t in transforms_of(said)))
    if "mark" in spec or "encoding" in spec:
        channels = spec["encoding"].items() if isinstance(spec.get("encoding"), dict) else ()
        found = [e for channel, said in channels for e in (encoding_of(channel, d) for d in definitions(said)) if e["field"] or e["aggregate"] == "count"]
        inline = [transform_of(kind, e["field"], e[part], e["field"]) for e in found for part, kind in (("aggregate", "aggregate"), ("bin", "bin"), ("time_unit", "timeUnit")) if e[part]]
        mark = spec.get("mark")
        yield word(mark.get("type") if isinstance(mark, dict) else mark), [*found, *facets], [*given, *inline]
    for inner in [c for key in SIDE_BY_SIDE if isinstance(spec.get(key), list) for c in spec[key]] + [spec[key] for key in ("spec", "child") if isinstance(spec.get(key), dict)]:
        yield from views(inner, given, facets)
    facet = spec.get("facet")
    if isinstance(facet, dict) and "spec" in spec:
        said = {c: facet.get(c, facet if "field" in facet and c not in facet else None) for c in FACETS}
        yield from views(spec["spec"], given, (*(encoding_of(c, s) for c, s in said.items() if isinstance(s, dict)), *facets))


def extracted(specs: DataFrame, spec: str) -> DataFrame:
    """``specs`` with the arrays ``views``, ``encodings`` and ``transforms`` in the place of the specification (JSON text).

    What isn't a JSON object has none of them. A specification without views has one view without mark, with the transforms of its root.
    """
    kept = StructType([f for f in specs.schema.fields if f.name not in (spec, "views", "encodings", "transforms")])
    schema = StructType(kept.fields + StructType.fromDDL(f"views array<struct<{_colons(VIEW)}>>, encodings array<struct<{_colons(ENCODING)}>>, transforms array<struct<{_colons(TRANSFORM)}>>").fields)

    def read(text):
        try:
            tree = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            tree = None
        if not isinstance(tree, dict):
            return []
        own = [t for said in tree.get("transform") or [] if isinstance(said, dict) for t in transforms_of(said)] if isinstance(tree.get("transform"), list) else []
        return list(views(tree)) or [("", [], own)]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            found = [read(t) for t in batch.column(spec).to_pylist()]
            made = {
                "views": [[{"view": k, "mark": v[0]} for k, v in enumerate(vs)] for vs in found],
                "encodings": [[{"view": k, **e} for k, v in enumerate(vs) for e in v[1]] for vs in found],
                "transforms": [[{"view": k, **t} for k, v in enumerate(vs) for t in v[2]] for vs in found],
            }
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept.fields] + [pa.array(v, kinds.field(n).type) for n, v in made.items()], [f.name for f in schema.fields])

    return specs.mapInArrow(run, schema)


def _colons(ddl: str) -> str:
    return ", ".join(": ".join(part.split(" ", 1)) for part in ddl.split(", "))


def same_text(a: Column, b: Column) -> Column:
    return F.when(a == b, 100).otherwise(0)


def similarity(guess: Column, reference: Column, exchange: bool = False) -> Column:
    """Similarity of two encodings in ten-thousandths; with ``exchange`` the guess's x and y change places first."""
    channel = _exchanged(guess["channel"]) if exchange else guess["channel"]
    swapped = (_exchanged(channel) == reference["channel"]) & (channel != reference["channel"])
    near = F.when(channel == reference["channel"], 100).when(swapped, EXCHANGED).otherwise(0)
    return sum((same_text(guess[c], reference[c]) * w for c, w in SHARES.items() if c != "channel"), near * SHARES["channel"])


def _exchanged(channel: Column) -> Column:
    return F.when(channel == "x", "y").when(channel == "y", "x").otherwise(channel)


def best_first(guess: Column, reference: Column, score) -> Column:
    """Array of (less: minus the score, g, r): the pair of the greatest score first, then of what is left; ties go by the places g and r.

    ``guess`` and ``reference`` are arrays of one row; ``score`` gives a whole number for two elements, 0 for those that don't match.
    """
    pairs = F.flatten(F.transform(guess, lambda a, g: F.transform(reference, lambda b, r: F.struct((-score(a, b)).cast("int").alias("less"), g.alias("g"), r.alias("r")))))
    order = F.array_sort(F.filter(pairs, lambda p: p["less"] < 0))
    none = F.array().cast("array<struct<less:int,g:int,r:int>>")
    free = lambda taken, p: ~F.exists(taken, lambda t: (t["g"] == p["g"]) | (t["r"] == p["r"]))
    return F.aggregate(order, none, lambda taken, p: F.when(free(taken, p), F.concat(taken, F.array(p))).otherwise(taken))


def _f_beta(total: Column, guess: Column, reference: Column, beta: float) -> tuple[Column, Column, Column]:
    """Precision, recall and F: two empty sides are alike, one empty side has nothing in common with the other."""
    none, one = (F.size(guess) == 0) & (F.size(reference) == 0), (F.size(guess) == 0) | (F.size(reference) == 0)
    p, r = (F.when(none, 1.0).when(one, 0.0).otherwise(total / 10_000 / F.greatest(F.size(side), F.lit(1))) for side in (guess, reference))
    return p, r, F.when((p > 0) & (r > 0), (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0)


def matched(guesses: DataFrame, references: DataFrame, key: str, beta: float = 2.0) -> DataFrame:
    """(key, precision, recall, f, exchanged, pairs) of the keys of both sides, which have an array ``encodings`` each.

    The matching with x and y exchanged counts if its F is greater. ``pairs``: places in the arrays and the similarity.
    """
    left, right = (spread(side.select(key, F.coalesce("encodings", F.array()).alias(name)), key) for side, name in ((guesses, "_g"), (references, "_r")))
    both = left.join(right, key)
    for name, exchange in (("plain", False), ("other", True)):
        both = both.withColumn(f"_{name}", best_first(F.col("_g"), F.col("_r"), lambda a, b, e=exchange: similarity(a, b, e)))
        total = F.aggregate(f"_{name}", F.lit(0), lambda s, p: s - p["less"])
        both = both.withColumn(f"_s_{name}", F.struct(*(c.alias(n) for c, n in zip(_f_beta(total, F.col("_g"), F.col("_r"), beta), ("precision", "recall", "f"), strict=True))))
    exchanged = F.col("_s_other.f") > F.col("_s_plain.f")
    best, chosen = F.when(exchanged, F.col("_s_other")).otherwise(F.col("_s_plain")), F.when(exchanged, F.col("_other")).otherwise(F.col("_plain"))
    pairs = F.transform(chosen, lambda p: F.struct(p["g"].alias("g"), p["r"].alias("r"), (-p["less"] / 10_000).alias("similarity")))
    return both.select(key, best["precision"].alias("precision"), best["recall"].alias("recall"), best["f"].alias("f"), exchanged.alias("exchanged"), pairs.alias("pairs"))
