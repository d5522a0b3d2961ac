"""Vega-Lite specifications over one table, as lazy DataFrame plans.

``view(spec, df)`` applies ``transform`` in order and then the encoding: its bins, time units and aggregates, grouped by every other field.
Nulls are left out of every aggregate but ``count``, ``missing`` and ``distinct`` (where null is a value); quartiles interpolate linearly.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.operators import smoothing
from chartmill.operators.quantiles import exact

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "count": lambda c: F.count("*"),
    "valid": lambda c: F.count(c),
    "missing": lambda c: F.count_if(F.col(c).isNull()),
    "distinct": lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int")),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "median": lambda c: F.percentile(c, 0.5),
    "q1": lambda c: F.percentile(c, 0.25),
    "q3": lambda c: F.percentile(c, 0.75),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "stdev": lambda c: F.stddev_samp(c),
    "variance": lambda c: F.var_samp(c),
    "stderr": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "ci0": lambda c: F.avg(c) - 1.96 * F.stddev_samp(c) / F.sqrt(F.count(c)),
    "ci1": lambda c: F.avg(c) + 1.96 * F.stddev_samp(c) / F.sqrt(F.count(c)),
}
#: Shares of the rows; their values are computed apart, except in windows and pivots.
QUANTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}
AGGREGATES |= {"average": AGGREGATES["mean"], "avg": AGGREGATES["mean"]}

_FIXED = "2012-01-01 00:00:00"


def time_unit(unit: str, c: Column) -> Column:
    """The timestamp with the parts that the unit doesn't name fixed (2012-01-01 where there is no year); ``day`` is 0 for Sunday."""
    whole = {"year": "year", "yearquarter": "quarter", "yearmonth": "month", "yearmonthdate": "day"}
    if unit in whole:
        return F.date_trunc(whole[unit], c)
    start = F.lit(_FIXED).cast("timestamp_ltz")
    if unit == "day":
        return F.dayofweek(c) - 1
    if unit == "quarter":
        return F.make_timestamp(F.lit(2012), F.quarter(c) * 3 - 2, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    parts = {"month": (F.month(c), 1), "date": (1, F.dayofmonth(c)), "monthdate": (F.month(c), F.dayofmonth(c))}
    if unit in parts:
        month, day = (F.lit(x) if isinstance(x, int) else x for x in parts[unit])
        return F.make_timestamp(F.lit(2012), month, day, F.lit(0), F.lit(0), F.lit(0))
    seconds = {"hours": F.hour(c) * 3600, "minutes": F.minute(c) * 60, "seconds": F.second(c), "hoursminutes": F.hour(c) * 3600 + F.minute(c) * 60}
    seconds["hoursminutesseconds"] = seconds["hoursminutes"] + F.second(c)
    if unit not in seconds:
        raise ValueError(f"unknown time unit {unit!r}")
    return F.timestamp_seconds(F.unix_timestamp(start) + seconds[unit])


def bin_step(low: float, high: float, maxbins: int = 10) -> tuple[float, float]:
    """First edge and step of nice bins."""
    span = (high - low) or 1.0
    level = math.ceil(math.log(maxbins) / math.log(10))
    step = 10.0 ** (round(math.log(span) / math.log(10)) - level)
    while math.ceil(span / step) > maxbins:
        step *= 10
    for part in (5, 2):
        if span / (step / part) <= maxbins:
            step /= part
    return math.floor(low / step) * step, step


def bins(df: DataFrame, field: str, maxbins: int = 10) -> Column:
    """Lower edge of a value's bin; the greatest value falls into the last bin."""
    low, high = df.agg(F.min(field).cast("double"), F.max(field).cast("double")).first()
    if low is None:
        return F.lit(None).cast("double")
    start, step = bin_step(low, high, maxbins)
    last = max(0, math.ceil((high - start) / step) - 1)
    return F.least(F.floor((F.col(field) - start) / step), F.lit(last)) * step + start


def predicate(p: str | dict) -> Column:
    if isinstance(p, str):
        return expression(p)
    if "and" in p or "or" in p:
        out = None
        for x in p.get("and", p.get("or")):
            out = predicate(x) if out is None else (out & predicate(x) if "and" in p else out | predicate(x))
        return out
    if "not" in p:
        return ~predicate(p["not"])
    c = time_unit(p["timeUnit"], F.col(p["field"])) if "timeUnit" in p else F.col(p["field"])
    tests = {
        "equal": lambda v: c == v,
        "lt": lambda v: c < v,
        "lte": lambda v: c <= v,
        "gt": lambda v: c > v,
        "gte": lambda v: c >= v,
        "range": lambda v: (F.lit(True) if v[0] is None else c >= v[0]) & (F.lit(True) if v[1] is None else c <= v[1]),
        "oneOf": lambda v: c.isin(v),
        "valid": lambda v: c.isNotNull() if v else c.isNull(),
    }
    (name,) = tests.keys() & p.keys()
    return tests[name](p[name])


def expression(text: str) -> Column:
    """An expression over ``datum.field``; operators as in the specification."""
    for a, b in (("===", "="), ("!==", "<>"), ("==", "="), ("!=", "<>"), ("&&", " and "), ("||", " or ")):
        text = text.replace(a, b)
    return F.expr(re.sub(r"datum\.(\w+)", r"`\1`", re.sub(r"datum\['([^']+)'\]", r"`\1`", text)))


def _order(sort: list[dict]) -> list[Column]:
    return [F.desc(s["field"]) if s.get("order") == "descending" else F.asc(s["field"]) for s in sort]


def _window(df: DataFrame, t: dict) -> DataFrame:
    base = Window.partitionBy(*t.get("groupby", [])).orderBy(*(_order(t["sort"]) if t.get("sort") else [F.lit(0)]))
    low, high = t.get("frame", [None, 0])
    rows = base.rowsBetween(Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high)
    if low is None and high == 0 and not t.get("ignorePeers"):
        rows = base.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # rows that tie are peers and share the frame
    plain = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
    for w in t["window"]:
        op, field, k = w["op"], w.get("field"), w.get("param") or 1
        if op in plain:
            out = plain[op]().over(base)
            out = out if op in ("percent_rank", "cume_dist") else out.cast("long")
        elif op in ("lag", "lead"):
            out = (F.lag if op == "lag" else F.lead)(field, k).over(base)
        elif op == "ntile":
            out = F.ntile(k).over(base).cast("long")
        elif op in ("first_value", "last_value"):
            out = (F.first if op == "first_value" else F.last)(field).over(rows)
        elif op == "nth_value":
            out = F.nth_value(field, k).over(rows)
        else:
            out = AGGREGATES[op](field).over(rows)
        df = df.withColumn(w["as"], out)
    return df


def _impute(df: DataFrame, t: dict) -> DataFrame:
    """A row for every key of the domain in every group; the domain and the groups are distinct values, joined key by key."""
    key, field, groups = t["key"], t["impute"], t.get("groupby", [])
    method = t.get("method", "value")
    domain = df.select(key).distinct().where(F.col(key).isNotNull())
    if t.get("keyvals"):
        domain = domain.unionByName(df.sparkSession.createDataFrame([(k,) for k in t["keyvals"]], domain.schema)).distinct()
    full = df.select(*groups).distinct().join(domain) if groups else domain
    out = full.join(df, [*groups, key], "left")
    fill = F.lit(t.get("value")) if method == "value" else AGGREGATES[method](field).over(Window.partitionBy(*groups))
    return out.withColumn(field, F.coalesce(field, fill))


def _stack(df: DataFrame, t: dict) -> DataFrame:
    part = Window.partitionBy(*t["groupby"])
    run = part.orderBy(*_order(t["sort"])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    field, (y0, y1) = t["stack"], t["as"]
    end, total = F.sum(field).over(run), F.sum(field).over(part)
    shift = -total / 2 if t.get("offset") == "center" else F.lit(0)
    scale = total if t.get("offset") == "normalize" else F.lit(1)
    return df.withColumn(y0, (end - F.col(field) + shift) / scale).withColumn(y1, (end + shift) / scale)


def _power_fit(sums: list[float], moments: list[float], n: int) -> list[float] | None:
    """Least squares from the 2 * order + 1 power sums of x and the order + 1 sums of y x^i, about the means of x; null if the fit has no answer."""
    import numpy as np

    size = len(moments)
    if n < size or None in sums or None in moments:
        return None
    normal = np.array([[sums[i + j] for j in range(size)] for i in range(size)])
    if np.linalg.matrix_rank(normal) < size:
        return None
    return np.linalg.solve(normal, np.array(moments)).tolist()


def _polynomial(df: DataFrame, t: dict) -> DataFrame:
    """Coefficients, lowest power first, of a polynomial fit per group: rows become power sums in the JVM, and a row per group is solved.

    x is centred on the table's mean and divided by its greatest distance from it, so that high powers stay of one size and groups are reduced
    before the shuffle without a join; the coefficients are those of x itself. Groups with fewer different x than coefficients get null."""
    groups, order = t.get("groupby", []), t.get("order", 3)
    rows = df.select(*groups, F.col(t["on"]).cast("double").alias("_x"), F.col(t["regression"]).cast("double").alias("_y")).where("_x is not null and _y is not null")
    mean, low, high = rows.agg(F.avg("_x"), F.min("_x"), F.max("_x")).first()
    wide = 1.0 if mean is None else max(high - mean, mean - low) or 1.0
    mean = mean or 0.0
    z = (F.col("_x") - mean) / wide
    power = lambda i: F.lit(1.0) if i == 0 else F.pow(z, F.lit(i))
    fit = rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.array(*(F.sum(power(i)) for i in range(2 * order + 1))).alias("_s"), F.array(*(F.sum(F.col("_y") * power(i)) for i in range(order + 1))).alias("_t")
    )

    @F.pandas_udf("array<double>")
    def solved(s: pd.Series, t: pd.Series, n: pd.Series) -> pd.Series:
        from numpy.polynomial import Polynomial

        out = []
        for sums, moments, count in zip(s, t, n, strict=True):
            own = _power_fit(list(sums), list(moments), count)
            full = own and Polynomial(own)(Polynomial([-mean / wide, 1 / wide])).coef.tolist()
            out.append(full and full + [0.0] * (order + 1 - len(full)))
        return pd.Series(out)

    return fit.select(*groups, solved("_s", "_t", "n").alias("coef"))


def _regression(df: DataFrame, t: dict) -> DataFrame:
    if t.get("method") in ("poly", "quad"):
        return _polynomial(df, {**t, "order": 2} if t["method"] == "quad" else t)
    x, y = F.col(t["on"]), F.col(t["regression"])
    method = t.get("method", "linear")
    fx = F.ln(x) if method in ("log", "pow") else x
    fy = F.ln(y) if method in ("exp", "pow") else y
    rows = df.select(*t.get("groupby", []), fx.alias("_x"), fy.alias("_y")).where("_x is not null and _y is not null")
    fit = rows.groupBy(*t.get("groupby", [])).agg(
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("rSquared")
    )
    return fit.withColumn("intercept", F.exp("intercept")) if method in ("exp", "pow") else fit


def _aggregated(df: DataFrame, groups: list[str], measures: list[tuple[str, str | None, str]]) -> DataFrame:
    """``groups`` and the measures (op, field, name) in their order; quantiles come from :mod:`.quantiles`."""
    apart = [(name, F.col(field), QUANTILES[op]) for op, field, name in measures if op in QUANTILES]
    plain = [AGGREGATES[op](field).alias(name) for op, field, name in measures if op not in QUANTILES]
    if not apart:
        return df.groupBy(*groups).agg(*plain)
    found = exact(df, groups, apart)
    if plain:
        left, right = df.groupBy(*groups).agg(*plain), found.toDF(*(f"_{g}" for g in groups), *(name for name, _, _ in apart))
        same = F.lit(True)
        for g in groups:
            same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
        found = left.join(right, same)
    return found.select(*groups, *(name for _, _, name in measures))


def transform(df: DataFrame, t: dict, tables: dict[str, DataFrame]) -> DataFrame:
    if "filter" in t:
        return df.where(predicate(t["filter"]))
    if "calculate" in t:
        return df.withColumn(t["as"], expression(t["calculate"]))
    if "timeUnit" in t:
        return df.withColumn(t["as"], time_unit(t["timeUnit"], F.col(t["field"])))
    if "bin" in t:
        return df.withColumn(t["as"], bins(df, t["field"], t["bin"].get("maxbins", 10) if isinstance(t["bin"], dict) else 10))
    if "aggregate" in t:
        return _aggregated(df, t.get("groupby", []), [(a["op"], a.get("field"), a["as"]) for a in t["aggregate"]])
    if "joinaggregate" in t:
        part = Window.partitionBy(*t.get("groupby", []))
        return df.withColumns({a["as"]: AGGREGATES[a["op"]](a.get("field")).over(part) for a in t["joinaggregate"]})
    if "window" in t:
        return _window(df, t)
    if "lookup" in t:
        source = t["from"]
        given = tables[source["data"]].withColumn("_at", F.monotonically_increasing_id())  # the first row of a key, in the table's order
        firsts = given.groupBy(F.col(source["key"]).alias(t["lookup"])).agg(F.min_by(F.struct(*source["fields"]), "_at").alias("_first"))
        right = firsts.select(t["lookup"], *(F.col("_first")[c].alias(c) for c in source["fields"]))
        out = df.join(right, t["lookup"], "left")
        return out.fillna(t["default"], source["fields"]) if "default" in t else out
    if "fold" in t:
        key, value = t.get("as", ["key", "value"])
        return df.unpivot([c for c in df.columns if c not in t["fold"]], t["fold"], key, value)
    if "pivot" in t:
        kinds = df.select(t["pivot"]).distinct().orderBy(t["pivot"])
        values = [r[0] for r in (kinds.limit(t["limit"]) if t.get("limit") else kinds).collect()]  # they become columns
        return df.groupBy(*t.get("groupby", [])).pivot(t["pivot"], values).agg(AGGREGATES[t.get("op", "sum")](t["value"]))
    if "flatten" in t:
        zipped = F.explode(F.arrays_zip(*t["flatten"])).alias("_x")
        rest = [c for c in df.columns if c not in t["flatten"]]
        return df.select(*rest, zipped).select(*rest, *(F.col("_x")[c].alias(n) for c, n in zip(t["flatten"], t.get("as", t["flatten"]), strict=True)))
    if "impute" in t:
        return _impute(df, t)
    if "stack" in t:
        return _stack(df, t)
    if "quantile" in t:
        probs = t.get("probs") or [(i + 0.5) * t.get("step", 0.01) for i in range(round(1 / t.get("step", 0.01)))]
        out = df.groupBy(*t.get("groupby", [])).agg(F.percentile(t["quantile"], probs).alias("_q"))
        return out.select(*t.get("groupby", []), F.posexplode("_q").alias("_i", "value")).select(*t.get("groupby", []), F.array(*map(F.lit, probs))[F.col("_i")].alias("prob"), "value")
    if "sample" in t:
        return df.orderBy(F.xxhash64(*df.columns)).limit(t["sample"])
    if "density" in t:
        return _density(df, t)
    if "loess" in t:
        return smoothing.loess(df, t["on"], t["loess"], t.get("groupby", []), t["neighbours"])
    if "extent" in t:
        return df.agg(F.min(t["extent"]).alias("min"), F.max(t["extent"]).alias("max"))
    if "regression" in t:
        return _regression(df, t)
    raise ValueError(f"unknown transform {sorted(t)}")


def _density(df: DataFrame, t: dict) -> DataFrame:
    """Gaussian kernel density on an even grid; every value adds to each of the ``steps`` places, summed before the shuffle."""
    low, high = t["extent"]
    steps, width = t.get("steps", 25), t["bandwidth"]
    grid = F.explode(F.array(*(F.lit(low + (high - low) * i / steps) for i in range(steps + 1))))
    near = df.where(F.col(t["density"]).isNotNull()).select(*t.get("groupby", []), F.col(t["density"]).alias("_v"), grid.alias("value"))
    kernel = F.exp(-0.5 * F.pow((F.col("value") - F.col("_v")) / width, 2)) / (width * math.sqrt(2 * math.pi))
    return near.groupBy(*t.get("groupby", []), "value").agg(F.avg(kernel).alias("density"))


def encode(df: DataFrame, encoding: dict[str, dict]) -> DataFrame:
    """Groups by every field without an aggregate; names are ``op_field``, ``unit_field`` and ``bin_field``."""
    keys, measures, order = {}, {}, []
    for c in encoding.values():
        field = c.get("field")
        if "aggregate" in c:
            name = c["aggregate"] if c["aggregate"] == "count" else f"{c['aggregate']}_{field}"
            measures[name] = AGGREGATES[c["aggregate"]](field)
        elif field is None:
            continue
        elif "timeUnit" in c:
            name = f"{c['timeUnit']}_{field}"
            keys[name] = time_unit(c["timeUnit"], F.col(field))
        elif c.get("bin"):
            name = f"bin_{field}"
            keys[name] = bins(df, field, c["bin"].get("maxbins", 10) if isinstance(c["bin"], dict) else 10)
        else:
            name = field
            keys[name] = F.col(field)
        if c.get("sort") in ("ascending", "descending"):
            order.append(F.desc(name) if c["sort"] == "descending" else F.asc(name))
    named = [c.alias(n) for n, c in keys.items()]
    out = df.groupBy(*named).agg(*(c.alias(n) for n, c in measures.items())) if measures else df.select(*named)
    return out.orderBy(*order) if order else out


def view(spec: dict, df: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    for t in spec.get("transform", []):
        df = transform(df, t, tables or {})
    return encode(df, spec["encoding"]) if spec.get("encoding") else df


def repeat(spec: dict, fields: list[str], df: DataFrame) -> DataFrame:
    """The view once for each field, named in ``repeat``; the specification says ``{"repeat": true}`` in place of the field."""
    out = None
    for f in fields:
        own = {k: ({**c, "field": "value"} if isinstance(c.get("field"), dict) else c) for k, c in spec["encoding"].items()}
        one = view({**spec, "encoding": own}, df.withColumn("value", F.col(f).cast("double"))).withColumn("repeat", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def box_plot(df: DataFrame, field: str, groups: list[str]) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 interquartile ranges) and the number of outliers."""
    q = df.groupBy(*groups).agg(F.percentile(field, [0.25, 0.5, 0.75]).alias("q"))
    joined = df.where(F.col(field).isNotNull()).join(q, groups)
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(field).between(F.col("q")[0] - reach, F.col("q")[2] + reach)
    return joined.groupBy(*groups).agg(
        F.any_value(F.col("q")[0]).alias("q1"), F.any_value(F.col("q")[1]).alias("median"), F.any_value(F.col("q")[2]).alias("q3"),
        F.min(F.when(inside, F.col(field))).alias("low"), F.max(F.when(inside, F.col(field))).alias("high"), F.count_if(~inside).alias("outliers"),
    )


def error_bar(df: DataFrame, field: str, groups: list[str], extent: str = "stderr") -> DataFrame:
    """``center``, ``lower`` and ``upper`` of a group: mean and the standard error, deviation or normal 95 % interval, or median and quartiles (``iqr``)."""
    if extent == "iqr":
        q = df.groupBy(*groups).agg(F.percentile(field, [0.5, 0.25, 0.75]).alias("q"))
        return q.select(*groups, *(F.col("q")[i].alias(c) for i, c in enumerate(("center", "lower", "upper"))))
    reach = {"stdev": F.stddev_samp(field), "stderr": AGGREGATES["stderr"](field), "ci": 1.96 * AGGREGATES["stderr"](field)}[extent]
    return df.groupBy(*groups).agg(F.avg(field).alias("center"), (F.avg(field) - reach).alias("lower"), (F.avg(field) + reach).alias("upper"))


def top(df: DataFrame, k: int, sort: list[dict]) -> DataFrame:
    """The first ``k`` rows in the order of ``sort``; rows that tie come in the order of all columns, so the answer is one."""
    rest = [F.asc(c) for c in df.columns if c not in {s["field"] for s in sort}]
    return df.orderBy(*_order(sort), *rest).limit(k)


def flat(spec: dict) -> list[dict]:
    """The views of ``layer``, ``concat``, ``hconcat`` or ``vconcat``, nested ones in order; transforms and encodings of the outer specification
    hold for the inner ones, and a facet's fields (``row``, ``column``, ``facet``) are keys of its view like any other channel."""
    kinds = [k for k in ("layer", "concat", "hconcat", "vconcat") if k in spec]
    if not kinds:
        return [spec]
    shared = {"transform": spec.get("transform", []), "encoding": spec.get("encoding", {})}
    out = []
    for inner in (x for k in kinds for x in spec[k]):
        own = {**inner, "transform": [*shared["transform"], *inner.get("transform", [])], "encoding": {**shared["encoding"], **inner.get("encoding", {})}}
        out += flat(own)
    return out


def layers(spec: dict, df: DataFrame, tables: dict[str, DataFrame] | None = None) -> list[DataFrame]:
    """One plan for each view of ``flat``."""
    return [view(s, df, tables) for s in flat(spec)]
