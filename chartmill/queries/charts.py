"""Chart specifications over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.plans import chart

QUERIES: dict = {}
ORACLES: dict = {}


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spec(name: str, table: str, sql: str, encoding: dict | None = None, *transforms: dict, places: tuple[str, ...] = (), tables: tuple[str, ...] = ()):
    """Register a specification with its SQL; the columns ``places`` are rounded to four places in both."""

    def run(spark, sf):
        out = chart.view({"transform": list(transforms), "encoding": encoding}, _read(spark, sf, table), {t: _read(spark, sf, t) for t in tables})
        return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in places})

    QUERIES[name], ORACLES[name] = run, sql


spec("vl_month_mean_by_flag", "lineitem", "SELECT date_trunc('month', l_shipdate) AS yearmonth_l_shipdate, l_returnflag, round(avg(l_extendedprice), 4) AS mean_l_extendedprice FROM lineitem GROUP BY 1, 2",
     {"x": {"timeUnit": "yearmonth", "field": "l_shipdate"}, "color": {"field": "l_returnflag"}, "y": {"aggregate": "mean", "field": "l_extendedprice"}}, places=("mean_l_extendedprice",))
spec("vl_bar_count", "orders", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1", {"x": {"field": "o_orderpriority"}, "y": {"aggregate": "count"}})
spec("vl_aggregate_ops", "lineitem", """SELECT l_returnflag, count(*) AS n, count(l_tax) AS valid, count(*) FILTER (WHERE l_tax IS NULL) AS missing, count(DISTINCT l_quantity) AS kinds,
  round(median(l_extendedprice), 4) AS mid, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, min(l_tax) AS low, max(l_tax) AS high,
  round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS var, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS se,
  round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS ci0, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS ci1
  FROM lineitem GROUP BY 1""", None, {"aggregate": [{"op": "count", "as": "n"}, {"op": "valid", "field": "l_tax", "as": "valid"}, {"op": "missing", "field": "l_tax", "as": "missing"}, {"op": "distinct", "field": "l_quantity", "as": "kinds"},
  {"op": "median", "field": "l_extendedprice", "as": "mid"}, {"op": "q1", "field": "l_extendedprice", "as": "q1"}, {"op": "q3", "field": "l_extendedprice", "as": "q3"}, {"op": "min", "field": "l_tax", "as": "low"}, {"op": "max", "field": "l_tax", "as": "high"},
  {"op": "stdev", "field": "l_quantity", "as": "sd"}, {"op": "variance", "field": "l_quantity", "as": "var"}, {"op": "stderr", "field": "l_quantity", "as": "se"}, {"op": "ci0", "field": "l_quantity", "as": "ci0"}, {"op": "ci1", "field": "l_quantity", "as": "ci1"}],
  "groupby": ["l_returnflag"]}, places=("mid", "q1", "q3", "sd", "var", "se", "ci0", "ci1"))
for _unit, _sql in {
    "year": "date_trunc('year', ts)", "yearquarter": "date_trunc('quarter', ts)", "yearmonthdate": "date_trunc('day', ts)", "quarter": "make_timestamp(2012, CAST(quarter(ts) * 3 - 2 AS BIGINT), 1, 0, 0, 0)",
    "month": "make_timestamp(2012, month(ts), 1, 0, 0, 0)", "date": "make_timestamp(2012, 1, day(ts), 0, 0, 0)", "monthdate": "make_timestamp(2012, month(ts), day(ts), 0, 0, 0)",
    "hours": "make_timestamp(2012, 1, 1, hour(ts), 0, 0)", "minutes": "make_timestamp(2012, 1, 1, 0, minute(ts), 0)", "hoursminutes": "make_timestamp(2012, 1, 1, hour(ts), minute(ts), 0)",
}.items():
    spec(f"vl_timeunit_{_unit}", "events", f"SELECT {_sql} AS {_unit}_ts, count(*) AS count FROM events GROUP BY 1", {"x": {"timeUnit": _unit, "field": "ts"}, "y": {"aggregate": "count"}})
spec("vl_timeunit_day", "events", "SELECT CAST(dayofweek(ts) AS INTEGER) AS day_ts, count(*) AS count FROM events GROUP BY 1", {"x": {"timeUnit": "day", "field": "ts"}, "y": {"aggregate": "count"}})
spec("vl_histogram", "part", "SELECT CAST(least(floor((p_size - 0) / 5.0), 9) * 5.0 AS DOUBLE) AS bin_p_size, count(*) AS count FROM part GROUP BY 1", {"x": {"bin": True, "field": "p_size"}, "y": {"aggregate": "count"}})
spec("vl_filter_predicates", "lineitem", "SELECT l_linestatus, count(*) AS count FROM lineitem WHERE (l_quantity BETWEEN 10 AND 20 OR l_returnflag IN ('R', 'A')) AND NOT l_discount > 0.05 AND l_tax IS NOT NULL GROUP BY 1",
     {"x": {"field": "l_linestatus"}, "y": {"aggregate": "count"}}, {"filter": {"and": [{"or": [{"field": "l_quantity", "range": [10, 20]}, {"field": "l_returnflag", "oneOf": ["R", "A"]}]}, {"not": {"field": "l_discount", "gt": 0.05}}, {"field": "l_tax", "valid": True}]}})
spec("vl_filter_expression", "orders", "SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'P' GROUP BY 1", {"x": {"field": "o_orderstatus"}, "y": {"aggregate": "count"}}, {"filter": "datum.o_totalprice > 100000 && datum.o_orderstatus != 'P'"})
spec("vl_calculate", "lineitem", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net FROM lineitem GROUP BY 1", {"x": {"field": "l_returnflag"}, "y": {"aggregate": "sum", "field": "net"}}, {"calculate": "round(datum.l_extendedprice * (1 - datum.l_discount), 8)", "as": "net"})
spec("vl_joinaggregate", "customer", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS above FROM customer", {"x": {"field": "c_custkey"}, "y": {"field": "above"}},
     {"joinaggregate": [{"op": "mean", "field": "c_acctbal", "as": "m"}], "groupby": ["c_nationkey"]}, {"calculate": "datum.c_acctbal - datum.m", "as": "above"}, places=("above",))
spec("vl_window_ranks", "supplier", """SELECT s_suppkey, row_number() OVER w AS n, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 4) AS p, round(cume_dist() OVER w, 4) AS c, ntile(3) OVER w AS t,
  lag(s_suppkey, 1) OVER w AS before, lead(s_suppkey, 1) OVER w AS after, round(sum(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS run
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""", {x: {"field": x} for x in ("s_suppkey", "n", "r", "d", "p", "c", "t", "before", "after", "run")},
     {"window": [{"op": "row_number", "as": "n"}, {"op": "rank", "as": "r"}, {"op": "dense_rank", "as": "d"}, {"op": "percent_rank", "as": "p"}, {"op": "cume_dist", "as": "c"}, {"op": "ntile", "param": 3, "as": "t"}, {"op": "lag", "field": "s_suppkey", "as": "before"}, {"op": "lead", "field": "s_suppkey", "as": "after"}, {"op": "sum", "field": "s_acctbal", "as": "run"}],
      "groupby": ["s_nationkey"], "sort": [{"field": "s_acctbal"}, {"field": "s_suppkey"}]}, places=("p", "c", "run"))
spec("vl_lookup", "supplier", "SELECT n_name, count(*) AS count FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", {"x": {"field": "n_name"}, "y": {"aggregate": "count"}}, {"lookup": "s_nationkey", "from": {"data": "nation", "key": "n_nationkey", "fields": ["n_name"]}, "default": "none"}, tables=("nation",))
spec("vl_fold", "lineitem", "SELECT key, round(avg(value), 4) AS mean_value FROM (SELECT 'l_discount' AS key, l_discount AS value FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1", {"x": {"field": "key"}, "y": {"aggregate": "mean", "field": "value"}}, {"fold": ["l_discount", "l_tax"]}, places=("mean_value",))
spec("vl_pivot", "orders", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS F, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1", None, {"pivot": "o_orderstatus", "value": "o_totalprice", "groupby": ["o_orderpriority"]}, places=("F", "O", "P"))
spec("vl_flatten", "embeddings", "SELECT label, round(avg(x), 4) AS mean_x FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1", {"x": {"field": "label"}, "y": {"aggregate": "mean", "field": "x"}}, {"flatten": ["embedding"], "as": ["x"]}, {"calculate": "cast(datum.x as double)", "as": "x"}, places=("mean_x",))
spec("vl_impute", "customer", """WITH a AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2)
  SELECT s.c_mktsegment, k.c_nationkey, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT c_mktsegment FROM a) s CROSS JOIN (SELECT DISTINCT c_nationkey FROM a) k LEFT JOIN a ON a.c_mktsegment = s.c_mktsegment AND a.c_nationkey = k.c_nationkey""",
     None, {"filter": {"field": "c_acctbal", "gt": 5000}}, {"aggregate": [{"op": "count", "as": "n"}], "groupby": ["c_mktsegment", "c_nationkey"]}, {"impute": "n", "key": "c_nationkey", "value": 0, "groupby": ["c_mktsegment"]})
for _offset, _y in {"zero": "run - s", "normalize": "(run - s) / total", "center": "run - s - total / 2"}.items():
    _end = {"zero": "run", "normalize": "run / total", "center": "run - total / 2"}[_offset]
    spec(f"vl_stack_{_offset}", "orders", f"""SELECT o_orderpriority, o_orderstatus, round({_y}, 4) AS y0, round({_end}, 4) AS y1 FROM (
      SELECT *, sum(s) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(s) OVER (PARTITION BY o_orderpriority) AS total
      FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS s FROM orders GROUP BY 1, 2))""", {x: {"field": x} for x in ("o_orderpriority", "o_orderstatus", "y0", "y1")},
         {"aggregate": [{"op": "count", "as": "s"}], "groupby": ["o_orderpriority", "o_orderstatus"]}, {"stack": "s", "groupby": ["o_orderpriority"], "sort": [{"field": "o_orderstatus"}], "as": ["y0", "y1"], "offset": _offset}, places=("y0", "y1"))
spec("vl_quantile", "lineitem", "SELECT l_returnflag, CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS prob, round(unnest(quantile_cont(l_quantity, [0.1, 0.5, 0.9])), 4) AS value FROM lineitem GROUP BY 1", None, {"quantile": "l_quantity", "probs": [0.1, 0.5, 0.9], "groupby": ["l_returnflag"]}, places=("value",))
spec("vl_extent", "lineitem", "SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem", None, {"extent": "l_extendedprice"})
spec("vl_regression", "lineitem", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 4) AS rSquared FROM lineitem GROUP BY 1", None, {"regression": "l_extendedprice", "on": "l_quantity", "groupby": ["l_returnflag"]}, places=("slope", "intercept", "rSquared"))
spec("vl_density", "supplier", "SELECT g.value, round(avg(exp(-0.5 * ((g.value - s_acctbal) / 500.0) ** 2) / (500.0 * sqrt(2 * pi()))), 10) AS density FROM supplier, (SELECT unnest(list_transform(range(0, 11), lambda i: CAST(i * 1000.0 AS DOUBLE))) AS value) g GROUP BY 1", None, {"density": "s_acctbal", "extent": [0.0, 10000.0], "steps": 10, "bandwidth": 500.0})
spec("vl_sorted_top", "customer", "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY 1", {"x": {"field": "c_nationkey", "sort": "ascending"}, "y": {"aggregate": "count"}})


def _boxplot(spark, sf):
    out = chart.box_plot(_read(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "low", "high")})


def _repeat(spark, sf):
    out = chart.repeat({"encoding": {"x": {"field": "l_returnflag"}, "y": {"aggregate": "mean", "field": {"repeat": "column"}}}}, ["l_tax", "l_discount"], _read(spark, sf, "lineitem"))
    return out.withColumn("mean_value", F.round("mean_value", 4))


QUERIES |= {"vl_boxplot": _boxplot, "vl_repeat": _repeat}
_q = QUERIES["vl_density"]
QUERIES["vl_density"] = lambda spark, sf: _q(spark, sf).withColumn("density", F.round("density", 10))
_c = QUERIES["vl_calculate"]
QUERIES["vl_calculate"] = lambda spark, sf: _c(spark, sf).withColumn("sum_net", F.round("sum_net", 2))
ORACLES |= {
    "vl_boxplot": """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
      SELECT o.o_orderpriority, round(any_value(q1), 4) AS q1, round(any_value(m), 4) AS median, round(any_value(q3), 4) AS q3,
        round(min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS low, round(max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS high,
        count(*) FILTER (WHERE NOT o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM orders o JOIN q ON o.o_orderpriority = q.o_orderpriority GROUP BY 1""",
    "vl_repeat": "SELECT l_returnflag, round(avg(l_tax), 4) AS mean_value, 'l_tax' AS repeat FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, round(avg(l_discount), 4), 'l_discount' FROM lineitem GROUP BY 1",
}


def _error_bars(extent: str):
    def run(spark, sf):
        out = chart.error_bar(_read(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"], extent)
        return out.withColumns({c: F.round(c, 4) for c in ("center", "lower", "upper")})

    return run


for _extent, _reach in {"stderr": "stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice))", "stdev": "stddev_samp(l_extendedprice)", "ci": "1.96 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice))"}.items():
    QUERIES[f"vl_errorbar_{_extent}"] = _error_bars(_extent)
    ORACLES[f"vl_errorbar_{_extent}"] = f"SELECT l_returnflag, round(avg(l_extendedprice), 4) AS center, round(avg(l_extendedprice) - {_reach}, 4) AS lower, round(avg(l_extendedprice) + {_reach}, 4) AS upper FROM lineitem GROUP BY 1"
QUERIES["vl_errorbar_iqr"] = _error_bars("iqr")
ORACLES["vl_errorbar_iqr"] = "SELECT l_returnflag, round(median(l_extendedprice), 4) AS center, round(quantile_cont(l_extendedprice, 0.25), 4) AS lower, round(quantile_cont(l_extendedprice, 0.75), 4) AS upper FROM lineitem GROUP BY 1"


def _top(spark, sf):
    sums = chart.view({"encoding": {"y": {"field": "p_brand"}, "x": {"aggregate": "sum", "field": "p_size"}}}, _read(spark, sf, "part"))
    return chart.top(sums, 5, [{"field": "sum_p_size", "order": "descending"}])


def _layers(spark, sf):
    """Two layers of one view, told apart by a column."""
    both = {"encoding": {"x": {"field": "l_returnflag"}}, "layer": [{"encoding": {"y": {"aggregate": "sum", "field": "l_quantity"}}}, {"transform": [{"filter": {"field": "l_tax", "gt": 0.04}}], "encoding": {"y": {"aggregate": "sum", "field": "l_quantity"}, "row": {"field": "l_linestatus"}}}]}
    whole, faceted = chart.layers(both, _read(spark, sf, "lineitem"))
    out = whole.withColumns({"l_linestatus": F.lit(None).cast("string"), "layer": F.lit(0)}).unionByName(faceted.withColumn("layer", F.lit(1)))
    return out.withColumn("sum_l_quantity", F.round(F.col("sum_l_quantity").cast("double"), 4))


def _quadratic(spark, sf):
    out = chart.view({"transform": [{"regression": "l_extendedprice", "on": "l_quantity", "method": "poly", "order": 2, "groupby": ["l_returnflag"]}]}, _read(spark, sf, "lineitem"))
    return out.select("l_returnflag", *(F.round(F.col("coef")[i], 2).alias(f"c{i}") for i in range(3)))


# The quadratic's SQL solves the normal equations by Cramer's rule, with x about 25.
_det = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format
_m = ("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
_part = [_det(*(f"t{i // 3}" if i % 3 == k else c for i, c in enumerate(_m))) + " / " + _det(*_m) for k in range(3)]
QUERIES |= {"vl_topk_sorted": _top, "vl_layer_facet": _layers, "vl_regression_poly": _quadratic}
ORACLES |= {
    "vl_topk_sorted": "SELECT p_brand, sum(p_size)::BIGINT AS sum_p_size FROM part GROUP BY 1 ORDER BY sum_p_size DESC, p_brand LIMIT 5",
    "vl_layer_facet": """SELECT l_returnflag, round(sum(l_quantity)::DOUBLE, 4) AS sum_l_quantity, CAST(NULL AS VARCHAR) AS l_linestatus, 0 AS layer FROM lineitem GROUP BY 1
      UNION ALL SELECT l_returnflag, round(sum(l_quantity)::DOUBLE, 4), l_linestatus, 1 FROM lineitem WHERE l_tax > 0.04 GROUP BY l_returnflag, l_linestatus""",
    "vl_regression_poly": f"""WITH v AS (SELECT l_returnflag, (l_quantity - 25.0)::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
      s AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(z) AS s1, sum(z ** 2) AS s2, sum(z ** 3) AS s3, sum(z ** 4) AS s4, sum(y) AS t0, sum(y * z) AS t1, sum(y * z ** 2) AS t2 FROM v GROUP BY 1),
      f AS (SELECT l_returnflag, {_part[0]} AS a, {_part[1]} AS b, {_part[2]} AS c FROM s)
      SELECT l_returnflag, round(a - 25 * b + 625 * c, 2) AS c0, round(b - 50 * c, 2) AS c1, round(c, 2) AS c2 FROM f""",
}
spec("vl_loess", "customer", """WITH near AS (
  SELECT a.c_custkey, a.c_mktsegment, a.c_acctbal, CAST(b.c_acctbal AS DOUBLE) - a.c_acctbal AS far, CAST(b.c_nationkey AS DOUBLE) AS y, row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(CAST(b.c_acctbal AS DOUBLE) - a.c_acctbal)) AS k FROM customer a JOIN customer b USING (c_mktsegment)),
weighed AS (SELECT *, pow(1 - pow(abs(far) / max(abs(far)) OVER (PARTITION BY c_custkey), 3), 3) AS w FROM near WHERE k <= 20),
means AS (SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, any_value(CAST(c_acctbal AS DOUBLE)) AS c_acctbal, sum(w * far) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * far * y) / sum(w) AS mxy, sum(w * far * far) / sum(w) AS mxx FROM weighed GROUP BY c_custkey)
SELECT c_mktsegment, c_acctbal, round(my - (mxy - mx * my) / (mxx - mx * mx) * mx, 4) AS loess FROM means""",
     None, {"loess": "c_nationkey", "on": "c_acctbal", "groupby": ["c_mktsegment"], "neighbours": 20}, places=("loess",))
