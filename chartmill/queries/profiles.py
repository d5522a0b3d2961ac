"""Profiles and preparation of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import profile as P


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _holed(spark, sf):
    return _read(spark, sf, "customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))


QUERIES = {
    "prf_customer": lambda spark, sf: P.profile(_holed(spark, sf)),
    "prf_lineitem": lambda spark, sf: P.profile(_read(spark, sf, "lineitem")).select("column", "dtype", "role", "distinct", "outliers"),
    "prf_duplicates": lambda spark, sf: P.duplicate_rows(_read(spark, sf, "lineitem")),
    "prf_missing": lambda spark, sf: P.profile(_read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).otherwise(F.lit("N/A")).alias("segment"), (F.col("c_custkey") % 60 + 1960).alias("birth_year"))).select("column", "dtype", "role", "missing", "missing_like", "missing_ratio", "missing_like_ratio", F.array_join("flags", ",").alias("flags"), F.array_join("hints", ",").alias("hints")),
    "prf_notes": lambda spark, sf: P.table_notes(P.profile(_read(spark, sf, "nation").select("n_name", F.lit(1990).alias("year"))), 25),
    "prj_safe_names": lambda spark, sf: P.safe_names(_read(spark, sf, "region").select(F.col("r_regionkey").alias("2nd key!"), F.col("r_name").alias("Region.Name"), F.col("r_name").alias("Region Name"))),
    "prj_median_fill": lambda spark, sf: P.fill_medians(_holed(spark, sf).select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4)),
    "prj_year_parse": lambda spark, sf: P.parse_times(_read(spark, sf, "part").select("p_partkey", (F.col("p_size") + 10).alias("year")), ["year"]),
}


def _profile_sql(table: str, columns: dict[str, tuple[str, str]], numeric: set[str], source: str) -> str:
    parts = []
    for c, (kind, role) in columns.items():
        outliers = f"(SELECT count(*) FROM {source} t, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}) q WHERE b <> a AND (t.{c} < a - 1.5 * (b - a) OR t.{c} > b + 1.5 * (b - a)))" if c in numeric else "0"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, '{role}' AS role, count(DISTINCT {c}) AS \"distinct\", CAST({outliers} AS BIGINT) AS outliers FROM {source}")
    return " UNION ALL ".join(parts)


_LINES = {c: ("numeric", "measure") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")}
ORACLES = {
    "prf_lineitem": _profile_sql("lineitem", {**_LINES, "l_returnflag": ("categorical", "dimension"), "l_linestatus": ("categorical", "dimension"), "l_shipdate": ("datetime", "temporal")}, set(_LINES), "lineitem"),
    "prf_duplicates": "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicates, count(*) AS rows FROM lineitem",
    "prf_missing": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 = 0) AS m, count(*) FILTER (WHERE c_custkey % 5 = 0) AS l FROM customer)
      SELECT 'balance' AS "column", 'numeric' AS dtype, 'measure' AS role, m AS missing, CAST(0 AS BIGINT) AS missing_like, round(m / n, 6) AS missing_ratio, CAST(0 AS DOUBLE) AS missing_like_ratio, 'good_for_measure' AS flags, '' AS hints FROM c
      UNION ALL SELECT 'segment', 'categorical', 'dimension', 0, l, 0, round(l / n, 6), 'missing_like_strings,good_for_grouping,safe_for_color', 'normalize_missing_like_strings' FROM c
      UNION ALL SELECT 'birth_year', 'datetime', 'temporal', 0, 0, 0, 0, 'year_like,good_for_temporal_axis', 'normalize_temporal_values' FROM c""",
    "prf_notes": "SELECT unnest(['no measures', 'time-like: year']) AS note",
    "prj_safe_names": "SELECT r_regionkey AS col_2nd_key, r_name AS Region_Name, r_name AS Region_Name_2 FROM region",
    "prj_median_fill": "WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS b FROM customer) SELECT c_custkey, round(coalesce(b, (SELECT median(b) FROM h)), 4) AS c_acctbal FROM h",
    "prj_year_parse": "SELECT p_partkey, make_timestamp(CASE WHEN y <= 29 THEN 2000 + y ELSE 1900 + y END, 1, 1, 0, 0, 0) AS year FROM (SELECT p_partkey, CAST(p_size + 10 AS BIGINT) AS y FROM part)",
}
