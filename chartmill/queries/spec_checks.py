"""Repaired specifications and their validity; every part gives one specification with faults of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import spec_checks as S
from chartmill.operators.lineage import spread

_TABLES = ("part", "orders")


def _sql(text: str) -> str:
    return "'" + text.replace("<brand>", "' || p_brand || '").replace("<type>", "' || p_type || '").replace("<size>", "' || CAST(p_size AS STRING) || '") + "'"


#: An expression of both engines: by the part's number flat, faceted, layered and invalid specifications.
_SHAPES = (
    '{"mark":" Scatter","facet":"p_brand","data":{"url":"part"},"encoding":{"x":" p_size ","color":"<brand>","y":{"field":"p_retailprice"}},"transform":[{},{"filter":"datum.p_size > <size>"},5],"datasets":{}}',
    '{"$schema":"own","mark":{"type":"SCATTER"},"data":{"url":"part"},"facet":{"row":{"field":"p_type","type":"ordinal"},"field":"p_brand"},"encoding":{"x":{"field":"p_size","scale":{"domain":[null,<size>,null]}},"y":{"field":"made","scale":{"domain":null}}},"transform":[{"calculate":"datum.p_size","as":"made"}]}',
    '{"data":{"url":"orders"},"layer":[{"mark":"scatter","encoding":{"x":"o_orderdate","theta":" "}},{"mark":"line","encoding":{"y":{"aggregate":"count","field":"*"},"x":{"field":"<type>","scale":{"domain":[null]}}},"transform":[{"aggregate":[{"op":"mean","field":"o_totalprice","as":"m"}],"groupby":["o_clerk"," g ",""]},"none"]}]}',
    '{"mark":"bar","facet":{"field":"p_brand"},"spec":{"mark":"bar"},"data":{"url":"<brand>"},"transform":[{"lookup":"k","from":{"key":"j"}},{"what":1}],"datasets":{"a":[]}}',
    '{"title":"<brand>","data":{"url":" "},"encoding":{"y2":"p_size"}}',
    "[]",
    "no JSON <brand>",
)
SPEC = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {_sql(s)}" for i, s in enumerate(_SHAPES)) + " END"


def _specs(spark, sf):
    return spread(spark.read.parquet(f"{sf}/part.parquet")).select("p_partkey", F.expr(SPEC).alias("spec"))


def _repaired(spark, sf):
    """The repaired parts as text, so that the order of keys doesn't count: of the root and of its two layers."""
    out = S.repaired(_specs(spark, sf))
    at = lambda path: F.get_json_object("repaired", path)
    views = F.posexplode(F.array(*(F.struct(*(F.coalesce(at(f"$.{v}{path}"), F.lit("")).alias(name) for name, path in _PARTS.items())) for v in ("", "layer[0].", "layer[1]."))))
    return out.select("p_partkey", F.array_join("notes", "|").alias("notes"), at("$.$schema").alias("schema"), at("$.datasets").isNotNull().alias("datasets"), views.alias("view", "v")).select("p_partkey", "notes", "schema", "datasets", "view", "v.*")


_PARTS = {
    "mark": "mark", "mark_type": "mark.type", "facet": "facet.field", "column_field": "encoding.column.field", "column_type": "encoding.column.type", "row_type": "encoding.row.type", "x_field": "encoding.x.field", "x_type": "encoding.x.type",
    "color_field": "encoding.color.field", "color_type": "encoding.color.type", "y2_type": "encoding.y2.type", "x_domain": "encoding.x.scale.domain", "y_domain": "encoding.y.scale.domain", "first_filter": "transform[0].filter", "second": "transform[1]",
}


def _validity(spark, sf):
    columns = {t: spark.read.parquet(f"{sf}/{t}.parquet").columns for t in _TABLES}
    out = S.validity(_specs(spark, sf), columns)
    return out.select("p_partkey", "is_valid", F.array_join("errors", "|").alias("errors"), F.size("hints").alias("n_hints"))


QUERIES = {"spc_repaired": _repaired, "spc_validity": _validity}

_SPECS = f"""specs AS (SELECT p_partkey, CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s::JSON END AS s FROM (SELECT p_partkey, {SPEC.replace("AS STRING", "AS VARCHAR")} AS s FROM part)),
tree AS (SELECT p_partkey, t.id, t.parent, t.key, t.value, t.type, t.value->>'$' AS said FROM specs, json_tree(s) t WHERE s IS NOT NULL)"""
_KINDS = "['" + "','".join(sorted(S.TRANSFORMS)) + "']"
_CHANNEL = "CASE WHEN json_type(n, '$.encoding.{c}') = 'VARCHAR' AND trim(n->>'$.encoding.{c}') <> '' THEN {text} ELSE {other} END"
_DOMAIN = "coalesce(CASE WHEN json_type(n, '$.encoding.{c}.scale.domain') = 'ARRAY' THEN (SELECT CASE WHEN count(*) > 0 THEN '[' || string_agg(CAST(d.value AS VARCHAR), ',' ORDER BY d.id) || ']' END FROM json_each(n, '$.encoding.{c}.scale.domain') d WHERE d.type <> 'NULL') END, '')"


def _channel(c: str, part: str) -> str:
    kind = "quantitative" if c in S.NUMBERS else "nominal"
    text = f"trim(n->>'$.encoding.{c}')" if part == "field" else f"'{kind}'"
    return _CHANNEL.format(c=c, text=text, other=f"coalesce(n->>'$.encoding.{c}.{part}', '')")


ORACLES = {
    "spc_repaired": f"""WITH {_SPECS},
views AS (SELECT p_partkey, s, v.view, CASE v.view WHEN 0 THEN s WHEN 1 THEN s->'$.layer[0]' ELSE s->'$.layer[1]' END AS n FROM specs, (SELECT unnest([0, 1, 2]) AS view) v),
told AS (
  SELECT p_partkey, 0 AS rule, 0 AS id, '{S.SCHEMA_ADDED}' AS note FROM specs WHERE s IS NOT NULL AND NOT list_contains(json_keys(s), '$schema')
  UNION ALL SELECT p_partkey, 1, id, CASE WHEN type = 'VARCHAR' THEN '{S.MARK_RENAMED.replace("'", "''")}' ELSE '{S.MARK_TYPE_RENAMED.replace("'", "''")}' END FROM tree WHERE key = 'mark' AND lower(trim(CASE WHEN type = 'VARCHAR' THEN said ELSE value->>'$.type' END)) = 'scatter'
  UNION ALL SELECT p_partkey, 2, 0, CASE WHEN json_type(s, '$.facet') = 'VARCHAR' THEN '{S.FACET_NAMED}' ELSE '{S.FACET_MOVED}' END FROM specs WHERE json_exists(s, '$.facet') AND json_exists(s, '$.mark') AND NOT json_exists(s, '$.spec')
  UNION ALL SELECT a.p_partkey, 3, a.id, 'Converted string encoding.' || a.key || ' into a Vega-Lite channel definition.' FROM tree a JOIN tree b ON a.p_partkey = b.p_partkey AND a.parent = b.id WHERE b.key = 'encoding' AND a.type = 'VARCHAR' AND trim(a.said) <> ''
  UNION ALL SELECT p_partkey, 4, id, CASE WHEN type = 'NULL' THEN '{S.DOMAIN_NULL}' WHEN (SELECT count(*) FROM json_each(value) d WHERE d.type <> 'NULL') = 0 THEN '{S.DOMAIN_EMPTY}' ELSE '{S.DOMAIN_CLEANED}' END FROM tree WHERE key = 'domain' AND (type = 'NULL' OR (type = 'ARRAY' AND (SELECT count(*) FROM json_each(value) d WHERE d.type = 'NULL') > 0))
  UNION ALL SELECT p_partkey, 5, min(id), '{S.TRANSFORMS_CLEANED}' FROM tree WHERE key = 'transform' AND (SELECT count(*) FROM json_each(value) d WHERE d.type <> 'OBJECT' OR NOT list_has_any(json_keys(d.value), {_KINDS})) > 0 GROUP BY p_partkey
  UNION ALL SELECT p_partkey, 6, 0, '{S.DATASETS_EMPTY}' FROM specs WHERE CAST(s->'$.datasets' AS VARCHAR) = '{{}}'),
notes AS (SELECT p_partkey, string_agg(note, '|' ORDER BY rule, id) AS notes FROM told GROUP BY p_partkey),
transforms AS (
  SELECT p_partkey, view, d.value AS t, row_number() OVER (PARTITION BY p_partkey, view ORDER BY d.id) AS place FROM views, json_each(n, '$.transform') d WHERE d.type = 'OBJECT' AND list_has_any(json_keys(d.value), {_KINDS})),
moved AS (SELECT *, json_exists(n, '$.mark') AND NOT json_exists(n, '$.spec') AND json_exists(n, '$.facet') AS m FROM views)
SELECT v.p_partkey, coalesce(o.notes, '{S.NOT_OBJECT}') AS notes, CASE WHEN s IS NULL THEN NULL ELSE coalesce(s->>'$."$schema"', '{S.SCHEMA}') END AS schema, s IS NOT NULL AND coalesce(CAST(s->'$.datasets' AS VARCHAR), '{{}}') <> '{{}}' AS datasets, v.view,
  coalesce(CASE WHEN lower(trim(n->>'$.mark')) = 'scatter' THEN 'point' WHEN lower(trim(n->>'$.mark.type')) = 'scatter' THEN '{{"type":"point"}}' ELSE n->>'$.mark' END, '') AS mark, CASE WHEN lower(trim(n->>'$.mark.type')) = 'scatter' THEN 'point' ELSE '' END AS mark_type,
  CASE WHEN m THEN '' ELSE coalesce(n->>'$.facet.field', '') END AS facet, CASE WHEN m THEN coalesce(n->>'$.facet.field', n->>'$.facet') ELSE '' END AS column_field, CASE WHEN m THEN 'nominal' ELSE '' END AS column_type, CASE WHEN m THEN coalesce(n->>'$.facet.row.type', '') ELSE '' END AS row_type,
  {_channel("x", "field")} AS x_field, {_channel("x", "type")} AS x_type, {_channel("color", "field")} AS color_field, {_channel("color", "type")} AS color_type, {_channel("y2", "type")} AS y2_type,
  {_DOMAIN.format(c="x")} AS x_domain, {_DOMAIN.format(c="y")} AS y_domain, coalesce(a.t->>'$.filter', '') AS first_filter, coalesce(CAST(b.t AS VARCHAR), '') AS second
FROM moved v LEFT JOIN notes o USING (p_partkey) LEFT JOIN transforms a ON a.p_partkey = v.p_partkey AND a.view = v.view AND a.place = 1 LEFT JOIN transforms b ON b.p_partkey = v.p_partkey AND b.view = v.view AND b.place = 2""",
    "spc_validity": f"""WITH {_SPECS},
known AS (SELECT 'part' AS url, column_name AS field FROM (DESCRIBE SELECT * FROM part) UNION ALL SELECT 'orders', column_name FROM (DESCRIBE SELECT * FROM orders)),
texts AS (
  SELECT p_partkey, key, trim(said) AS field, false AS listed FROM tree WHERE type = 'VARCHAR' AND key IN ('field', 'key', 'from', 'lookup', 'as')
  UNION ALL SELECT t.p_partkey, t.key, trim(d.value->>'$'), true FROM tree t, json_each(t.value) d WHERE t.type = 'ARRAY' AND d.type = 'VARCHAR' AND t.key IN ('fields', 'groupby', 'sort', 'as')
  UNION ALL SELECT a.p_partkey, 'facet', a.said, false FROM tree a JOIN specs USING (p_partkey) WHERE a.key = 'facet' AND a.type = 'VARCHAR' AND json_exists(s, '$.mark')
  UNION ALL SELECT a.p_partkey, 'encoding', trim(a.said), false FROM tree a JOIN tree b ON a.p_partkey = b.p_partkey AND a.parent = b.id WHERE b.key = 'encoding' AND a.type = 'VARCHAR'),
wanted AS (
  SELECT DISTINCT p_partkey, field, s->>'$.data.url' AS url FROM texts JOIN specs USING (p_partkey) WHERE key <> 'as' AND field <> '' AND NOT (key = 'field' AND field = '*')),
missing AS (
  SELECT p_partkey, 'Specification references fields not present in prepared data or transform outputs: ' || string_agg(field, ', ' ORDER BY field) AS said FROM wanted w
  WHERE url IN ('part', 'orders') AND NOT EXISTS (SELECT 1 FROM known k WHERE k.url = w.url AND k.field = w.field) AND NOT EXISTS (SELECT 1 FROM texts t WHERE t.p_partkey = w.p_partkey AND t.key = 'as' AND t.field = w.field) GROUP BY p_partkey),
errors AS (
  SELECT p_partkey, concat_ws('|', CASE WHEN s IS NULL THEN '{S.NO_OBJECT}' WHEN trim(coalesce(s->>'$.data.url', '')) = '' THEN '{S.NO_URL}' WHEN s->>'$.data.url' NOT IN ('part', 'orders') THEN 'Prepared dataset could not be read: ' || (s->>'$.data.url') END,
    CASE WHEN s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tree t WHERE t.p_partkey = specs.p_partkey AND t.key IN ('mark', 'layer', 'facet', 'repeat', 'concat', 'hconcat', 'vconcat')) THEN '{S.NO_VIEW}' END, m.said) AS errors, m.said IS NOT NULL AS lacking, s
  FROM specs LEFT JOIN missing m USING (p_partkey)),
notes AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 7 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS n FROM part)
SELECT p_partkey, errors = '' AS is_valid, errors, CASE WHEN s IS NULL THEN 1 ELSE n + CASE WHEN lacking THEN 1 ELSE 0 END + CASE WHEN errors <> '' THEN 4 ELSE 0 END END AS n_hints FROM errors JOIN notes USING (p_partkey)""",
}
