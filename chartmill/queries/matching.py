"""Views and matchings of layered, faceted and flat specifications, which every part gives as a reference and as a guess."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import encodings as E
from chartmill.operators.lineage import spread

_X = """"x":{{"field":"{a}","type":"{t}"}}"""
_Y = """"y":{{"aggregate":"{agg}","field":"size","type":"quantitative"}}"""


def _sql(*parts: str) -> str:
    return "'" + "".join(parts) + "'"


#: Expressions of both engines. By the part's number a flat, a layered (with a condition and a binned channel) and a faceted specification.
_BRAND, _KIND = "' || p_brand || '", "' || p_type || '"
_FLAT = _sql('{"mark":"bar","encoding":{', _X.format(a=_BRAND, t="nominal"), ",", _Y.format(agg="average"), ',"color":{"field":"', _BRAND, '","type":"nominal"}},"transform":[{"filter":"datum.size > 3"}]}')
_LAYERS = _sql('{"transform":[{"calculate":"datum.a","as":"b"}],"layer":[{"mark":{"type":"line"},"encoding":{', _X.format(a=_KIND, t="ordinal"), ",", _Y.format(agg="mean"), '}},{"mark":"point","encoding":{"y":{"aggregate":"count"},"x":{"field":"price","bin":true},"color":{"condition":{"field":"', _BRAND, '","type":"nominal"},"value":"red"}}}]}')
_FACET = _sql('{"facet":{"row":{"field":"', _KIND, '","type":"nominal"}},"spec":{"mark":"area","encoding":{', _X.format(a="day", t="temporal").replace('"type"', '"timeUnit":"year","type"'), ",", _Y.format(agg="sum"), "}}}")
_TURNED = _sql('{"mark":"bar","encoding":{', _X.replace('"x"', '"y"').format(a=_BRAND, t="nominal"), ",", _Y.replace('"y"', '"x"').format(agg="mean"), ',"size":{"field":"', _BRAND, '"}}}')
_REF = f"CASE p_partkey % 4 WHEN 0 THEN {_LAYERS} WHEN 1 THEN {_FACET} WHEN 2 THEN '[]' ELSE {_FLAT} END"
_GUESS = f"CASE p_partkey % 7 WHEN 0 THEN {_LAYERS} WHEN 1 THEN {_FACET} WHEN 2 THEN {_TURNED} WHEN 3 THEN 'no spec' WHEN 4 THEN {_TURNED} ELSE {_FLAT} END"


def _side(spark, sf, expression):
    return E.extracted(spread(spark.read.parquet(f"{sf}/part.parquet")).select("p_partkey", F.expr(expression).alias("spec")), "spec")


def _encodings(spark, sf):
    return _side(spark, sf, _GUESS).select("p_partkey", F.posexplode("encodings").alias("place", "e")).select("p_partkey", "place", "e.*")


def _transforms(spark, sf):
    each = _side(spark, sf, _GUESS).select(F.explode("transforms").alias("t")).select("t.*")
    return each.groupBy("view", "kind", "field", "op", "as_field", "signature").agg(F.count("*").alias("n"))


def _matched(spark, sf):
    got = E.matched(_side(spark, sf, _GUESS), _side(spark, sf, _REF), "p_partkey")
    pairs = F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["g"], p["r"], F.round(p["similarity"] * 10000).cast("int"))), " ")
    return got.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")), "exchanged", pairs.alias("pairs"))


QUERIES = {"spc_views": _encodings, "spc_view_transforms": _transforms, "spc_matched": _matched}

_V = lambda spec: spec.replace("AS STRING", "AS VARCHAR")
_VIEWS = """specs AS (SELECT p_partkey, CASE WHEN json_valid(s) AND json_type(s) = 'OBJECT' THEN s::JSON END AS s FROM (SELECT p_partkey, {spec} AS s FROM part)),
nodes AS (
  SELECT p_partkey, 0 AS view, s AS node, NULL::JSON AS facet, NULL::JSON AS above FROM specs WHERE json_exists(s, '$.mark') OR json_exists(s, '$.encoding')
  UNION ALL SELECT p_partkey, CAST(l.key AS INT), l.value, NULL, s->'$.transform' FROM specs, json_each(s, '$.layer') l
  UNION ALL SELECT p_partkey, v, s->'$.spec', CASE WHEN v = 1 THEN s->'$.facet' END, s->'$.transform' FROM specs, (SELECT unnest([0, 1]) AS v) WHERE json_exists(s, '$.spec')),
said AS (
  SELECT p_partkey, view, 0 AS f, c.id AS a, d AS b, c.key AS channel, CASE d WHEN 0 THEN c.value ELSE c.value->'$.condition' END AS e FROM nodes, json_each(node, '$.encoding') c, (SELECT unnest([0, 1]) AS d)
  UNION ALL SELECT p_partkey, view, 1, c.id, 0, 'facet', c.value FROM nodes, json_each(facet) c WHERE facet IS NOT NULL),
found AS (
  SELECT *, CASE WHEN lower(coalesce(e->>'$.aggregate', '')) IN ('avg', 'average') THEN 'mean' ELSE lower(coalesce(e->>'$.aggregate', '')) END AS aggregate, coalesce(e->>'$.field', '') AS own FROM said WHERE e IS NOT NULL),
enc AS (
  SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY view, f, a, b) - 1 AS place, view, channel, CASE WHEN aggregate = 'count' AND own = '' THEN '*' ELSE own END AS field, lower(coalesce(e->>'$.type', '')) AS type, aggregate,
    CASE WHEN (e->>'$.bin') = 'true' THEN 'true' ELSE '' END AS bin, lower(coalesce(e->>'$.timeUnit', '')) AS time_unit
  FROM found WHERE own <> '' OR aggregate = 'count')"""


def _renamed(spec: str, by: str) -> str:
    out = _VIEWS.format(spec=_V(spec))
    for name in ("specs", "nodes", "said", "found", "enc"):
        out = out.replace(f"{name} AS (", f"{by}{name} AS (").replace(f"FROM {name}", f"FROM {by}{name}")
    return out


_SCORES = """p{n} AS (SELECT g.p_partkey, g.place AS g, r.place AS r,
    25 * CASE WHEN {c} = r.channel THEN 100 WHEN (({c} = 'x' AND r.channel = 'y') OR ({c} = 'y' AND r.channel = 'x')) THEN 85 ELSE 0 END + 35 * CASE WHEN g.field = r.field THEN 100 ELSE 0 END + 15 * CASE WHEN g.type = r.type THEN 100 ELSE 0 END
    + 10 * CASE WHEN g.aggregate = r.aggregate THEN 100 ELSE 0 END + 10 * CASE WHEN g.bin = r.bin THEN 100 ELSE 0 END + 5 * CASE WHEN g.time_unit = r.time_unit THEN 100 ELSE 0 END AS s
  FROM g_enc g JOIN r_enc r USING (p_partkey)),
o{n} AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, g, r) AS k FROM p{n} WHERE s > 0),
m{n} AS (
  SELECT p_partkey, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS rs, CAST(0 AS BIGINT) AS total, '' AS pairs FROM part
  UNION ALL SELECT m.p_partkey, o.k, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN list_append(rs, r) ELSE rs END, CASE WHEN free THEN total + s ELSE total END, CASE WHEN free THEN trim(pairs || ' ' || g || '-' || r || '-' || s) ELSE pairs END
  FROM (SELECT m.*, o.g, o.r, o.s, o.k AS ok, NOT list_contains(m.gs, o.g) AND NOT list_contains(m.rs, o.r) AS free FROM m{n} m JOIN o{n} o ON o.p_partkey = m.p_partkey AND o.k = m.k + 1) m JOIN (SELECT p_partkey, k FROM o{n}) o ON o.p_partkey = m.p_partkey AND o.k = m.ok),
f{n} AS (
  SELECT p_partkey, pairs, CASE WHEN ng + nr = 0 THEN 1.0 WHEN ng * nr = 0 THEN 0.0 ELSE total / 10000 / ng END AS p, CASE WHEN ng + nr = 0 THEN 1.0 WHEN ng * nr = 0 THEN 0.0 ELSE total / 10000 / nr END AS q
  FROM (SELECT m.*, (SELECT count(*) FROM g_enc e WHERE e.p_partkey = m.p_partkey) AS ng, (SELECT count(*) FROM r_enc e WHERE e.p_partkey = m.p_partkey) AS nr FROM m{n} m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY k DESC) = 1)),
s{n} AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END AS f FROM f{n})"""
ORACLES = {
    "spc_views": f"WITH {_VIEWS.format(spec=_V(_GUESS))} SELECT * FROM enc",
    "spc_view_transforms": f"""WITH {_VIEWS.format(spec=_V(_GUESS))},
listed AS (
  SELECT view, t.value AS t FROM nodes, json_each(above) t WHERE above IS NOT NULL UNION ALL SELECT view, t.value FROM nodes, json_each(node, '$.transform') t),
every AS (
  SELECT view, CASE WHEN json_exists(t, '$.filter') THEN 'filter' ELSE 'calculate' END AS kind, '' AS field, '' AS op, coalesce(t->>'$.as', '') AS as_field, CASE WHEN json_exists(t, '$.as') THEN '{{"as":' || CAST(t->'$.as' AS VARCHAR) || ',"calculate":' || CAST(t->'$.calculate' AS VARCHAR) || '}}' ELSE CAST(t AS VARCHAR) END AS signature FROM listed
  UNION ALL SELECT view, 'aggregate', field, aggregate, field, '' FROM enc WHERE aggregate <> '' AND NOT (channel = 'facet')
  UNION ALL SELECT view, 'bin', field, bin, field, '' FROM enc WHERE bin <> '' UNION ALL SELECT view, 'timeUnit', field, time_unit, field, '' FROM enc WHERE time_unit <> '')
SELECT view, kind, field, op, as_field, signature, count(*) AS n FROM every GROUP BY ALL""",
    "spc_matched": f"""WITH RECURSIVE {_renamed(_GUESS, "g_")}, {_renamed(_REF, "r_")}, {_SCORES.format(n=1, c="g.channel")}, {_SCORES.format(n=2, c="(CASE g.channel WHEN 'x' THEN 'y' WHEN 'y' THEN 'x' ELSE g.channel END)")}
SELECT p_partkey, round(CASE WHEN b.f > a.f THEN b.p ELSE a.p END, 6) AS precision, round(CASE WHEN b.f > a.f THEN b.q ELSE a.q END, 6) AS recall, round(greatest(a.f, b.f), 6) AS f, b.f > a.f AS exchanged, CASE WHEN b.f > a.f THEN b.pairs ELSE a.pairs END AS pairs
FROM s1 a JOIN s2 b USING (p_partkey)""",
}
