"""Chunks of whole documents, the bootstrap interval of two runs' differences, and sums along paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import chunks as K
from chartmill.operators import runs as R

def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def _sections(spark, sf):
    """Lines between two others become headings, so that documents have sections."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n([^\n]*)\n", "\n## Part $1\n")
    each = _docs(spark, sf).select("doc_id", F.posexplode(K.sections(marked)).alias("place", "s"))
    return each.select("doc_id", "place", F.col("s.title").alias("title"), F.col("s.body").alias("body"))


def _deltas(spark, sf):
    """The difference of each order's score in two runs, of which the right one is shifted by the customer; every seventh score is missing."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 7 <> 0")
    shift = F.when(F.col("o_custkey") % 3 == 0, 0.01).when(F.col("o_custkey") % 3 == 1, -0.02).otherwise(0.0)
    return orders.select("o_orderkey", F.round(shift * F.col("o_totalprice") / 100_000, 6).alias("delta"))


QUERIES = {
    "scl_chunks": lambda spark, sf: _docs(spark, sf).select("doc_id", F.posexplode(K.packed(F.col("text"))).alias("place", "chunk")),
    "scl_line_chunks": lambda spark, sf: _docs(spark, sf).select("doc_id", F.explode(K.line_chunks(F.col("text"), 400, 3)).alias("c")).select("doc_id", F.col("c.first").alias("begin"), F.col("c.last").alias("until"), F.col("c.text").alias("chunk")),
    "scl_sections": _sections,
    "run_tree": lambda spark, sf: R.rolled_up(spark.read.parquet(f"{sf}/part.parquet").withColumn("path", F.concat_ws("/", "p_brand", F.regexp_replace("p_type", " ", "/"), F.col("p_size").cast("string"))), "path", "p_size"),
    "run_bootstrap": lambda spark, sf: R.bootstrap_interval(_deltas(spark, sf), "delta", ["o_orderkey"], 1000),
}

_PLAIN = r"trim(regexp_replace({text}, '[\s]+', ' ', 'g'))"
#: Greedy packing of (r, text): one step takes a sentence.
_PACKED = r"""said AS MATERIALIZED (SELECT r, t, string_split(regexp_replace(t, '\. ([A-ZА-Я])', '.' || chr(1) || '\1', 'g'), chr(1)) AS p FROM {source}),
parts AS MATERIALIZED (SELECT r, unnest(p) AS p, unnest(generate_series(1, len(p))) AS i FROM said WHERE t <> ''),
step AS (
  SELECT r, i, [left(p, {most})] AS chunks FROM parts WHERE i = 1
  UNION ALL SELECT s.r, p.i, CASE WHEN length(chunks[-1]) + length(p.p) + 1 <= {most} THEN list_append(chunks[:-2], chunks[-1] || ' ' || p.p) ELSE list_append(chunks, left(p.p, {most})) END FROM step s JOIN parts p ON p.r = s.r AND p.i = s.i + 1),
packed AS (
  SELECT r, list_filter(chunks, lambda c: length(c) >= {least}) AS c FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY r ORDER BY i DESC) = 1)),
pieces AS (SELECT s.r, CASE WHEN len(p.c) > 0 THEN p.c WHEN length(s.t) >= {least} THEN [left(s.t, {most})] ELSE [] END AS c FROM said s JOIN packed p ON p.r = s.r)"""
_LINES = r"string_split(regexp_replace(regexp_replace({text}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', ''), chr(10))"
_TEN = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"
ORACLES = {
    "scl_chunks": f"""WITH RECURSIVE {_TEN}, plain AS (SELECT r, {_PLAIN.format(text='text')} AS t FROM d), {_PACKED.format(source='plain', most=K.MOST, least=K.LEAST)}
SELECT doc_id, unnest(generate_series(0, len(c) - 1)) AS place, unnest(c) AS chunk FROM pieces JOIN d USING (r) WHERE len(c) > 0""",
    "scl_line_chunks": f"""WITH RECURSIVE {_TEN}, lines AS MATERIALIZED (SELECT r, doc_id, {_LINES.format(text='text')} AS l FROM d WHERE text <> ''),
sums AS MATERIALIZED (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS s FROM (SELECT r, unnest(generate_series(1, len(l))) AS i, unnest(list_transform(l, lambda x: length(x) + 1)) AS n FROM lines)),
ends AS MATERIALIZED (
  SELECT a.r, a.i - 1 AS a, greatest(a.i, coalesce(max(b.i), a.i)) AS b FROM sums a JOIN (SELECT r, i, s - n AS before FROM (SELECT r, i, s, s - lag(s, 1, 0) OVER (PARTITION BY r ORDER BY i) AS n FROM sums)) f ON f.r = a.r AND f.i = a.i
  LEFT JOIN sums b ON b.r = a.r AND b.i >= a.i AND b.s - f.before <= 400 GROUP BY a.r, a.i),
chain AS (SELECT r, a, b FROM ends WHERE a = 0 UNION ALL SELECT e.r, e.a, e.b FROM chain c JOIN lines l ON l.r = c.r JOIN ends e ON e.r = c.r AND c.b < len(l.l) AND e.a = greatest(c.b - 3, c.a + 1))
SELECT doc_id, a + 1 AS begin, b AS until, chunk FROM (SELECT doc_id, a, b, regexp_replace(array_to_string(l[a + 1:b], chr(10)), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS chunk FROM chain JOIN lines USING (r)) WHERE chunk <> ''""",
    "run_tree": """WITH p AS (SELECT p_size, list_filter(string_split(concat_ws('/', p_brand, replace(p_type, ' ', '/'), CAST(p_size AS VARCHAR)), '/'), lambda x: x <> '') AS s FROM part)
SELECT array_to_string(s[1:depth], '/') AS path, depth, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM (SELECT p_size, s, unnest(generate_series(0, len(s))) AS depth FROM p) GROUP BY 1, 2""",
    "run_bootstrap": f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, round(CASE o_custkey % 3 WHEN 0 THEN 0.01 WHEN 1 THEN -0.02 ELSE 0.0 END * o_totalprice / 100000, 6)::DOUBLE AS delta FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT count(*) AS n FROM v), d AS (SELECT b, i, n, (b * 48271 + i * 40692 + 12345) % {R.PRIME} AS y FROM n, range(1000) x(b), LATERAL (SELECT place AS i FROM v)),
e AS (SELECT b, n, (((((y * y + 7) % {R.PRIME}) * ((y * y + 7) % {R.PRIME}) + b) % {R.PRIME}) * ((((y * y + 7) % {R.PRIME}) * ((y * y + 7) % {R.PRIME}) + b) % {R.PRIME}) + i) % {R.PRIME} % n AS place FROM d),
m AS (SELECT b, sum(delta) / any_value(n) AS m FROM e JOIN v USING (place) GROUP BY b)
SELECT (SELECT n FROM n) AS n, (SELECT round(avg(delta), 6) FROM v) AS mean, round(list(m ORDER BY m)[25], 6) AS low, round(list(m ORDER BY m)[975], 6) AS high FROM m""",
    "scl_sections": rf"""WITH RECURSIVE {_TEN}, lines AS (SELECT r, doc_id, {_LINES.format(text=r"regexp_replace(text, chr(10) || '([^' || chr(10) || ']*)' || chr(10), chr(10) || '## Part \1' || chr(10), 'g')")} AS l FROM d WHERE text <> ''),
each AS (SELECT r, doc_id, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM lines),
heads AS (SELECT *, regexp_extract(x, '^\s{{0,3}}#{{1,4}}\s+(.+?)\s*$', 1) AS h FROM each),
numbered AS (SELECT *, count(*) FILTER (WHERE h <> '') OVER (PARTITION BY r ORDER BY i) AS k FROM heads),
bodies AS MATERIALIZED (
  SELECT r, doc_id, k, coalesce(max(CASE WHEN length(u) <= 160 THEN u ELSE rtrim(substring(u, 1, 159)) || '…' END) FILTER (WHERE h <> ''), 'Document overview') AS title,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE h = ''), ''), '(?s)```.*?```', ' ', 'g'), '`([^`]*)`', '\1', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS body
  FROM (SELECT *, trim(regexp_replace(h, '\s+', ' ', 'g')) AS u FROM numbered) GROUP BY r, doc_id, k),
long AS (SELECT r || '-' || k AS r, body AS t FROM bodies WHERE length(body) > {K.MOST}), {_PACKED.format(source='long', most=K.MOST, least=K.LEAST)},
found AS (
  SELECT r, doc_id, k, 0 AS j, title, body FROM bodies WHERE length(body) BETWEEN {K.LEAST} AND {K.MOST}
  UNION ALL SELECT b.r, b.doc_id, b.k, j, b.title || ' #' || j, c FROM bodies b JOIN (SELECT r, unnest(c) AS c, unnest(generate_series(1, len(c))) AS j FROM pieces WHERE len(c) > 0) p ON p.r = b.r || '-' || b.k)
SELECT doc_id, row_number() OVER (PARTITION BY r ORDER BY k, j) - 1 AS place, title, body FROM found""",
}
