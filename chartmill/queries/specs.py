"""Scores of specifications: every part gives a reference and a guess of it, written by the same expressions in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartmill.operators import specs as S

_REF = """'{"mark":"' || CASE WHEN p_size % 2 = 0 THEN 'circle' ELSE 'bar' END || '","encoding":{"x":{"field":"' || p_brand || '","type":"nominal"},"y":{"aggregate":"mean","field":"size","type":"quantitative"}},"transform":[{"filter":"datum.size > ' || CAST(p_size AS STRING) || '"},{"sample":' || CAST(p_size AS STRING) || '}]}'"""
_GUESS = """'{"mark":"' || CASE p_partkey % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'bar' ELSE 'line' END || '","encoding":{"' || CASE WHEN p_partkey % 4 = 0 THEN 'y' ELSE 'x' END || '":{"field":"' || p_brand || '","type":"ordinal"},"' || CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE 'y' END || '":{"aggregate":"mean","field":"' || p_type || '","type":"quantitative"}}' || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"transform":[]' ELSE ',"transform":[{"filter":"datum.size > 7"}]' END || '}'"""


def _trees(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    sides = [part.select("p_partkey", F.expr(x).alias("spec")) for x in (_REF, _GUESS)]
    return part, *(S.nodes(side, "p_partkey", "spec") for side in sides)


def _score(item, where):
    """Scores of the items; ``item`` and ``where`` make columns."""

    def run(spark, sf):
        part, ref, guess = _trees(spark, sf)
        got = S.f_beta(part, "p_partkey", *(S.items(side, "p_partkey", item(), where()) for side in (ref, guess)))
        return got.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f", "jaccard")))

    return run


def _paths(spark, sf):
    part, ref, _ = _trees(spark, sf)
    return ref.where("leaf").groupBy(S.path_item().alias("item")).agg(F.count("*").alias("n"))


def _whole(of):
    def run(spark, sf):
        part, ref, guess = _trees(spark, sf)
        return of(part, "p_partkey", ref, guess).withColumn("f", F.round("f", 6))

    return run


def _picture(spark, sf):
    part, k = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_partkey")
    given = {c: (k + i) % (i + 3) - 1 for i, c in enumerate(S.PICTURE)}
    return part.select("p_partkey", S.picture_score(k % 10 == 0, **given).alias("score"))


#: A part's specification, request, and what is known of them; both engines read these.
_KNOWN = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '{{}}' WHEN 1 THEN NULL ELSE '{"mark":"bar"}' END AS guess,
  CASE p_partkey % 6 WHEN 0 THEN 'Draw a BAR chart of ' || p_name WHEN 1 THEN 'Scatter-plot: sizes' WHEN 2 THEN 'bars and lines' WHEN 3 THEN NULL WHEN 4 THEN 'pie?' ELSE p_name END AS request,
  p_partkey % 13 <> 0 AS drawable, CASE p_partkey % 4 WHEN 0 THEN NULL ELSE p_partkey % 4 = 1 END AS valid, p_partkey % 5 = 0 AS blank, p_size % 4 / 3.0 AS encoding, p_size % 3 / 2.0 AS mark,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 5 / 4.0 END AS transform, p_size % 2 AS of_reference, p_partkey % 3 AS of_guess FROM part""".replace("{{}}", "{}")


def _composite(spark, sf):
    """The shares are doubles: Spark would divide decimals, and cut them at six places."""
    known = spark.sql(_KNOWN.replace("FROM part", "FROM {part}").replace("3.0", "3D").replace("2.0", "2D").replace("4.0", "4D").replace('{"', '{{"').replace('"}', '"}}').replace("'{}'", "'{{}}'"), part=spark.read.parquet(f"{sf}/part.parquet"))
    f = {c: F.col(c).cast("double") for c in ("encoding", "mark", "transform")}
    score = S.composite_score(*(F.col(c) for c in ("guess", "request", "drawable", "valid", "blank")), f, {"reference": F.col("of_reference"), "guess": F.col("of_guess")})
    return known.select("p_partkey", score.alias("score"))


QUERIES = {
    "spc_composite": _composite,
    "spc_paths": _paths,
    "spc_full": _score(S.path_item, lambda: F.col("leaf")),
    "spc_key_values": _score(S.key_value_item, lambda: F.col("leaf")),
    "spc_keys": _score(lambda: F.col("name"), lambda: ~F.col("path").endswith("[*]")),
    "spc_transforms": _score(S.path_item, lambda: F.col("leaf") & F.col("path").startswith("$.transform")),
    "spc_encodings": _whole(S.encoding_scores),
    "spc_marks": _whole(S.mark_scores),
    "spc_picture": _picture,
}

_TREE = "SELECT p_partkey, regexp_replace(fullkey, '\\[\\d+\\]', '[*]', 'g') AS path, key AS name, type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('[]', '{{}}') AS leaf, CAST(value AS VARCHAR) AS value FROM part, json_tree(({spec})::JSON) WHERE fullkey <> '$'"


def _named(spec: str) -> str:
    """The tree with list places named after their list."""
    return "SELECT p_partkey, path, CASE WHEN path LIKE '%[*]' THEN regexp_extract(path, '([^.\\[\\]]+)(\\[\\*\\])+$', 1) ELSE name END AS name, leaf, value FROM (" + _TREE.format(spec=spec.replace("AS STRING", "AS VARCHAR")) + ")"


def _compared(items: dict[str, str], where: str, weight: str = "1.0", beta: str = "1.0", final: str = "") -> str:
    part = lambda name: f"r{name} AS (SELECT p_partkey, {items['r' + name]} AS item, sum({weight}) AS w FROM ref WHERE {where} GROUP BY 1, 2), g{name} AS (SELECT p_partkey, {items['g' + name]} AS item, sum({weight}) AS w FROM guess WHERE {where} GROUP BY 1, 2)"
    score = lambda name: f"""s{name} AS (SELECT p_partkey, coalesce(b / nullif(g, 0), 1.0) AS p, coalesce(b / nullif(r, 0), 1.0) AS q, s / nullif(a, 0) AS jaccard FROM part LEFT JOIN (
      SELECT coalesce(r.p_partkey, g.p_partkey) AS p_partkey, sum(r.w) AS r, sum(g.w) AS g, sum(least(coalesce(r.w, 0), coalesce(g.w, 0))) AS b, count(*) FILTER (WHERE r.w > 0 AND g.w > 0) AS s, count(*) AS a
      FROM r{name} r FULL JOIN g{name} g ON r.p_partkey = g.p_partkey AND r.item = g.item GROUP BY 1) USING (p_partkey)),
      f{name} AS (SELECT *, CASE WHEN p + q > 0 THEN (1 + {beta} * {beta}) * p * q / ({beta} * {beta} * p + q) ELSE 0 END AS f FROM s{name})"""  # noqa: E731
    names = sorted({k[1:] for k in items})
    ctes = ", ".join(f"{part(n)}, {score(n)}" for n in names)
    return f"WITH ref AS ({_named(_REF)}), guess AS ({_named(_GUESS)}), {ctes} " + (final or "SELECT p_partkey, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f, round(jaccard, 6) AS jaccard FROM f1")


_ITEM = "concat_ws('=', path, value)"
_SWAP = "concat_ws('=', CASE WHEN path LIKE '$.encoding.x.%' THEN '$.encoding.y.' || substring(path, 14) WHEN path LIKE '$.encoding.y.%' THEN '$.encoding.x.' || substring(path, 14) ELSE path END, value)"
_BOTH = "SELECT p_partkey, round({op}(f), 6) AS f FROM (SELECT p_partkey, f FROM f1 UNION ALL SELECT p_partkey, f FROM f2) GROUP BY 1"
_LOOSE = "CASE WHEN value IN ('\"circle\"', '\"square\"') THEN '\"point\"' ELSE value END"
ORACLES = {
    "spc_paths": f"SELECT {_ITEM} AS item, count(*) AS n FROM ({_named(_REF)}) WHERE leaf GROUP BY 1",
    "spc_full": _compared({"r1": _ITEM, "g1": _ITEM}, "leaf"),
    "spc_key_values": _compared({"r1": "concat_ws('=', name, value)", "g1": "concat_ws('=', name, value)"}, "leaf"),
    "spc_keys": _compared({"r1": "name", "g1": "name"}, "path NOT LIKE '%[*]'"),
    "spc_transforms": _compared({"r1": _ITEM, "g1": _ITEM}, "leaf AND path LIKE '$.transform%'"),
    "spc_encodings": _compared({"r1": _ITEM, "g1": _ITEM, "r2": _ITEM, "g2": _SWAP}, "leaf AND path LIKE '$.encoding.%'", "CASE WHEN name IN ('type', 'timeUnit') THEN 0.5 ELSE 1.0 END", "2.0", _BOTH.format(op="max")),
    "spc_marks": _compared({"r1": "value", "g1": "value", "r2": _LOOSE, "g2": _LOOSE}, "leaf AND path = '$.mark'", final=_BOTH.format(op="avg")),
    "spc_composite": f"""SELECT p_partkey, round(CASE WHEN guess IS NULL OR guess = '{{}}' OR NOT drawable THEN 0.0 ELSE (0.005 + CASE WHEN valid THEN 0.005 ELSE 0 END + CASE WHEN blank THEN 0 ELSE 0.005 END + we * encoding + wm * mark
      + CASE WHEN of_reference > 0 THEN coalesce(transform, 0) WHEN of_guess > 0 THEN 0 ELSE 0.005 END) / (0.005 + CASE WHEN valid THEN 0.005 ELSE 1 END + CASE WHEN blank THEN 1000 ELSE 0.005 END + we + wm
      + CASE WHEN of_reference = 0 AND of_guess = 0 THEN 0.005 ELSE 1 END) END, 6) AS score FROM (SELECT *, CASE WHEN of_reference = 0 AND of_guess > 0 THEN 2.25 ELSE 3.0 END AS we,
      CASE WHEN regexp_matches(lower(coalesce(request, '')), '(^|[^a-z])({"|".join(S.MARK_WORDS)})([^a-z]|$)') THEN 1.0 ELSE 0.5 END AS wm FROM ({_KNOWN}))""",
    "spc_picture": "SELECT p_partkey, round((" + " + ".join(f"greatest(0, least(2, (p_partkey + {i}) % {i + 3} - 1)) / 2 * {w}" for i, w in enumerate(S.PICTURE.values())) + f") / CASE WHEN p_partkey % 10 = 0 THEN {sum(S.PICTURE.values()) + 1000} ELSE {sum(S.PICTURE.values())} END, 6) AS score FROM part",
}
