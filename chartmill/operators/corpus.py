"""Corpus preparation: exact and vector de-duplication, quotas, splits and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartmill.functions.text import compact, plain_words


def _kept(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder the cluster names; in local mode without one, keep the plan."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def content_key(*parts: Column, most: int | None = 300) -> Column:
    """Hash of the parts, lower-cased, with white space collapsed; ``most``: characters of a part that count (null: all)."""
    said = [compact(p, most) if most else F.trim(F.regexp_replace(F.coalesce(p, F.lit("")), r"\s+", " ")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.lower(x), F.lit("")) for x in said)), 256), 1, 16)


def first_of_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; keys may be hot, so the choice is an aggregate of the order columns and not a sort of the group."""
    keyed = df.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    return keyed.join(firsts, "_key").where(F.struct(*order) == F.col("_first")).drop("_key", "_first")


def within_quota(df: DataFrame, group: str, order: list[str], quota: int) -> DataFrame:
    """The first ``quota`` rows of each group; ranks are limited while they are computed, so a hot group isn't kept whole."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= quota).drop("_r")


def split(df: DataFrame, stratum: str, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``split`` is train or test: of each stratum the share ``ratio`` (rounded half to even, one of each kind at least) by hash order.

    A stratum is ranked in buckets by the first three digits of the hash, after the counts of the buckets before, so a stratum of most rows
    is sorted in thousands of parts. Rows without a stratum are a stratum.
    """
    digest = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    keyed = df.withColumn("_o", digest).withColumn("_b", F.substring("_o", 1, 3))
    counts = keyed.groupBy(F.col(stratum).alias("_stratum"), F.col("_b").alias("_bucket")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy("_stratum")
    before = F.coalesce(F.sum("_c").over(own.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("_stratum", "_bucket", before.alias("_before"), F.sum("_c").over(own).alias("_n"))
    placed = keyed.join(places, keyed[stratum].eqNullSafe(places["_stratum"]) & (keyed["_b"] == places["_bucket"]))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o", key))
    n = F.col("_n")
    take = F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.bround(n * ratio))))
    return placed.withColumn("split", F.when(rank <= take, "train").otherwise("test")).select(*(F.col(f"`{c}`") for c in df.columns if c != "split"), "split")


def noise_reason(text: Column, least_chars: int, low_value: list[str]) -> Column:
    """Why a text is left out (null: it stays); the first reason holds."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(F.char_length(text) < least_chars, "short")
        .when(plain_words(text).isin(low_value), "low value")
        .when(text.rlike(r"(?i)lorem ipsum|click here|subscribe now"), "noise")
    )


def vector_leaders(df: DataFrame, group: str, key: str, vector: str, threshold: float = 0.95, block: int = 1200) -> DataFrame:
    """Greedy leaders by key in each group: a row within the threshold of an earlier leader is its duplicate.

    Groups beyond ``block`` rows are cut into about as large blocks by key. Block after block finds its own leaders, and the later rows of the group are
    compared with these in salted parts, so the result is that of the whole group and a task holds a block and a part.
    """
    import numpy as np
    import pandas as pd

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        v = np.array(pdf["_v"].tolist(), np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        v = unit(pdf)
        leaders: list[int] = []
        of = []
        for i in range(len(v)):
            near = np.flatnonzero(v[leaders] @ v[i] >= threshold) if leaders else []
            of.append(pdf["_key"].iloc[leaders[near[0]]] if len(near) else None)
            if not len(near):
                leaders.append(i)
        return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "duplicate_of": pd.array(of, "Int64")})

    def follow(rest: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        of: list = [None] * len(rest)
        if len(rest) and len(leaders):
            leaders = leaders.sort_values("_key")
            heads, keys = unit(leaders), leaders["_key"].to_numpy()
            for i, v in enumerate(unit(rest)):
                near = np.flatnonzero(heads @ v >= threshold)
                of[i] = keys[near[0]] if len(near) else None
        return rest.assign(duplicate_of=pd.array(of, "Int64"))

    rows = df.select(F.col(group).alias("_g"), F.col(key).cast("long").alias("_key"), F.col(vector).alias("_v"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"))
    found = rows.join(sizes.where(F.col("n") <= block).select("_g"), "_g").groupBy("_g").applyInPandas(lead, "_key long, duplicate_of long")
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most > block:
        n_blocks = -(-most // block)
        cuts = F.percentile_approx("_key", [i / n_blocks for i in range(1, n_blocks)], 100_000).alias("cuts")
        large = sizes.where(F.col("n") > block)
        cut = rows.join(large, "_g").groupBy("_g").agg(cuts, F.count("*").alias("n"))
        before = F.when(F.col("_key").isNull(), n_blocks - 1).otherwise(F.size(F.filter("cuts", lambda c: c < F.col("_key"))))
        salt = F.pmod(F.xxhash64("_key"), F.ceil(F.col("n") / (4 * block)))
        rest = _kept(rows.join(cut, "_g").select("_g", "_key", "_v", before.alias("_b"), salt.alias("_s"), "n"))
        schema = "_g {}, _key long, _v {}, _b int, _s long, n long, duplicate_of long".format(*(rest.schema[c].dataType.simpleString() for c in ("_g", "_v")))
        for b in range(n_blocks):
            own = rest.where(F.col("_b") == b)
            led = _kept(own.groupBy("_g").applyInPandas(lead, "_key long, duplicate_of long"))
            found = found.unionByName(led)
            heads = own.join(led.where("duplicate_of is null").select("_key"), "_key")
            parts = heads.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / (4 * block)) - 1)))
            later = rest.where(F.col("_b") > b).groupBy("_g", "_s").cogroup(parts.toDF(*parts.columns).groupBy("_g", "_s"))
            after = _kept(later.applyInPandas(follow, schema))
            found = found.unionByName(after.where("duplicate_of is not null").select("_key", "duplicate_of"))
            rest = after.where("duplicate_of is null").drop("duplicate_of")
    return df.join(found, df[key] == found["_key"], "left").drop("_key")


#: The thresholds of a sweep.
SWEEP = [0.90, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98]


def threshold_sweep(df: DataFrame, group: str, key: str, vector: str, thresholds: list[float] | None = None, block: int = 1200) -> DataFrame:
    """(key, duplicates): for each threshold, in the order given, the first earlier leader of the row's group that is as near, or null; as :func:`vector_leaders` finds it for that one.

    The greedy runs of all thresholds go over the rows together: a similarity is computed once, and only with rows that lead at some threshold. Groups are cut into blocks
    of about ``block`` rows by key; a block is led, then the group's later rows meet its leaders in salted parts. A row without a key or a vector is no duplicate and no leader.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    bars = np.array(thresholds or SWEEP)
    nothing = F.expr(f"cast(array_repeat(null, {len(bars)}) as array<long>)")

    def unit(column) -> np.ndarray:
        v = np.array(column.to_pylist(), np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def own_type(rows: pa.Table, of: list) -> pa.Table:
        return rows.set_column(rows.column_names.index("duplicates"), "duplicates", pa.array(of, pa.list_(pa.int64()))).select(names).cast(arrow)

    def lead(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_key")
        v, keys, of = unit(rows["_v"]), rows["_key"].to_pylist(), rows["duplicates"].to_pylist()
        leads = np.zeros((len(v), len(bars)), bool)
        some: list[int] = []  # rows that lead at some threshold
        for i in range(len(v)):
            near = (v[some] @ v[i])[:, None] >= bars if some else np.zeros((0, len(bars)), bool)
            near &= leads[some]
            for t in np.flatnonzero(near.any(axis=0)):
                if of[i][t] is None:
                    of[i][t] = keys[some[int(near[:, t].argmax())]]
            leads[i] = [x is None for x in of[i]]
            if leads[i].any():
                some.append(i)
        return own_type(rows, of)

    def follow(rest: pa.Table, heads: pa.Table) -> pa.Table:
        if not all("_v" in side.column_names and side.num_rows for side in (rest, heads)):  # a side without rows comes without columns
            return own_type(rest, rest["duplicates"].to_pylist()) if "_v" in rest.column_names else arrow.empty_table()
        heads = heads.sort_by("_key")
        keys, of = heads["_key"].to_pylist(), rest["duplicates"].to_pylist()
        leads = np.array([[x is None for x in d] for d in heads["duplicates"].to_pylist()])
        led = unit(heads["_v"])
        for row, v in zip(of, unit(rest["_v"]), strict=True):
            near = ((led @ v)[:, None] >= bars) & leads
            for t in np.flatnonzero(near.any(axis=0)):
                if row[t] is None:
                    row[t] = keys[int(near[:, t].argmax())]
        return own_type(rest, of)

    rows = df.select(F.col(group).alias("_g"), F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_v")).where("_key is not null and _v is not null")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-most // block))
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")  # blocks of the group
    places = F.percentile_approx("_key", [i / blocks for i in range(1, blocks)] or [0.5], 100_000).alias("_c")
    cuts = rows.groupBy(F.col("_g").alias("_h")).agg(places, F.count("*").alias("n"))
    before = F.when(n == 1, 0).otherwise(F.size(F.filter("_c", lambda c: c < F.col("_key"))))
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * block))).cast("int")
    at = rows.join(cuts, F.col("_g").eqNullSafe(F.col("_h"))).select("_g", "_key", "_v", before.alias("_b"), F.pmod(F.xxhash64("_key"), salts).cast("int").alias("_s"), salts.alias("_n"), nothing.alias("duplicates"))
    names, schema = at.columns, at.schema
    arrow = to_arrow_schema(schema)
    rest, found = _kept(at), None
    for b in range(blocks):
        led = _kept(rest.where(F.col("_b") == b).groupBy("_g").applyInArrow(lead, schema))
        found = led if found is None else found.unionByName(led)
        if b + 1 < blocks:
            heads = led.where(F.exists("duplicates", lambda x: x.isNull())).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
            later = rest.where(F.col("_b") > b).groupBy("_g", "_s").cogroup(heads.groupBy("_g", "_s"))
            rest = _kept(later.applyInArrow(follow, schema))
    out = found.select(F.col("_key").alias(key), "duplicates")
    other = df.where(F.col(key).cast("long").isNull() | F.col(vector).isNull()).select(F.col(key).cast("long").alias(key), nothing.alias("duplicates"))
    return out.unionByName(other)


def sweep_report(swept: DataFrame, key: str, must_go: DataFrame, must_stay: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(threshold, kept, removed, missed, lost, status, recommended) of a sweep against rows whose fate is known, by their keys.

    A threshold passes (PASS, else WARN) if no row of ``must_go`` is kept and none of ``must_stay`` removed; the greatest that passes is recommended.
    """
    bars = thresholds or SWEEP
    fates = [F.broadcast(d.select(key).distinct().withColumn(n, F.lit(True))) if d.count() <= 1_000_000 else d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((must_go, "_go"), (must_stay, "_stay"))]
    known = swept.join(fates[0], key, "left").join(fates[1], key, "left")
    each = known.select("_go", "_stay", F.posexplode(F.transform("duplicates", lambda d: d.isNotNull())).alias("_t", "_removed"))
    out = each.groupBy("_t").agg(
        F.count_if(~F.col("_removed")).alias("kept"), F.count_if("_removed").alias("removed"), F.count_if(F.col("_go") & ~F.col("_removed")).alias("missed"), F.count_if(F.col("_stay") & F.col("_removed")).alias("lost")
    )
    out = out.withColumn("threshold", F.array(*map(F.lit, bars))[F.col("_t")]).withColumn("status", F.when((F.col("missed") == 0) & (F.col("lost") == 0), "PASS").otherwise("WARN"))
    best = F.max(F.when(F.col("status") == "PASS", F.col("threshold"))).over(Window.partitionBy())  # one row for each threshold
    return out.select("threshold", "kept", "removed", "missed", "lost", "status", F.coalesce(F.col("threshold") == best, F.lit(False)).alias("recommended"))
