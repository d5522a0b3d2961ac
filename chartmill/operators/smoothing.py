"""Locally weighted regression (loess) over range partitions.

Rows get their places by group and x: a range partitioning, sorted inside, with the counts of earlier partitions added. Runs of ``BLOCK`` places
are fitted together with the rows within ``neighbours`` places of them on both sides, so a task holds at most three times the greater of both,
however large a group is. The window's size is a number of rows and not a share of the group: a share would grow with the data, and its work with
the square. There are no rounds that weigh outliers down.

Defined cases: rows whose x or y is null, NaN or infinite are left out; a null group is a group; a group with fewer rows than ``neighbours`` is one
window; where all x of a window are equal the fit is their mean; of rows with equal x, those of smaller y come first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BLOCK = 4096
#: Weights that are held at once.
HELD = 1 << 20


def placed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_place`` from 0 in each group and ``_n``, its size; rows that tie are dealt apart too."""
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [*groups, *order, "_tie"]
    ordered = cut(spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    runs = ordered.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), "_first", before.alias("_before"), F.sum("_rows").over(group).alias("_n"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ordered.join(runs, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("_place"), "_n")


def fit(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, k: int) -> np.ndarray:
    """Fits at the places ``wanted`` of rows sorted by x, each from the ``k`` nearest rows, which are neighbours in that order."""
    middle = (x[:-k] + x[k:]) / 2  # a window moves on once the row behind it is as near as its first
    lows = np.minimum(np.searchsorted(middle, x[wanted], side="right"), np.minimum(wanted, len(x) - k))
    out = np.empty(len(wanted))
    for a in range(0, len(wanted), step := max(1, HELD // k)):
        at = lows[a : a + step, None] + np.arange(k)
        far, seen = x[at] - x[wanted[a : a + step], None], y[at]
        reach = np.maximum(np.abs(far[:, :1]), np.abs(far[:, -1:]))
        weight = (1 - np.minimum(np.abs(far) / np.where(reach > 0, reach, 1), 1) ** 3) ** 3
        total = weight.sum(1)
        mx, my, mxy, mxx = ((weight * v).sum(1) / total for v in (far, seen, far * seen, far * far))
        spread = mxx - mx * mx
        slope = np.where(spread > 1e-12 * mxx, (mxy - mx * my) / np.where(spread > 0, spread, 1), 0)
        out[a : a + step] = my - slope * mx
    return out


def loess(df: DataFrame, x: str, y: str, groups: list[str], neighbours: int, name: str = "loess") -> DataFrame:
    """(groups, x, ``name``): for each row the tricube-weighted line through its ``neighbours`` nearest rows of the group, itself included."""
    if neighbours < 2:
        raise ValueError("a line needs two rows")
    inner = [f"_k{i}" for i in range(len(groups))]
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(*(F.col(g).alias(i) for g, i in zip(groups, inner, strict=True)), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where(known("_x") & known("_y"))
    size = max(BLOCK, neighbours)
    own = F.floor(F.col("_place") / size)
    since = F.col("_place") - own * size
    near = F.array_compact(F.array(F.when((since < neighbours) & (own > 0), own - 1), own, F.when(size - since <= neighbours, own + 1)))
    dealt = placed(rows, inner, ["_x", "_y"]).withColumn("_block", F.explode(near))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place", ignore_index=True)
        wanted = np.flatnonzero(part["_place"].to_numpy() // size == part["_block"].to_numpy())
        out = part.loc[wanted, [*inner, "_x"]]
        k = min(neighbours, int(part["_n"].iloc[0]))
        return out.assign(_f=fit(part["_x"].to_numpy(), part["_y"].to_numpy(), wanted, k) if len(wanted) else np.empty(0))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_y")
    fitted = dealt.groupBy(*inner, "_block").applyInPandas(run, f"{kinds}, _f double")
    return fitted.select(*(F.col(i).alias(g) for g, i in zip(groups, inner, strict=True)), F.col("_x").alias(x), F.col("_f").alias(name))
