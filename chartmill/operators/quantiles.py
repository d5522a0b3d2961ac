"""Exact quantiles, interpolated linearly, without the values of a group in one task.

Sketches of a group's values give a narrow band around each place that is asked for. One pass counts what lies below the bands and reduces the
values inside them to counts; only these are put in order. Whether a band holds its place is counted; where a sketch missed, the band takes all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Accuracy of the sketches, and half the width of a band as a share of the rows.
ACCURACY, REACH = 10_000, 0.0005
#: Rows of bands that are broadcast, at most.
SENT = 100_000


def exact(df: DataFrame, groups: list[str], values: list[tuple[str, Column, float]]) -> DataFrame:
    """``groups`` and, for each (name, number, share), the quantile of the number's values that aren't null; null if there are none."""
    keys = [f"_g{i}" for i in range(len(groups))]
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.select(*(F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys, strict=True)), *(x.cast("double").alias(n) for (_, x, _), n in zip(values, names, strict=True)))
    figures = []
    for n, (_, _, p) in zip(names, values, strict=True):
        figures.append(F.count(n).alias(f"{n}_n"))
        for end, share in (("lo", p - REACH), ("hi", p + REACH)):
            figures.append((F.percentile_approx(n, share, ACCURACY) if 0 < share < 1 else F.lit(None).cast("double")).alias(f"{n}_{end}"))
    bands = cut(rows.groupBy(*keys).agg(*figures))
    sent = F.broadcast if bands.count() <= SENT else lambda b: b
    for n in names:  # a band without an end reaches to the end
        bands = bands.withColumns({f"{n}_lo": F.coalesce(f"{n}_lo", F.lit(-math.inf)), f"{n}_hi": F.coalesce(f"{n}_hi", F.lit(math.nan))})

    def beside(bands: DataFrame) -> DataFrame:
        right = bands.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in bands.columns if c not in keys))
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return rows.join(sent(right), same) if keys else rows.crossJoin(F.broadcast(right))

    places = {n: (F.col(f"{n}_n") - 1) * F.lit(p) for n, (_, _, p) in zip(names, values, strict=True)}
    counts = [c for n in names for c in (F.count_if(F.col(n) < F.col(f"{n}_lo")).alias(f"{n}_below"), F.count_if(F.col(n) <= F.col(f"{n}_hi")).alias(f"{n}_up"))]
    counted = cut(beside(bands).groupBy(*keys, *(c for c in bands.columns if c not in keys)).agg(*counts))
    for n in names:
        held = (F.col(f"{n}_below") <= F.floor(places[n])) & (F.col(f"{n}_up") > F.ceil(places[n]))
        counted = counted.withColumns({f"{n}_lo": F.when(held, F.col(f"{n}_lo")).otherwise(-math.inf), f"{n}_hi": F.when(held, F.col(f"{n}_hi")).otherwise(math.nan), f"{n}_below": F.when(held, F.col(f"{n}_below")).otherwise(0)})
    inside = [F.when(F.col(n).between(F.col(f"{n}_lo"), F.col(f"{n}_hi")), F.struct(F.lit(i).alias("i"), F.col(n).alias("v"), (F.col(f"{n}_below")).alias("below"), places[n].alias("place"))) for i, n in enumerate(names)]
    near = beside(counted).select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("x")).select(*keys, "x.*")
    kinds = near.groupBy(*keys, "i", "below", "place", "v").agg(F.count("*").alias("c"))
    after = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v"))
    ends = (F.min(F.when(F.col("after") > f("place"), F.col("v"))).alias(a) for a, f in (("a", F.floor), ("b", F.ceil)))
    found = kinds.withColumn("after", after).groupBy(*keys, "i", "place").agg(*ends)
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - share) * F.col("a") + share * F.col("b"))
    wide = found.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    whole = bands.select(*(F.col(k).alias(f"_{k}") for k in keys)).join(wide, same, "left") if keys else bands.select(F.lit(0)).join(wide, how="left")
    return whole.select(*(F.col(f"_{k}").alias(g) for g, k in zip(groups, keys, strict=True)), *(F.col(n).alias(name) for n, (name, _, _) in zip(names, values, strict=True)))
