"""Cutting lineage in rounds, dealing rows over tasks, and numbering rows without gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names in spark.checkpoint.dir; only a local session without one gets its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all tasks of a shuffle, for work that is heavy in each row: the rows of a small file, or small rows of a shuffle, would meet in one task."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with ``name`` from 0 without gaps, in any order, and the number of rows. The driver sees one count for each partition."""
    placed = cut(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before, first = 0, []
    for part, n in sorted(placed.groupBy("_part").count().collect()):
        first.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(first, "_part long, _before long")
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_at", "_part", "_before"), before
