"""Helpers that the operators share: table access, the word rule, checkpoints."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_with(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """The schema of ``df`` and further columns, which take the place of columns of their names; ``df.schema`` itself stays as it is."""
    names = {name for name, _ in more}
    schema = StructType([f for f in df.schema.fields if f.name not in names])
    for name, kind in more:
        schema = schema.add(StructType.fromDDL(f"`{name}` {kind}").fields[0])
    return schema


def beside(df: DataFrame, keep: list[str], made: dict[str, str], make) -> DataFrame:
    """The columns ``keep`` of ``df`` just as they are and the columns ``made`` (name to type), which ``make(batch)`` gives in order.

    What is kept stays in Arrow: pandas would turn whole numbers beside a null into floating point.
    """
    schema = schema_with(df.select(*(F.col(f"`{c}`") for c in keep)), *made.items())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            new = dict(zip(made, make(batch), strict=True))
            columns = [pa.array(new[f.name], kinds.field(f.name).type) if f.name in new else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8; ``bytes.split`` breaks at exactly the six characters of :data:`WORD_BREAK`."""
    return text.encode().split() if text else []


def words_column(text: Column) -> Column:
    """The same words as an array column; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text: equal texts share them, and they are the same in a recomputed task."""
    return F.xxhash64(text), F.xxhash64(F.lit("key"), text)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, read from the session; one is set only where there is none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: compressed (by the session's codec, if none is named), and read column by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Empty tables that :func:`written` made and nothing reads any more: an overwrite without rows, which works in any store Spark writes to."""
    for df in tables:
        folder = df.inputFiles()
        if folder:
            df.limit(0).write.mode("overwrite").parquet(folder[0].rsplit("/", 1)[0])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished phases; it does so once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has been counted to hold at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def blocks(texts: list[str | None], chars: int):
    """Runs of texts of about so many characters; a longer text is a run of its own."""
    at, total = 0, 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield texts[at : k + 1]
            at, total = k + 1, 0
    if at < len(texts):
        yield texts[at:]


def sql_words(text: str) -> str:
    """DuckDB expression for the words of a text expression."""
    return rf"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

