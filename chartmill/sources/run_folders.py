"""Folders of runs, one below the root for each run: logs in whichever layout a run has, and the latest artifact of a name.

A run keeps its stages or model calls as one table, as two tables that share a key, or as JSON, by its age. Each layout is read for all runs at once into the same
columns, and of every run only the rows of the first layout that gives any stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layouts from the preferred one down. A layout is a kind, its files below a run's folder (a pattern), and for two tables their common key.
STAGES = [
    ("table", "stages.csv", None),
    ("split", ("stage_timings.csv", "stage_tokens.csv"), "execution_index"),
    ("json", "artifacts/(.*/)?[^/]*stage_execution[^/]*[.]json", None),
    ("json", "stage_executions/[^/]*[.]json", None),
]
CALLS = [
    ("table", "model_calls.csv", None),
    ("json", "model_calls/[^/]*[.]json", None),
    ("split", ("model_call_tokens.csv", "model_call_timings.csv"), "call_index"),
    ("list", "artifacts/model_call_logs[.]json", None),
]
# Folders that hold no artifacts, and what may follow an artifact's name.
NO_ARTIFACTS = ["model_calls", "stage_executions"]
ATTEMPTS = ["_semantic_", "_technical_", "_attempt_"]
TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens"]


def _files(spark: SparkSession, root: str, names: str) -> DataFrame:
    """(run, file, content) of the files below the runs' folders whose names fit the glob; ``file`` is the path inside the run."""
    inside = rf"^.*?\Q{re.sub('^file:(//)?', '', root).rstrip('/')}\E/([^/]+)/(.+)$"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return found.select(F.regexp_extract("path", inside, 1).alias("run"), F.regexp_extract("path", inside, 2).alias("file"), "content").where("run <> ''")


def _table_rows(files: DataFrame) -> DataFrame:
    """(run, file, place, cells) of the rows of CSV files; a file that isn't UTF-8 has none, further cells of long rows go."""

    def rows(batches):
        import csv
        import io

        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]
        names = ["run", "file", "place", "cells"]
        for batch in batches:
            for run, file, content in zip(*(batch.column(c).to_pylist() for c in ("run", "file", "content")), strict=True):
                try:
                    read = csv.DictReader(io.StringIO(content.decode("utf-8"), newline=""), restkey="")
                except UnicodeDecodeError:
                    continue
                out = []
                for place, row in enumerate(read, 1):
                    out.append((run, file, place, [(k, v) for k, v in row.items() if k]))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(rows, "run string, file string, place long, cells map<string,string>")


def _joined(rows: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Rows of two tables with one key as one: the last row of the first table, whose cells those of the second replace unless they are blank. Rows without a key go."""
    at = rows.withColumn("_k", F.col("cells")[key]).where("_k <> ''")
    left = at.where(F.col("file") == first).groupBy("run", "_k").agg(F.max_by("cells", "place").alias("_left"))
    cells = at.where(F.col("file") == second).select("run", "_k", "place", F.explode("cells").alias("name", "value")).where("value <> ''")
    right = cells.groupBy("run", "_k", "name").agg(F.max_by("value", "place").alias("value"))
    right = right.groupBy("run", "_k").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_right"))  # as many entries as a row has cells
    none = F.expr("cast(map() as map<string,string>)")
    l, r = F.coalesce("_left", none), F.coalesce("_right", none)  # noqa: E741
    both = F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(r, k)), r)
    return left.join(right, ["run", "_k"], "full").select("run", F.lit(f"{first}+{second}").alias("file"), F.expr("try_cast(_k AS long)").alias("place"), both.alias("cells"))


def _whole(c: Column) -> Column:
    """A count from whatever a cell says: whole part, and 0 for blank cells and other text."""
    return F.coalesce(F.floor(c).cast("long"), F.lit(0).cast("long"))


def run_logs(spark: SparkSession, root: str, layouts: list[tuple]) -> DataFrame:
    """(run, layout, file, place, record, prompt_tokens, completion_tokens, total_tokens) of the logs below ``root``, by :data:`STAGES` or :data:`CALLS`.

    ``layout`` is the number of the layout from 0, ``record`` the row or object as variant. Files that are no JSON, and values in them that are no objects, go. An empty
    file gives no rows, so the run's next layout holds.
    """
    tables = sorted({n for kind, names, _ in layouts if kind in ("table", "split") for n in ([names] if kind == "table" else names)})
    cells = _table_rows(_files(spark, root, "{" + ",".join(tables) + "}").where(F.col("file").isin(tables)))
    texts = _files(spark, root, "*.json").select("run", "file", F.try_parse_json(F.expr("try_validate_utf8(cast(content AS string))")).alias("record"))
    out = None
    for number, (kind, names, key) in enumerate(layouts):
        if kind in ("table", "split"):
            rows = cells.where(F.col("file") == names) if kind == "table" else _joined(cells.where(F.col("file").isin(*names)), *names, key)
            usage = [_whole(F.expr(f"try_cast(cells['{t}'] AS double)")).alias(t) for t in TOKENS]
            rows = rows.select("run", F.lit(number).alias("layout"), "file", "place", F.parse_json(F.to_json("cells")).alias("record"), *usage)
        else:
            rows = texts.where(F.col("file").rlike(f"^{names}$"))
            if kind == "list":
                each = rows.select("run", "file", F.posexplode(F.try_variant_get("record", "$", "array<variant>")).alias("_p", "record"))
                rows = each.select("run", F.concat("file", F.lit("#"), F.col("_p") + 1).alias("file"), (F.col("_p") + 1).cast("long").alias("place"), "record")
            else:
                rows = rows.withColumn("place", F.lit(None).cast("long"))
            usage = [_whole(F.try_variant_get("record", f"$.token_usage.{t}", "double")).alias(t) for t in TOKENS]
            rows = rows.where(F.schema_of_variant("record").startswith("OBJECT")).select("run", F.lit(number).alias("layout"), "file", "place", "record", *usage)
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy("run").agg(F.min("layout").alias("layout"))  # reduced before the shuffle: a run may hold any share of the rows
    return out.join(first, ["run", "layout"]).select("run", "layout", "file", "place", "record", *TOKENS)


def latest_artifacts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(run, name, file, payload) of each run's last JSON artifact of each of the names, by the path's parts.

    A number of three to six digits before a name doesn't count, nor does what an attempt adds behind it. A last file that is no JSON has a null payload; it isn't passed over.
    """
    files = _files(spark, root, "*.json").where(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, NO_ARTIFACTS))))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)[.]json$", 1), r"^\d{3,6}_", "")
    named = files.withColumn("name", F.explode(F.array(*map(F.lit, names)))).where((stem == F.col("name")) | F.greatest(*(F.startswith(stem, F.concat("name", F.lit(a))) for a in ATTEMPTS)))
    last = named.groupBy("run", "name").agg(F.max_by(F.struct("file", "content"), F.split("file", "/")).alias("_f"))
    return last.select("run", "name", F.col("_f.file").alias("file"), F.try_parse_json(F.expr("try_validate_utf8(cast(_f.content AS string))")).alias("payload"))


def stage_summary(logs: DataFrame) -> DataFrame:
    """(run, layout, stage_count, stage_total_tokens, stage_duration_seconds) from the rows of :func:`run_logs`."""
    text = F.try_variant_get("record", "$.duration_seconds", "string")
    seconds = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return logs.groupBy("run", "layout").agg(F.count("*").alias("stage_count"), F.sum("total_tokens").alias("stage_total_tokens"), F.sum(seconds).alias("stage_duration_seconds"))
