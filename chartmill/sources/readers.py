"""Table readers and writers: CSV with an encoding found by strict decoding, Parquet, JSON lines, JSON containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings in the order in which they are tried, and the keys under which a container may hold its records.
ENCODINGS = ["utf-8", "utf-8-sig", "cp1251", "latin1"]
CONTAINER_KEYS = ["records", "data", "items", "examples", "tasks", "questions"]


class TableReadError(ValueError):
    """A file that no reader can take."""


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes every file of the path without an error; files are tested where they lie."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            fits = []
            for content in pdf["content"]:
                own = []
                for e in ENCODINGS:
                    try:
                        bytes(content).decode(e)
                        own.append(e)
                    except UnicodeDecodeError:
                        pass
                fits.append(own)
            yield pd.DataFrame({"fits": fits})

    files = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "fits array<string>")
    counts = {r["e"]: r["n"] for r in files.select(F.explode("fits").alias("e")).groupBy("e").agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=0)
    for e in ENCODINGS:
        if counts.get(e) == most and most:
            return e
    raise TableReadError(f"no encoding fits {path}")


#: Delimiters that are told apart, the first on a tie of none, and characters that are looked at.
DELIMITERS, SNIFFED = [",", ";", "\t", "|"], 4096


def dialect_of(content: bytes) -> tuple[str, str]:
    """(encoding, delimiter) of one file: the first encoding that decodes all of it, and the delimiter that splits its first lines most evenly into most fields."""
    import csv

    for encoding in ENCODINGS:
        try:
            text = content.decode(encoding).removeprefix("\ufeff")
            break
        except UnicodeDecodeError:
            pass
    whole = text[:SNIFFED].rpartition("\n")[0] or text[:SNIFFED]

    def evenness(delimiter: str) -> tuple[int, int]:
        widths = [len(row) for row in csv.reader(whole.splitlines(), delimiter=delimiter) if row]
        return (1, widths[0]) if widths and len(set(widths)) == 1 and widths[0] > 1 else (0, max(widths, default=0) if len(set(widths)) > 1 else 0)

    best = max(DELIMITERS, key=evenness)  # the first of equals
    return encoding, best if evenness(best) > (0, 0) else ","


def read_files(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Rows of CSV files as text columns, each file read by its own encoding and delimiter, with ``file``, ``encoding`` and ``delimiter``.

    Columns are matched by name; the union of all headers (or ``header``) gives the columns, and what a file lacks is null. A file is the unit of a task, so a folder
    of any number of files is read in parallel. Short rows are filled with nulls, further cells of long ones go; empty files have no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parsed(content: bytes):
        import csv
        import io

        encoding, delimiter = dialect_of(content)
        rows = csv.reader(io.StringIO(content.decode(encoding).removeprefix("\ufeff"), newline=""), delimiter=delimiter)
        return encoding, delimiter, rows

    def names(batches):
        import pyarrow as pa

        for batch in batches:
            found = [[n.strip() for n in next(parsed(c)[2], [])] for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(enumerate(f)) for f in found], pa.list_(pa.struct([("place", pa.int32()), ("name", pa.string())])))], ["names"])

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                encoding, delimiter, rows = parsed(content)
                own = [n.strip() for n in next(rows, [])]
                at = {n: own.index(n) for n in columns if n in own}
                values = [r for r in rows if r]
                for a in range(0, len(values), 10_000):
                    some = values[a : a + 10_000]
                    made = [pa.array([r[at[n]] if n in at and at[n] < len(r) else None for r in some], pa.string()) for n in columns]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(some)) for x in (where, encoding, delimiter)), *made], ["file", "encoding", "delimiter", *columns])

    if header is None:
        seen = files.mapInArrow(names, "names array<struct<place:int,name:string>>").select(F.explode("names").alias("n")).groupBy("n.name").agg(F.min("n.place").alias("place"))
        header = [r["name"] for r in seen.orderBy("place", "name").collect()]  # names of columns alone
    columns = [n for n in header if n not in ("file", "encoding", "delimiter")]
    return files.mapInArrow(cells, "file string, encoding string, delimiter string" + "".join(f", `{n.replace('`', '``')}` string" for n in columns))


def read_table(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        df = spark.read.parquet(path)
    elif suffix in ("csv", "txt"):
        names = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp1251": "windows-1251", "latin1": "ISO-8859-1"}
        found = names[encoding_of(spark, path)]
        if found == "windows-1251":  # beyond the charsets that Spark takes unless told
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        df = spark.read.csv(path, header=True, inferSchema=True, encoding=found)
        df = df.toDF(*(c.removeprefix("﻿") for c in df.columns))
    elif suffix in ("jsonl", "ndjson"):
        df = spark.read.json(path, mode="FAILFAST")
    else:
        raise TableReadError(f"unsupported format {suffix!r}")
    return df.limit(rows) if rows is not None else df


def read_lenient_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as ``record`` (variant); a line that is no JSON becomes an object with its text; blank lines go."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    plain = F.parse_json(F.to_json(F.struct(F.col("value").alias("text"))))
    return lines.select(F.coalesce(F.try_parse_json("value"), plain).alias("record"))


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files that hold a list, or a list under one of the known keys."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in CONTAINER_KEYS]
    return whole.select(F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists)).alias("record"))


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), "modificationTime", F.sha2("content", 256).alias("sha256"))


def write_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def write_by(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(column).parquet(path)
