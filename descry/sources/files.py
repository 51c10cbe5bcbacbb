"""Readers and writers with the dialects that real files come in."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dialects, in the order in which they are tried.
ENCODINGS = ["UTF-8", "ISO-8859-1"]
SEPARATORS = [",", ";"]


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    return spark.createDataFrame(frame)


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(
    spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", rows: int | None = None, malformed: str = "PERMISSIVE",
    schema: str | None = None, null_value: str | None = None,
) -> DataFrame:
    """A CSV file with a header; types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", malformed)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    out = reader.csv(path)
    return out if rows is None else out.limit(rows)


def csv_any(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The first dialect that gives more than one column and no broken characters in the names; malformed lines are left out."""
    last = None
    for encoding in ENCODINGS:
        for sep in SEPARATORS:
            # names first, without a pass for the types
            names = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
            if len(names.columns) > 1 and not broken(names):
                return csv(spark, path, sep, encoding, rows, "DROPMALFORMED")
            last = last or names
    return csv(spark, path, rows=rows)


def broken(df: DataFrame) -> bool:
    """Whether a name or any value holds the mark that stands for bytes that the encoding doesn't know; one pass over the whole file, up to the first."""
    mark = "\ufffd"
    return any(mark in c for c in df.columns) or not df.where(
        F.concat_ws("", *[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).contains(mark)
    ).isEmpty()


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, bytes) of the files below a folder, largest first; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.col("length").alias("bytes")).orderBy(F.desc("bytes"), "path")


def largest_csv(spark: SparkSession, folder: str) -> str | None:
    got = files(spark, folder).first()
    return got.path if got else None


def flatten(df: DataFrame, explode: bool = False) -> DataFrame:
    """Nested structs as columns with dotted names. explode: arrays become rows, one array after another (an empty or null one keeps its row)."""
    while explode and (lists := [c for c, kind in flatten(df).dtypes if kind.startswith("array")]):
        df = flatten(df)
        df = df.select(*[F.explode_outer(f"`{c}`").alias(c) if c == lists[0] else F.col(f"`{c}`") for c in df.columns])
    out = []

    def walk(prefix: list[str], fields: Iterable) -> None:
        for f in fields:
            path = [*prefix, f.name]
            if f.dataType.typeName() == "struct":
                walk(path, f.dataType.fields)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))

    walk([], df.schema.fields)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """A summary as CSV with a header; mode `ignore` leaves an existing one alone."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_text(spark: SparkSession, text: str, path: str, mode: str = "overwrite") -> None:
    """A report as one text file, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_profile(spark: SparkSession, profile, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    text = profile.report(kind)
    if kind == "json":
        json.loads(text)
    write_text(spark, text, path, mode)
