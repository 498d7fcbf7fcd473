"""Sinks: canonical JSON lines, CSV, digests of what was written. None overwrites what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_rows(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with sorted keys and its nulls."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    canonical_rows(df).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted by `order` across files, each with a header."""
    df.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, bytes) of the data files below a path, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).orderBy("file")
