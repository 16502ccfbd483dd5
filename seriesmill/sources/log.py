"""Append-only tables of small facts: the newest row of a key counts, and older ones can be cleared away.

A row is only ever added, in one Spark append, so writers never wait for each other and a reader sees
an append whole or not at all. Rows of a key are ordered by ``version``, then by their own text, so the newest one
is the same for every reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.session import path_exists, remove_path


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows; none where nothing has been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest(rows: DataFrame, keys: list[str], order: str = "version") -> DataFrame:
    """One row per key, as an aggregate: repeats shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    latest = F.max(F.struct(order, *rest)).alias("_m")
    return rows.groupBy(*keys).agg(latest).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rows.columns if c not in keys])


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], order: str = "version") -> int:
    """Rewrite the log to its newest rows; returns how many files went.

    The newest rows of the files there are now are appended first, then exactly these files are removed. A stop in
    between leaves rows twice, which changes no result; rows appended meanwhile are in other files.
    """
    if not path_exists(spark, path):
        return 0
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if len(files) < 2:
        return 0
    append(newest(spark.read.schema(schema).parquet(*files), keys, order), path)
    for file in files:
        remove_path(spark, file)
    return len(files)
