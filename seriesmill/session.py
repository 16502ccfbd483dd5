"""Session helpers: reliable checkpoints only, never executor-local ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    A folder of our own is only made for a local master without that setting (tests); on a
    cluster a machine-local folder would be lost with the machine, so that case is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seriesmill-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach.

    Each call names another one: a frame built earlier keeps the files it still has to read.
    """
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


_passing: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a frame once to a fresh scratch folder and read it from there.

    A table to keep belongs to the passing tables around the innermost ones, if there are any.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    around = _passing[:-1] if keep else _passing
    if around:
        around[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at the end, unless kept: nothing read later may depend on them."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            remove_path(spark, path)
