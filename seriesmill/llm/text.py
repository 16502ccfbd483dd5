"""Word rules that several operators share, as Columns and for task-side NumPy."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Maximal runs without white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """The size of ``word_array`` without a lambda per word."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def lower_words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes methods know ASCII only, as wanted here."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, so no two values meet)."""
    h = h.copy()
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` neighbouring words, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : k + n])
    return out


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, rows: int = 400) -> None:
    """Let Arrow batches hold no more rows and bytes than this, so long values can't fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def aside(docs: DataFrame) -> list[Column]:
    """All columns under names that no other column has, to be given back by ``restored``."""
    return [docs[f"`{c}`"].alias(f"__in_{k}") for k, c in enumerate(docs.columns)]


def restored(docs: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"__in_{k}").alias(c) for k, c in enumerate(docs.columns)}
