"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the passages.

Every run of ``SEED_WORDS`` words of a test item is a seed. One pass over all documents finds the
seeds they hold; around each of them, however common it is, the document is aligned with the item
word by word, so copies with changed, lost or added words are found as well. A document is
contaminated if some alignment reaches ``MIN_SCORE`` of the item's own score. A copy that keeps no
``SEED_WORDS`` words of an item together has no seed and isn't aligned.

The items are a stated query set: they are taken in blocks of at most ``BLOCK_SEEDS`` seeds, and
only a block is ever sent to the tasks, so the bound doesn't depend on the tables. Seeds and
alignments are row-local; only scores are moved.

Defined cases: null, empty or blank texts hold nothing and stay; null, empty or blank items match
nothing; items shorter than a seed are one seed by themselves; repeated rows are judged alike; null
ids and equal ids with different texts are ordinary rows of both tables, each judged by its own text;
with an empty benchmark every document stays; further columns are ignored by ``scores`` and kept by
``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, mixed, table, window_hashes, word_hashes
from seriesmill.session import written

SEED_WORDS = 4
BLOCK_SEEDS = 500_000
#: A word that fits, one that differs, a gap; a word of the item is worth one point.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
MIN_SCORE = 0.5
#: Words before and after the place that a seed points to, as a share of the item's length.
SLACK = 0.25

# Words are compared without case and without these signs.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if chr(c) in ".,;:!?\"'()[]{}|*#$%&<>" else c for c in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def seeds_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the word windows; of the whole item if that is shorter."""
    if 0 < len(words) < SEED_WORDS:
        out = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            out = mixed(out + words[k : k + 1])
        return out
    return window_hashes(words, SEED_WORDS)


def alignment(item: np.ndarray, passage: np.ndarray) -> float:
    """The best local alignment score of two word sequences, as a share of the item's length.

    Rows are filled as vectors; gaps along a row are a running maximum of the row freed from its
    slope.
    """
    slope = GAP * np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1)
    best = 0.0
    for w in item:
        row = np.empty_like(above)
        row[0] = 0.0
        np.maximum(above[:-1] + np.where(passage == w, MATCH, MISMATCH), above[1:] + GAP, out=row[1:])
        np.maximum(row, 0.0, out=row)
        row = np.maximum.accumulate(row - slope) + slope
        best = max(best, float(row.max()))
        above = row
    return best / max(1, len(item))


class _Block:
    """The items of one block, known by their place (ids are labels), with an index of their seeds."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = items
        hashes, owner, at = [], [], []
        for k, (_, words) in enumerate(items):
            s = seeds_of(words)
            hashes.append(s)
            owner.append(np.full(len(s), k))
            at.append(np.arange(len(s)))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = (np.concatenate(owner) if owner else np.empty(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int64))[order]
        self.short = any(len(w) < SEED_WORDS for _, w in items)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and the seed hashes found there."""
        if not len(self.hashes) or not len(words):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        sizes = [SEED_WORDS] if not self.short else sorted({min(len(w), SEED_WORDS) for _, w in self.items})
        places, seeds = [], []
        for size in sizes:
            if size == SEED_WORDS:
                h = window_hashes(words, SEED_WORDS)
            else:
                h = np.full(max(0, len(words) - size + 1), size, np.uint64)
                for k in range(size):
                    h = mixed(h + words[k : k + len(h)])
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            places.append(hit)
            seeds.append(h[hit])
        return np.concatenate(places), np.concatenate(seeds)


def _aligned(block: _Block):
    """A row per document and passage with the item met and its alignment score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                words = word_hashes(plain_words(text))
                places, seeds = block.found(words)
                if len(places):
                    for owner, passage in _passages(block, words, places, seeds):
                        item, own = block.items[owner]
                        rows.append((key, item, alignment(own, passage)))
            yield pd.DataFrame(rows, columns=["key", "item", "score"]).astype({"item": "Int64", "score": "float64"})

    return run


def _passages(block: _Block, words: np.ndarray, places: np.ndarray, seeds: np.ndarray):
    """For each item met: the stretches of the document that its seeds point to."""
    lo, hi = np.searchsorted(block.hashes, seeds), np.searchsorted(block.hashes, seeds, "right")
    met: dict[int, set[int]] = {}
    for place, a, b in zip(places.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for k in range(a, b):
            met.setdefault(int(block.owner[k]), set()).add(place - int(block.at[k]))
    for owner, starts in met.items():
        size = len(block.items[owner][1])
        slack = int(np.ceil(SLACK * size)) + 2
        for start, end in _merged(sorted({(max(0, s - slack), min(len(words), s + size + slack)) for s in starts})):
            yield owner, words[start:end]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their words, in blocks of a bounded number of seeds; rows come one partition at a time."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = word_hashes(plain_words(row["text"]))
        if not len(words):
            continue
        block.append((None if row["item_id"] is None else int(row["item_id"]), words))
        held += len(words)
        if held >= BLOCK_SEEDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _key() -> Column:
    """A digest of id and text: rows that share it are judged alike, whatever ids are null or repeat."""
    return F.unhex(F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").cast("string")), 256))


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows key, item, score: every document, known by its key, with the items whose seeds it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(_key().alias("key"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], "key binary, item long, score double")
    for items in _blocks(benchmark):
        part = texts.mapInPandas(_aligned(_Block(items)), "key binary, item long, score double")
        found = found.unionAll(written(part.groupBy("key", "item").agg(F.max("score").alias("score")), "aligned"))
    return found.groupBy("key", "item").agg(F.max("score").alias("score"))


def scores(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows doc_id, best_item, score, contaminated for every document; no item: null and 0."""
    best = alignments(docs, benchmark).groupBy("key").agg(
        F.max_by("item", F.struct("score", -F.col("item"))).alias("best_item"), F.max("score").alias("score")
    )
    return (
        docs.select("doc_id", _key().alias("key"))
        .join(best, "key", "left")
        .select(
            "doc_id",
            "best_item",
            F.coalesce("score", F.lit(0.0)).alias("score"),
            (F.coalesce("score", F.lit(0.0)) >= MIN_SCORE).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    bad = alignments(docs, benchmark).where(F.col("score") >= MIN_SCORE).select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, _key() == F.col("__bad"), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
