"""Quality classifier: document evidence combined with host and path posteriors by empirical Bayes.

* *Document evidence.* A logistic regression over shape features (bins of the shares of signs,
  capitals, repeated words, common endings and so on) and the most telling words. It is fitted on at
  most ``TRAIN_ROWS`` labelled documents (those with the smallest hashes), a documented constant.
* *Sites.* Hosts and paths (here source, and source with language) have good rates with beta priors.
  Labels of *all* labelled documents count fully, the evidence of all others by ``SOFT``. A host
  shrinks towards the global rate and a path towards its host; the strengths of both priors come
  from the spread between groups (moments), so sparse sites say little.
* *Together.* The log odds of a document are those of its evidence, moved by those of its path
  relative to the global rate, at most ``SITE_LIMIT``.

A document is good if its quality is 1 and it isn't toxic. Group sums combine on the map side; a hot
site leaves each task as one row, and the join back can be split.

Defined cases: null and empty texts have the bias and the lowest bins only; null hosts and languages
form groups of their own; repeated rows count each; without labels, or with labels of one kind, the
evidence is even (0.5) and all documents stay; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, table
from seriesmill.session import written

TRAIN_ROWS = 6000
WORDS = 400
MIN_DOCS = 8
SOFT = 0.1
SITE_LIMIT = 1.0
KEEP = 0.5
SEED = "quality-1"

_SIGNS = b"#*$%&|<>"
_STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: str) -> list[bytes]:
    return [w.strip(_STRIP) for w in text.encode("utf-8", "surrogatepass").lower().split()]


def shape(text: str, words: list[bytes]) -> list[str]:
    """Bins of simple shares; each bin is a feature."""
    n, size = len(words), max(1, len(text))
    raw = text.encode("utf-8", "surrogatepass")
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    capitals = sum(map(str.isupper, text)) if n else 0
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "signs": signs / size,
        "capitals": capitals / size,
        "shouts": raw.count(b"!") / max(1, n),
        "distinct": len(set(words)) / max(1, n),
        "run": sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        "short": sum(len(w) <= 3 for w in words) / max(1, n),
        "stops": sum(map(raw.count, (b".", b","))) / max(1, n),
        "twice": 1 - len(set(lines)) / max(1, len(lines)),
        "length": size / max(1, n) / 40,
    }
    out = [f"{k}:{min(9, int(v * 10))}" for k, v in shares.items()]
    out += [f"{k}+" for k in ("signs", "capitals", "shouts", "run", "twice") if shares[k] > 0.05]
    return [*out, f"size:{min(12, int(np.log2(n + 1)))}"]


class Evidence:
    """Weights of shapes and words; the bias is under the empty name."""

    def __init__(self, shapes: dict[str, float], words: dict[bytes, float]):
        self.shapes, self.words = shapes, words

    def logit(self, text: str | None) -> float:
        words = words_of(text or "")
        total = self.shapes.get("", 0.0) + sum(self.shapes.get(f, 0.0) for f in shape(text or "", words))
        return total + sum(self.words[w] for w in self.words.keys() & set(words))


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for good, text in zip(pdf["good"], pdf["text"], strict=True):
            words = words_of(text or "")
            rows.append((bool(good), shape(text or "", words), sorted(set(words))))
        yield pd.DataFrame(rows, columns=["good", "shapes", "words"])


def _coded(shapes: dict[str, int], words: dict[bytes, int]):
    """The numbers of a row's features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for good, fs, ws in zip(pdf["good"], pdf["shapes"], pdf["words"], strict=True):
                own = [shapes[f] for f in fs] + [words[w] for w in words.keys() & set(map(bytes, ws))]
                rows.append((bool(good), np.array(own, np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["good", "codes"])

    return run


def fitted(labelled: DataFrame) -> Evidence:
    """Fit on the rows (good, text), TRAIN_ROWS at most; words are chosen by Spark, WORDS at most.

    The driver holds the numbers of the features of each row (some hundred bytes).
    """
    frame = written(labelled.select("good", "text").mapInPandas(_sampled, "good boolean, shapes array<string>, words array<binary>"), "sample")
    n = [frame.where(~F.col("good")).count(), frame.where("good").count()]
    if not n[0] or not n[1]:
        return Evidence({}, {})
    p, q = (F.col("bad_n") + 0.5) / (n[0] + 1), (F.col("good_n") + 0.5) / (n[1] + 1)
    counted = (
        frame.select("good", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count_if("good").alias("good_n"), F.count_if(~F.col("good")).alias("bad_n"))
        .where(F.col("good_n") + F.col("bad_n") >= MIN_DOCS)
        .withColumn("telling", F.abs(F.log(p / q)) * F.sqrt(F.col("good_n") + F.col("bad_n")))
    )
    words = [bytes(r["word"]) for r in counted.orderBy(F.desc("telling"), "word").limit(WORDS).select("word").collect()]
    shapes = sorted(r["f"] for r in frame.select(F.explode("shapes").alias("f")).distinct().collect())
    names = {"": 0} | {f: k for k, f in enumerate([*shapes, *words], 1)}
    codes = frame.mapInPandas(
        _coded({f: names[f] for f in shapes}, {w: names[w] for w in words}), "good boolean, codes binary"
    ).collect()
    y = np.array([r["good"] for r in codes], float)
    x = np.zeros((len(codes), len(names)), np.float32)
    x[:, 0] = 1
    for k, r in enumerate(codes):
        x[k, np.frombuffer(r["codes"], np.int32)] = 1
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0])
    w, past = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 2e-4 * w
        past += g * g
        w -= 0.3 * g / np.sqrt(past)
    # balanced classes while fitting; the share of good ones comes back here
    w[0] += np.log(n[1] / n[0])
    return Evidence({f: float(w[names[f]]) for f in ["", *shapes]}, {f: float(w[names[f]]) for f in words})


def _scored(evidence: Evidence):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [evidence.logit(t) for t in pdf["text"]]
            yield pdf.drop(columns="text").astype({"doc_id": "Int64"}).assign(own_logit=np.clip(np.array(own, float), -30, 30))

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column) -> Column:
    """Prior strength by moments, as an aggregate over groups (n, good) around their prior means."""
    n, rate = F.col("n"), F.col("good") / F.col("n")
    spread = F.sum(n * (rate - prior) ** 2)
    chance = F.sum(prior * (1 - prior))
    mean_pq = F.sum(n * prior * (1 - prior))
    excess = F.greatest(F.lit(1e-4), (spread - chance) / F.greatest(mean_pq, F.lit(1e-9)))
    return F.least(F.lit(1e4), F.greatest(F.lit(2.0), 1 / excess - 1))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows doc_id, own_probability, host_rate, path_rate, probability, kept: one per document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(good.cast("int")).alias("label")
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("host"),
        F.col("lang").cast("string").alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    evidence = fitted(_labelled_texts(texts, marks))
    scored = texts.mapInPandas(_scored(evidence), "doc_id long, host string, path string, own_logit double")
    own = written(scored.join(marks, "doc_id", "left"), "evidence")

    sure = F.col("label").isNotNull()
    p = 1 / (1 + F.exp(-F.col("own_logit")))
    weight = F.when(sure, F.lit(1.0)).otherwise(F.lit(SOFT))
    count = [F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("label").cast("double"), p)).alias("good")]
    paths = written(own.groupBy("host", "path").agg(*count), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not total["n"]:
        rate = 0.5
    else:
        rate = min(0.999, max(0.001, total["good"] / total["n"]))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    host_strength = hosts.agg(_strength(hosts, F.lit(rate)).alias("k")).first()["k"] or 2.0
    host_rate = (F.lit(rate) * host_strength + F.col("good")) / (host_strength + F.col("n"))
    hosts = hosts.select(F.col("host").alias("h"), host_rate.alias("host_rate"))
    placed = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    path_strength = placed.agg(_strength(placed, F.col("host_rate")).alias("k")).first()["k"] or 2.0
    path_rate = (F.col("host_rate") * path_strength + F.col("good")) / (path_strength + F.col("n"))
    rates = placed.select(F.col("host").alias("h"), F.col("path").alias("q"), "host_rate", path_rate.alias("path_rate"))

    site = _logit(F.col("path_rate")) - _logit(F.lit(rate))
    together = F.col("own_logit") + F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), site))
    met = own.join(rates, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    return met.select(
        "doc_id",
        p.alias("own_probability"),
        "host_rate",
        "path_rate",
        (1 / (1 + F.exp(-together))).alias("probability"),
        ((1 / (1 + F.exp(-together))) >= KEEP).alias("kept"),
    )


def _labelled_texts(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Texts of the labelled documents that training needs: those with the smallest hashes."""
    few = marks.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id")).orderBy("h").limit(TRAIN_ROWS).select("doc_id", "label")
    return texts.join(F.broadcast(few), "doc_id").select("doc_id", "text", (F.col("label") == 1).alias("good"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
