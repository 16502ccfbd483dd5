"""Quality rules by distribution divergence, DataFrame functions only.

A document is described by two histograms: the classes of its characters, and how often it uses
each common word of a language. Both are compared by Jensen-Shannon distance with references learnt
from all documents of each language; the nearest language counts, so a wrong language tag does no
harm. The common words of four languages are fixed; any other value of ``lang`` with ``MIN_DOCS``
documents or more has its own commonest words learnt first. Where the language of a document has no
reference, or no tag says which it is, the distances are unknown (null) and reject nothing; nor is a
histogram of too few characters or words judged.

For the four languages both passes are narrow: the only shuffle is the sum of some fifty columns.
Other languages add sums of words by language (map-side combined). The driver gets the references:
one row per language and ``TOP_WORDS`` words for each of the others. Distances take time in
proportion to the number of languages.

Defined cases: a null text counts as empty; an empty or blank text has no words and fails the base
rule; null ids are ordinary values; a null language has no reference; repeated rows are judged alike; an empty
table gives an empty result; further columns are ignored by ``judge`` and kept by ``passing``.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.functions.once import once
from seriesmill.llm.text import SPACE, aside, restored, table, word_array

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "was", "on", "are", "as"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una"],
}
VOCABULARY = list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
#: Documents that a further language needs for a reference, and the words learnt of it.
MIN_DOCS = 50
TOP_WORDS = 15
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Guards and limits of the divergence rule; a distance is a square root of bits, at most 1.
MIN_CHARS = 200
# Only texts that use common words at least this much shape a reference.
MIN_COMMON_SHARE = 0.1
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.31


def _length_without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _measured(docs: DataFrame) -> DataFrame:
    """Add words, character classes and common-word counts to rows with columns doc_id, lang, text."""
    step = once(docs, {"words": word_array(F.col("text")), "left0": _length_without(F.col("text"), "[a-z]+")})
    chain = [
        ("left1", "left0", SPACE),
        ("left2", "left1", r"\p{Lu}+"),
        ("left3", "left2", r"\p{L}+"),
        ("left4", "left3", "[0-9]+"),
        ("left5", "left4", "[.,]+"),
        ("left6", "left5", r"[#*$%&|<>]+"),
    ]
    for name, source, pattern in chain:
        step = once(step, {name: _length_without(F.col(source), pattern)})
    size = [F.length("text"), *[F.length(f"left{k}") for k in range(7)]]
    return once(
        step,
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": (size[0] - (size[1] - size[2])).cast("long"),
            "n_symbols": (size[6] - size[7]).cast("long"),
            # lower-case ASCII, capitals, other letters, digits, stops, symbols, the rest
            "chars": F.array(
                *[
                    (a - b).cast("double")
                    for a, b in [(size[0], size[1]), *[(size[k], size[k + 1]) for k in range(2, 7)], (size[7], F.lit(0))]
                ]
            ),
            "common": F.filter("words", lambda w: F.lower(w).isin(VOCABULARY)),
        },
    ).drop(*[f"left{k}" for k in range(7)])


def _with_shares(rows: DataFrame) -> DataFrame:
    """Add the two histograms as shares; null where a histogram has too few entries to be judged.

    The last entry of the word histogram is the share of all other words.
    """
    lowered = once(rows, {"lowered": F.transform("common", lambda w: F.lower(w))}).drop("common")
    counts = F.transform(
        F.array(*[F.lit(w) for w in VOCABULARY]),
        lambda w: (F.size("lowered") - F.size(F.array_remove(F.col("lowered"), w))).cast("double"),
    )
    other = (F.col("n_words") - F.size("lowered")).cast("double")
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    return once(
        lowered,
        {
            "char_share": F.when(chars >= MIN_CHARS, F.transform("chars", lambda c: c / chars)),
            "word_share": F.when(
                words >= MIN_WORDS, F.transform(F.concat(counts, F.array(other)), lambda c: c / words)
            ),
        },
    ).drop("lowered")


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Add n_repeat_words: words inside a 3-word window that occurs twice or more in the text.

    Windows are sorted within their row only where some window repeats at all.
    """
    grams = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.concat_ws(
                " ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)
            ),
        ),
    ).otherwise(F.array().cast("array<string>"))
    rows = once(rows, {"grams": grams})
    none = F.array().cast("array<struct<g:string,i:int>>")
    rows = once(
        rows,
        {
            "sorted": F.when(F.size(F.array_distinct("grams")) == F.size("grams"), none).otherwise(
                F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
            )
        },
    )

    def gram(k: Column) -> Column:
        return F.get("sorted", k).getField("g")

    repeated = F.filter(
        F.transform(
            "sorted",
            lambda x, k: F.when((gram(k - 1) == x.getField("g")) | (gram(k + 1) == x.getField("g")), x.getField("i")),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2))))
    return once(rows, {"n_repeat_words": F.size(covered).cast("long")}).drop("grams", "sorted")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select(
        *aside(docs),
        F.col("doc_id"),
        lang.cast("string").alias("lang"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def references(docs: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean shares per language with fixed words over all its documents that are long enough and use its words.

    At most one row per entry of ``COMMON_WORDS`` comes back.
    """
    known = _with_shares(_measured(_rows(docs).where(F.col("lang").isin(list(COMMON_WORDS))).drop(*[f"__in_{k}" for k in range(len(docs.columns))])))
    common = 1 - F.get("word_share", F.lit(len(VOCABULARY)))
    sized = known.where(F.col("char_share").isNotNull() & (common >= MIN_COMMON_SHARE))
    sums = [F.avg(F.get("char_share", F.lit(k))).alias(f"c{k}") for k in range(7)]
    sums += [F.avg(F.get("word_share", F.lit(k))).alias(f"w{k}") for k in range(len(VOCABULARY) + 1)]
    found = sized.groupBy("lang").agg(*sums).collect()
    return {
        r["lang"]: ([r[f"c{k}"] for k in range(7)], [r[f"w{k}"] for k in range(len(VOCABULARY) + 1)])
        for r in found
    }


class Learnt(NamedTuple):
    """A language without fixed words: its commonest words, mean character and word shares (others first)."""

    words: list[str]
    chars: list[float]
    shares: list[float]


def _own_share(lowered: Column, words: Column) -> Column:
    """Shares of all other words and of each of the given ones in a document."""
    counts = F.transform(words, lambda w: (F.size(lowered) - F.size(F.array_remove(lowered, w))).cast("double"))
    n = F.col("n_words").cast("double")
    return F.transform(F.concat(F.array(n - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)), counts), lambda c: c / n)


def learnt(docs: DataFrame) -> dict[str, Learnt]:
    """References of the languages that have no fixed words but enough documents."""
    if "lang" not in docs.columns:
        return {}
    others = docs.select(F.col("lang").cast("string").alias("lang")).where(~F.col("lang").isin(list(COMMON_WORDS)))
    many = [r["lang"] for r in others.groupBy("lang").count().where(F.col("count") >= MIN_DOCS).collect()]
    if not many:
        return {}
    rows = _rows(docs).where(F.col("lang").isin(many)).select("doc_id", "lang", "text")
    sized = _measured(rows).where((F.col("n_words") >= MIN_WORDS) & (F.col("word_chars") >= MIN_CHARS))
    sized = once(sized, {"lowered": F.transform("words", lambda w: F.lower(w))})
    # each document has the same weight, in whole billionths; the empty word counts the documents
    one = F.lit(1_000_000_000)
    word = sized.select("lang", "n_words", F.explode(F.concat(F.array(F.lit("")), "lowered")).alias("word"))
    weight = F.when(F.col("word") == "", one).otherwise(F.floor(one / F.col("n_words"))).cast("decimal(38,0)")
    sums = word.groupBy("lang", "word").agg(F.sum(weight).alias("weight"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("word") != "", F.desc("weight"), "word"))
    tops: dict[str, dict[str, float]] = {}
    for r in sums.withColumn("place", place).where(F.col("place") <= TOP_WORDS + 1).orderBy("lang", "place").collect():
        tops.setdefault(r["lang"], {})[r["word"]] = float(r["weight"]) / 1e9
    own = []
    for lang, found in tops.items():
        n = found.pop("")
        if n >= MIN_DOCS:
            own.append((lang, list(found), min(MIN_COMMON_SHARE, sum(found.values()) / n / 2)))
    if not own:
        return {}
    known = sized.join(F.broadcast(docs.sparkSession.createDataFrame(own, "lang string, own array<string>, least double")), "lang")
    known = once(known, {"own_share": _own_share(F.col("lowered"), F.col("own"))})
    sums = [F.avg(F.get("chars", F.lit(k)) / F.col("word_chars")).alias(f"c{k}") for k in range(7)]
    sums += [F.avg(F.get("own_share", F.lit(k))).alias(f"w{k}") for k in range(TOP_WORDS + 1)]
    means = {r["lang"]: r for r in known.where(1 - F.get("own_share", F.lit(0)) >= F.col("least")).groupBy("lang").agg(*sums).collect()}
    return {
        lang: Learnt(words, [means[lang][f"c{k}"] for k in range(7)], [means[lang][f"w{k}"] for k in range(len(words) + 1)])
        for lang, words, _ in own
        if lang in means
    }


def js_distance(share: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares from a fixed one."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + F.when(q > 0, q * F.log2(q / m)).otherwise(
            F.lit(0.0)
        )

    pairs = F.zip_with(share, F.array(*[F.lit(float(x)) for x in reference]), part)
    bits = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(share.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), bits)))


def _nearest(share: str, refs: list[list[float]]) -> Column:
    if not refs:
        return F.lit(None).cast("double")
    return F.array_min(F.array(*[js_distance(F.col(share), r) for r in refs]))


def _judged(docs: DataFrame) -> DataFrame:
    refs, others = references(docs), learnt(docs)
    rows = _with_shares(_repeat_words(_measured(_rows(docs))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    ordered = [refs[k] for k in sorted(refs)]
    further = [others[k] for k in sorted(others)]
    word_distances = [_nearest("word_share", [w for _, w in ordered])]
    if further:
        vocabulary = sorted({w for x in further for w in x.words})
        lowered = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(vocabulary))
        rows = once(rows, {"lowered": lowered})
        shares = [_own_share(F.col("lowered"), F.array(*[F.lit(w) for w in x.words])) for x in further]
        rows = once(rows, {f"share_{k}": F.when(F.col("n_words") >= MIN_WORDS, x) for k, x in enumerate(shares)})
        word_distances += [js_distance(F.col(f"share_{k}"), x.shares) for k, x in enumerate(further)]
    has_reference = F.col("lang").isin([*refs, *others])
    rows = once(
        rows,
        {
            "n_dup_lines": _dup_lines(F.col("text")),
            "base_failed": failed,
            "char_distance": F.when(
                has_reference, _nearest("char_share", [*[c for c, _ in ordered], *[x.chars for x in further]])
            ),
            "word_distance": F.when(has_reference, F.array_min(F.array(*word_distances))),
        },
    )
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE
    )
    return once(rows, {"kept": ~F.col("base_failed") & near})


def judge(docs: DataFrame) -> DataFrame:
    """One row per document with the counts, both distances and the verdict."""
    return _judged(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )


def passing(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return _judged(docs).where("kept").select(*restored(docs).values())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def distance(p: list[float], q: list[float]) -> float:
    """The same distance for plain lists (for tests)."""
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a > 0 else 0.0) + (b * math.log2(b / m) if b > 0 else 0.0)
    return math.sqrt(max(0.0, total / 2))
