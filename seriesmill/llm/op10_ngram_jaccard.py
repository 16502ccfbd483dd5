"""Exact n-gram Jaccard join and its connected components, with set-relation skipping.

Documents link when their sets of distinct 5-word shingles share at least 80 % of their union.
The component of each document is found without expanding groups of copies into pairs:

1. Equal sets are one vertex: they meet by the digest of the sorted shingle hashes.
2. *Answers from a similar set.* A few min-hash keys bring each set to a few sets that share a key;
   marks (parities of the set in 1024 classes, whose differences are a lower bound of the sets')
   rule most out and exact overlaps decide. Sets linked to a common one share its component, so no
   pair inside a component is ever looked at again.
3. *Skipping in the index.* The rest is an exact prefix join: common shingles are ordered last, an
   index list is skipped whole if it holds a single component, and inside a list sizes, positions
   and, in long lists, marks rule out pairs that cannot reach the limit before they are made.
4. Two components that meet are first compared by their own representatives. If those link, all
   other pairs of the two are skipped; if not, the overlap of the representatives and those of the
   members with them bound the overlap of a pair, and most are skipped without reading a set.

Whatever the order of shingles and the choice of keys, the links found span every component: steps
2 and 4 only skip pairs whose answer is known. Shingles are 64-bit hashes.

``ORDERED_LAST`` bounds what is broadcast (the commonest shingles, 8 bytes each); it changes the
order of the prefix join, never its result. ``FILTER_BITS`` bounds the filter of documents whose
sets are read again; a full filter only means that more sets are moved.

Defined cases: null, empty and blank texts have an empty set and are their own component; fewer
than five words make one shingle; repeated rows link; an empty table gives an empty result; further
columns are ignored by ``classes`` and kept by ``one_of_each``. Where an id is null or repeats, rows
get keys of their own, written with the table: each row is judged by its own text, and a component
is named by the smallest id in it (null if all are null). Of a component the row with the smallest
id stays, one without an id only if no other has one; rows of equal ids and empty sets are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seriesmill.llm.graph import stars
from seriesmill.llm.text import bounded_batches, lower_words, mixed, table, window_hashes, word_hashes
from seriesmill.session import passing_tables, written

WIDTH = 5
PERCENT = 80
KEYS = 4
#: Sets of a shared key that the others are compared with in step 2.
CENTRES = 4
MARKS = 1024
#: Index lists with more members than this also compare marks before a pair is made.
LONG_LIST = 64
ORDERED_LAST = 65_536
FILTER_BITS = 22


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    h = word_hashes(lower_words(text))
    if 0 < len(h) < WIDTH:
        # the whole sequence, whose length keeps it apart from any longer one
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = mixed(out + h[k : k + 1])
        return out
    return np.unique(window_hashes(h, WIDTH))


def needed(n: int) -> int:
    """The least overlap with any set that a set of n shingles can link with."""
    return -(-PERCENT * n // 100)


def _prefix_size(n: int) -> int:
    return n - needed(n) + 1


_SEEDS = mixed(np.arange(1, KEYS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _marks(s: np.ndarray) -> np.ndarray:
    """Parities of a set in MARKS classes: two sets differ in at least as many shingles as marks."""
    odd = np.bincount((mixed(s + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(54)).astype(np.int64), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_SEEN = "kind int, id long, n long, digest binary, keys array<long>, marks array<long>, token long, df long"


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per document, and at the end the shingles that repeat among this task's prefixes."""
    seen: set[bytes] = set()
    tokens = [np.empty(0, np.uint64)]
    held = 0
    counts: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def fold() -> None:
        nonlocal counts, tokens, held
        t, c = np.concatenate([counts[0], *tokens]), np.concatenate([counts[1], *[np.ones(len(x), np.int64) for x in tokens]])
        u, where = np.unique(t, return_inverse=True)
        n = np.bincount(where, c, len(u)).astype(np.int64) if len(u) else np.empty(0, np.int64)
        counts, tokens, held = (u, n), [], 0

    for pdf in batches:
        rows = []
        for i, text in zip(pdf["id"], pdf["text"], strict=True):
            s = shingle_set(text)
            if not len(s):
                rows.append((0, i, 0, b"", [], [], None, None))
                continue
            digest = xxhash.xxh3_128_digest(s.tobytes())
            keys = np.array([mixed(s ^ seed).min() for seed in _SEEDS])
            rows.append((0, i, len(s), digest, _signed(keys).tolist(), _marks(s).tolist(), None, None))
            if digest not in seen:
                seen.add(digest)
                tokens.append(s[: _prefix_size(len(s))])
                held += len(tokens[-1])
        if held > 2_000_000:
            fold()
            if len(counts[0]) > 4_000_000:
                counts = tuple(x[counts[1] > 1] for x in counts)
        yield _frame(rows)
    fold()
    again = counts[1] > 1
    t, c = _signed(counts[0][again]), counts[1][again]
    for k in range(0, len(t), 10_000):
        yield _frame([(1, None, None, None, None, None, int(a), int(b)) for a, b in zip(t[k : k + 10_000], c[k : k + 10_000], strict=True)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "id", "n", "digest", "keys", "marks", "token", "df"])
    return out.astype({"kind": "int32", "id": "Int64", "n": "Int64", "token": "Int64", "df": "Int64"})


def _second_pass(last: np.ndarray, wanted: np.ndarray):
    """Prefixes under the final order, and the sets of documents in the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                s = shingle_set(text)
                if not len(s) or pd.isna(i):
                    continue
                common = np.zeros(len(s), bool)
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                order = np.concatenate([s[~common], s[common]])[: _prefix_size(len(s))]
                full = s.tobytes() if _in_filter(wanted, i) else None
                rows.append((i, len(s), _signed(order).tolist(), full))
            yield pd.DataFrame(rows, columns=["id", "n", "prefix", "set"]).astype({"id": "int64", "n": "int64"})

    return run


def _sets(wanted: np.ndarray):
    """The sets of documents in the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                if not pd.isna(i) and _in_filter(wanted, i):
                    s = shingle_set(text)
                    if len(s):
                        rows.append((i, len(s), s.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n", "set"]).astype({"id": "int64", "n": "int64"})

    return run


def _slot(i) -> int:
    return ((int(i) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - FILTER_BITS)


def _in_filter(bits: np.ndarray, i) -> bool:
    k = _slot(i)
    return bool(bits[k >> 3] >> (k & 7) & 1)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit per slot of the ids (2 ** FILTER_BITS at most): documents outside are surely not needed."""
    found = ids.select("id").mapInPandas(
        lambda batches: (pd.DataFrame({"k": list({_slot(i) for i in p["id"].dropna()})}, dtype="int64") for p in batches), "k long"
    )
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    ks = found.distinct().toPandas()["k"].to_numpy(np.int64)
    np.bitwise_or.at(bits, ks >> 3, (1 << (ks & 7)).astype(np.uint8))
    return bits


@F.pandas_udf(T.LongType())
def _overlap(x: pd.Series, y: pd.Series) -> pd.Series:
    def common(a: bytes, b: bytes) -> int:
        p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(p) > len(q):
            p, q = q, p
        at = np.minimum(np.searchsorted(q, p), len(q) - 1)
        return int((q[at] == p).sum())

    return pd.Series([common(a, b) for a, b in zip(x, y, strict=True)], dtype="int64")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, any others) that occur once, with n_a, n_b and overlap."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(*pairs.columns, "n_a", "n_b", _overlap("set_a", "set_b").alias("overlap"))
    )


def _links():
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return 100 * F.col("overlap") >= PERCENT * union


def _near_marks(x: str, y: str):
    """Whether the marks allow a link: linked sets differ in few enough shingles."""
    apart = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(MARKS // 64)), F.lit(0))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))


def _near_sizes():
    return 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")


def _with_marks(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs (a, b, any others) whose sizes and marks allow a link."""
    x = vertices.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("marks_a"))
    y = vertices.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("marks_b"))
    return pairs.join(x, "a").join(y, "b").where(_near_sizes() & _near_marks("marks_a", "marks_b")).select(*pairs.columns)


def _star_pairs(vertices: DataFrame) -> DataFrame:
    """Pairs (set, one of a few sets that share a key with it)."""
    keyed = vertices.select("id", F.posexplode("keys").alias("which", "key"))
    centres = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("b"))).alias(f"c{k}") for k in range(CENTRES)]
    met = keyed.groupBy("which", "key").agg(F.count("*").alias("members"), *centres).where("members > 1")
    chosen = met.select("which", "key", F.array_distinct(F.array(*[F.col(f"c{k}.b") for k in range(CENTRES)])).alias("centres"))
    pairs = keyed.join(chosen, ["which", "key"]).select("id", F.explode("centres").alias("centre")).where("id <> centre")
    ordered = pairs.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()
    return _with_marks(ordered, vertices)


def _index_pairs(prefixes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of different components that the prefix index can't rule out."""
    rows = prefixes.select("id", "n", "component", F.posexplode("prefix").alias("pos", "token"))
    lists = Window.partitionBy("token")
    mixed_lists = (
        rows.withColumn("lo", F.min("component").over(lists))
        .withColumn("hi", F.max("component").over(lists))
        .withColumn("members", F.count("*").over(lists))
        .where("lo < hi")
        .select("token", "id", "n", "pos", "component", "members")
    )
    kept = written(mixed_lists, "lists")
    names = ("id", "n", "pos", "component")
    # the sizes must be near; what is left after both positions must hold the overlap needed
    rest = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    possible = _near_sizes() & ((100 + PERCENT) * rest >= PERCENT * (F.col("n_a") + F.col("n_b")))

    def met(rows: DataFrame, more: tuple[str, ...], also) -> DataFrame:
        x = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in (*names, *more)])
        y = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in (*names, *more)])
        return (
            x.join(y, "token")
            .where((F.col("component_a") < F.col("component_b")) & possible & also)
            .select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "component_a", "component_b", "n_a", "n_b")
        )

    long_lists = kept.where(F.col("members") > LONG_LIST).join(vertices.select("id", "marks"), "id")
    short = met(kept.where(F.col("members") <= LONG_LIST), (), F.lit(True))
    return short.unionAll(met(long_lists, ("marks",), _near_marks("marks_a", "marks_b"))).distinct()


def _known(links: DataFrame, member: str, root: str, name: str) -> DataFrame:
    """Overlaps of members with their component's smallest document, as far as they were counted."""
    return links.groupBy(F.col("a").alias(member), F.col("b").alias(root)).agg(F.max("overlap").alias(name))


def _rest_links(pairs: DataFrame, near: DataFrame, sets: DataFrame, vertices: DataFrame) -> DataFrame:
    """Components (a, b) that a link among the pairs left by the index joins; representatives are compared first."""
    probes = _compared(pairs.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct(), sets)
    probes = written(probes.withColumn("linked", _links()), "probes")
    told = probes.select(F.col("a").alias("component_a"), F.col("b").alias("component_b"), "linked", F.col("overlap").alias("seen"))
    open_pairs = (
        pairs.join(told.where(~F.col("linked")), ["component_a", "component_b"])
        .where("a <> component_a or b <> component_b")
        .join(_known(near, "a", "component_a", "with_a"), ["a", "component_a"], "left")
        .join(_known(near, "b", "component_b", "with_b"), ["b", "component_b"], "left")
    )
    own_a = F.when(F.col("a") == F.col("component_a"), F.lit(0)).otherwise(F.col("n_a") - F.col("with_a"))
    own_b = F.when(F.col("b") == F.col("component_b"), F.lit(0)).otherwise(F.col("n_b") - F.col("with_b"))
    most = F.col("seen") + own_a + own_b
    possible = (100 + PERCENT) * most >= PERCENT * (F.col("n_a") + F.col("n_b"))
    wanted = open_pairs.where(F.coalesce(possible, F.lit(True))).select("a", "b", "component_a", "component_b")
    found = _compared(_with_marks(wanted, vertices), sets).where(_links())
    return probes.where("linked").select("a", "b").unionAll(found.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))


def _labelled(rows: DataFrame, name: str, hung: DataFrame) -> DataFrame:
    """Rows with the component of what ``name`` holds, which is itself if it hangs on nothing."""
    found = hung.select(F.col("a").alias(name), F.col("b").alias("__root"))
    return rows.join(found, name, "left").withColumn("component", F.coalesce("__root", name)).drop("__root")


def _id() -> Column:
    return F.col("doc_id").cast("long")


def _ids_are_keys(docs: DataFrame) -> bool:
    """Whether every row has an id that no other row has."""
    return docs.select(_id().alias("id")).groupBy("id").count().where("id is null or count > 1").isEmpty()


def _keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("id"), F.col("text").cast("string").alias("text"))


def classes(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_shingles, component_id, one per row of ``docs``."""
    if _ids_are_keys(docs):
        found = _classes(_keyed_texts(docs))
        return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    text = F.col("text").cast("string").alias("text")
    keyed = written(docs.select(F.monotonically_increasing_id().alias("id"), _id().alias("doc_id"), text), "keyed")
    found = written(_classes(keyed.select("id", "text")).join(keyed.select("id", "doc_id"), "id"), "classes")
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classes(texts: DataFrame) -> DataFrame:
    """Rows id, n, component of rows (id, text) whose ids are keys."""
    spark = texts.sparkSession
    bounded_batches(spark)
    seen = written(texts.mapInPandas(_first_pass, _SEEN), "shingled")
    rows = seen.where("kind = 0")
    common = (
        seen.where("kind = 1").groupBy("token").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "token").limit(ORDERED_LAST)
    )
    last = np.sort(common.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    same = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "keys", "marks")).alias("v"))
    vertices = written(same.select("v.*", "digest"), "vertices")

    # sets of the stars are the bulk of their table: they go before the prefixes are shuffled
    with passing_tables(spark):
        met = written(_star_pairs(vertices), "stars")
        wanted = _filter(met.select(F.explode(F.array("a", "b")).alias("id")))
        second = written(texts.mapInPandas(_second_pass(last, wanted), "id long, n long, prefix array<long>, set binary"), "star_sets")
        near = written(_compared(met, second.where(F.col("set").isNotNull())).where(_links()), "near", keep=True)
        prefixes = written(second.select("id", "n", "prefix"), "prefixes", keep=True)

    hung = stars(near)
    labels = _labelled(vertices.select("id").distinct(), "id", hung)
    pairs = written(_index_pairs(prefixes.join(labels, "id"), vertices), "pairs")
    wanted = _filter(pairs.select(F.explode(F.array("a", "b", "component_a", "component_b")).alias("id")))
    sets = written(texts.mapInPandas(_sets(wanted), "id long, n long, set binary"), "sets")
    # components are vertices now: a link between two is between their smallest documents
    links = _rest_links(pairs, near.select("a", "b", "overlap"), sets, vertices)
    first = _labelled(vertices.select("id", "digest"), "id", hung).withColumnRenamed("component", "__first")
    roots = _labelled(first, "__first", stars(links)).select("digest", "component")
    return rows.join(roots, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns."""
    spark = docs.sparkSession
    if _ids_are_keys(docs):
        with passing_tables(spark):
            first = _classes(_keyed_texts(docs)).where("id = component").select(F.col("id").alias("__first"))
            first = written(first, "first", keep=True)
        return docs.join(first, docs["doc_id"] == F.col("__first"), "left_semi")
    keyed = written(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed", keep=True)
    with passing_tables(spark):
        found = _classes(keyed.select(F.col("__key").alias("id"), F.col("text").cast("string").alias("text")))
        rows = found.join(keyed.select(F.col("__key").alias("id"), _id().alias("doc_id")), "id")
        # empty sets of one id meet by it; of all others each is its own component
        group = F.when((F.col("n") > 0) | F.col("doc_id").isNull(), F.col("component"))
        rows = rows.select(group.alias("group"), F.when(group.isNull(), F.col("doc_id")).alias("empty"), "doc_id", "id")
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))["id"]
        first = written(rows.groupBy("group", "empty").agg(least.alias("__key")).select("__key"), "first", keep=True)
    return keyed.join(first, "__key", "left_semi").drop("__key")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
