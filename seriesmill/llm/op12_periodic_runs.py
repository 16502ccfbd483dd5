"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q and at least max(``SHORTEST``, 2 * q) words that can't
be extended with that period. Text by text, in Arrow batches:

1. Re-Pair: the most frequent pair of neighbouring symbols (ties: the one seen first) becomes a new symbol
   until no pair is left twice. The places of a symbol's words are kept, as they are all its places in
   the derivation. What is left is put into a balanced tree of nodes that occur once.
2. Every nonterminal is searched once, at its first place: a run inside it that crosses the border of its
   two halves has a period q, and words repeat at that distance on both sides of the border; how far,
   comes from names of blocks of 1, 2, 4, ... words, equal for equal blocks (no hashes).
3. Runs found are put at all places of the nonterminal. One that reaches an end of the nonterminal and goes
   on outside belongs to a larger node and is left to it. Equal intervals are merged with their smallest
   period.

A text with a run has a window of six words twice, so others need no grammar. Work and memory follow a
text's own length (nodes are searched in blocks of ``BLOCK`` pairs of node and period), and nothing is shuffled.

The registered query first makes the texts of its contract (``planted``): a tenth of them, chosen by
crc32 of the id, repeat a stretch of their own words.

Defined cases: a null or blank text has no words, no run and the digests of the empty string; a null id
is never planted; repeated rows each give a row; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, table

SHORTEST = 12
#: Pairs of node and period looked at in one step.
BLOCK = 1 << 20
ROWS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_symbols long"
)


# The grammar


def re_pair(ids: list[int]) -> tuple[list[tuple[int, int, list[int]]], list[int], list[int]]:
    """Nodes (words, words of the left half, places) of the rules, then places and sizes of what is left."""
    n = len(ids)
    symbol, size = list(ids), [1] * n  # both by the place of a symbol's first word
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    fresh = max(ids, default=-1) + 1
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        pair = (ids[i], ids[i + 1])
        if pair in places:
            places[pair].append(i)
        else:
            places[pair] = [i]
    heap, turn = [], 0

    def queue(found: dict[tuple[int, int], list[int]]) -> None:
        nonlocal turn
        for pair, at in found.items():
            if len(at) > 1:
                heapq.heappush(heap, (-len(at), turn, pair, at))
                turn += 1

    queue(places)
    nodes: list[tuple[int, int, list[int]]] = []
    while heap:
        count, order, (a, b), at = heapq.heappop(heap)
        live, end = [], -1
        for i in at:
            # A place that was taken by another rule, or by the overlapping pair before it, is gone.
            if i >= end and symbol[i] == a and after[i] < n and symbol[after[i]] == b:
                live.append(i)
                end = after[i] + 1
        if len(live) < 2:
            continue
        if len(live) < -count:
            heapq.heappush(heap, (-len(live), order, (a, b), live))
            continue
        nodes.append((size[live[0]] + size[after[live[0]]], size[live[0]], live))
        for i in live:
            j = after[i]
            symbol[i], symbol[j] = fresh, -1
            size[i] += size[j]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
        made: dict[tuple[int, int], list[int]] = {}
        for i in live:
            h, k = before[i], after[i]
            if h >= 0 and symbol[h] != fresh:
                made.setdefault((symbol[h], fresh), []).append(h)
            if k < n:
                made.setdefault((fresh, symbol[k]), []).append(i)
        queue(made)
        fresh += 1
    rest, i = [], 0
    while i < n:
        rest.append(i)
        i = after[i]
    return nodes, rest, [size[i] for i in rest]


def _tree(starts: list[int], sizes: list[int]) -> list[tuple[int, int, list[int]]]:
    """Nodes of a balanced tree over neighbouring symbols."""
    nodes = []
    level = list(zip(starts, sizes))
    while len(level) > 1:
        merged = []
        for k in range(0, len(level) - 1, 2):
            (i, a), (_, b) = level[k], level[k + 1]
            nodes.append((a + b, a, [i]))
            merged.append((i, a + b))
        if len(level) % 2:
            merged.append(level[-1])
        level = merged
    return nodes


# Runs


def block_names(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: a number for the 2**k words from each place on, equal for equal words."""
    names = [ids.astype(np.int64)]
    width = 1
    while 2 * width <= len(ids):
        now = names[-1]
        both = now[: len(now) - width] * (int(now.max()) + 1) + now[width:]
        names.append(np.unique(both, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return names


def _forward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are the same, at most ``most``."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        can = np.flatnonzero(same + width <= most)
        if len(can):
            at = same[can]
            can = can[names[k][i[can] + at] == names[k][j[can] + at]]
            same[can] += width
    return same


def _backward(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words before i and before j are the same, at most ``most``."""
    same = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        can = np.flatnonzero(same + width <= most)
        if len(can):
            at = same[can] + width
            can = can[names[k][i[can] - at] == names[k][j[can] - at]]
            same[can] += width
    return same


def _crossing(names: list[np.ndarray], low: np.ndarray, border: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple:
    """Rows (number, start, end) of the stretches with period q in [low, high) that cross the border.

    With a whole period right of the border, words there repeat q further on; with one left of it, q
    earlier. Either way at least six words in all repeat, so three on one side do, of which two are
    looked up first.
    """
    pairs = names[1]
    found = []
    for shift in (0, 1):
        # Words of the border's right meet those q on; the same stretch seen from q earlier is the second case.
        i = border - q * shift
        fits = (i >= low) & (i + q <= high)
        k = np.flatnonzero(fits)
        at = i[k]
        right = (at + q[k] + 2 <= high[k]) & (pairs[np.minimum(at, len(pairs) - 1)] == pairs[np.minimum(at + q[k], len(pairs) - 1)])
        left = (at - 2 >= low[k]) & (pairs[np.maximum(at - 2, 0)] == pairs[np.minimum(at + q[k] - 2, len(pairs) - 1)])
        k = k[right | left]
        if not len(k):
            continue
        at, period = i[k], q[k]
        on = _forward(names, at, at + period, high[k] - at - period)
        back = _backward(names, at, at + period, at - low[k])
        whole = on + back + period >= np.maximum(SHORTEST, 2 * period)
        found.append((k[whole], (at - back)[whole], (at + period + on)[whole]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _repeats(ids: np.ndarray) -> bool:
    """Whether some six words stand at two places; without that there is no run."""
    width = SHORTEST // 2
    if len(ids) < SHORTEST:
        return False
    windows = np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint32), width)
    flat = np.ascontiguousarray(windows).view(np.dtype((np.void, 4 * width))).ravel()
    return len(np.unique(flat)) < len(flat)


def runs(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows (start, length, period) of all runs by start and period; and the symbols of the grammar."""
    none = np.empty((0, 3), np.int64)
    n = len(ids)
    if not _repeats(ids):
        return none, 0
    rules, rest, sizes = re_pair(ids.tolist())
    nodes = [x for x in rules + _tree(rest, sizes) if x[0] >= SHORTEST]
    names = block_names(ids)
    size = np.array([x[0] for x in nodes])
    low = np.array([x[2][0] for x in nodes])
    border, high = low + np.array([x[1] for x in nodes]), low + size
    periods = size // 2
    rows = []
    ends = np.cumsum(periods)
    first = 0
    while first < len(nodes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK, "right")))
        most = periods[first:last]
        # A single large node is cut by its periods.
        for base in range(0, int(most.max()), BLOCK):
            here = np.clip(most - base, 0, BLOCK)
            node = np.repeat(np.arange(first, last), here)
            q = np.arange(len(node)) - np.repeat(np.cumsum(here) - here, here) + 1 + base
            k, start, end = _crossing(names, low[node], border[node], high[node], q)
            rows += zip(node[k].tolist(), start.tolist(), end.tolist(), q[k].tolist())
        first = last
    starts, stops, qs = [none[:, 0]], [none[:, 0]], [none[:, 0]]
    for node, start, end, q in rows:
        moved = np.array(nodes[node][2]) - nodes[node][2][0]
        starts.append(start + moved)
        stops.append(end + moved)
        qs.append(np.full(len(moved), q))
    start, end, q = np.concatenate(starts), np.concatenate(stops), np.concatenate(qs)
    goes_on = (start > 0) & (ids[start - 1] == ids[np.minimum(start - 1 + q, n - 1)])
    goes_on |= (end < n) & (ids[np.minimum(end, n - 1)] == ids[np.minimum(end, n - 1) - q])
    whole = np.stack([start, end, q], 1)[~goes_on]
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    single = np.ones(len(whole), bool)
    single[1:] = (whole[1:, :2] != whole[:-1, :2]).any(1)
    whole = whole[single]
    whole[:, 1] -= whole[:, 0]
    return whole[np.lexsort((whole[:, 2], whole[:, 0]))], len(rules)


# Texts


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: a tenth of the texts repeat a stretch of their own."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * ((n - a) // p + 1))[: n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Whether each word is left when every run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps)[:n] == 0


def described(words: list[bytes]) -> tuple:
    """The columns after doc_id for one text."""
    found, symbols = runs(word_ids(words))
    kept = words
    if len(found):
        kept = [w for w, k in zip(words, kept_words(len(words), found).tolist()) if k]
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found.tolist())
    best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
    return len(found), *first, *digests, len(words), symbols


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROWS.split(", ")]
    for pdf in batches:
        out = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            key = None if pd.isna(doc_id) else int(doc_id)
            words = (text or "").encode("utf-8", "surrogatepass").split()
            out.append((key, *described(planted(key, words) if PLANT in pdf else words)))
        frame = pd.DataFrame(out, columns=names)
        yield frame.astype({c: "Int64" for c in names if not c.endswith("sha256")})


#: Marks rows whose texts are to be planted.
PLANT = "__plant"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per document with its runs' figures and digests; ``plant`` changes texts as the contract says."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if plant:
        rows = rows.withColumn(PLANT, F.lit(True))
    return rows.mapInPandas(_described, ROWS)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
