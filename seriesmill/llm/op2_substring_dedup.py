"""Exact removal of repeated 50-byte strings by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller id.
Suffixes are first dealt out so that equal strings meet, then each part is searched by itself:

* *Anchors.* Of each ``LENGTH`` bytes the hash of one ``GRAM``-byte string is the smallest; it
  depends on the bytes alone, so equal strings have equal anchors. Documents are packed into pieces
  of about ``PIECE_BYTES``. A first exchange sends ten bytes an anchor: its hash, a hash of its
  context (all ``LENGTH``-byte strings around it) and its document. Contexts that occur whole in a
  smaller id are settled there. Only anchors with several contexts remain, and of these only the
  smallest id of each context.
* *Expansion.* The bytes of those contexts meet by anchor. A block of them gets its Burrows-Wheeler
  transform, and all intervals of suffixes with a common prefix are extended backwards by one
  character at a time, breadth first: after step l exactly the boundaries with a common prefix
  shorter than l are known. It stops at ``LENGTH``; the intervals left are the classes of equal
  strings, and the smallest id of each decides.

An anchor with more than ``HOT_CONTEXTS`` contexts (the ends of a passage that stands in very many
documents) is not dealt by its hash but by each of its strings' own bytes, so no group of strings
grows with the number of copies. Nothing is collected on the driver; lost tasks are redone from
written pieces. Contexts are compared by 64 bits inside their bucket.

Defined cases: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; a null id is
larger than any other; rows with the same id don't remove from one another; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, mixed, table
from seriesmill.session import written

LENGTH = 50
GRAM = 20
PIECE_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
BLOCK_CHARS = 1 << 16
HOT_CONTEXTS = 20_000
NULL_ID = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.up) < n:
        ups, downs = np.full(n, _BASE), np.full(n, _INVERSE)
        ups[0] = downs[0] = 1
        _powers.up, _powers.down = np.cumprod(ups), np.cumprod(downs)
    return _powers.up[:n], _powers.down[:n]


_powers.up = _powers.down = np.empty(0, np.uint64)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of ``width`` neighbours, by doubling."""
    size, out = 1, x
    while size < width:
        step = min(size, width - size)
        out = f(out[: len(out) - step], out[step:])
        size += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of documents that lie one after another up to their ends."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * up[: n - GRAM + 1])
    del sums
    width = LENGTH - GRAM + 1
    least = _slide(h, width, np.minimum)
    # strings over the end of a document don't count
    for e in ends[:-1]:
        least[max(0, int(e) - LENGTH + 1) : int(e)] = 0
    pad = np.zeros(width - 1, np.uint64)
    held = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero((held == h) & (held > 0))
    return at, h[at]


_PIECE = "piece string, ids binary, sizes binary, data binary"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, texts, size = [], [], 0

    def row() -> pd.DataFrame:
        out = (
            uuid.uuid4().hex,
            np.array(ids, np.int64).tobytes(),
            np.array([len(t) for t in texts], np.int64).tobytes(),
            zstandard.ZstdCompressor(3).compress(b"".join(texts)),
        )
        return pd.DataFrame([out], columns=["piece", "ids", "sizes", "data"])

    for pdf in batches:
        for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            ids.append(NULL_ID if pd.isna(i) else int(i))
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= PIECE_BYTES or len(ids) >= 20_000:
                yield row()
                ids, texts, size = [], [], 0
    if ids:
        yield row()


class _Docs:
    """A piece and its anchors, with the bytes that their contexts take."""

    def __init__(self, r):
        self.ids = np.frombuffer(r.ids, np.int64)
        sizes = np.frombuffer(r.sizes, np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = zstandard.ZstdDecompressor().decompress(r.data, max_output_size=max(1, int(sizes.sum())))

    def find(self) -> None:
        self.at, self.hash = anchors(np.frombuffer(self.data, np.uint8), self.ends)
        self.row = np.searchsorted(self.ends, self.at, "right")
        self.lo = np.maximum(self.starts[self.row], self.at - (LENGTH - GRAM))
        self.hi = np.minimum(self.ends[self.row], self.at + LENGTH)

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """The anchors of each bucket, in the order of the piece."""
        where = _bucket(self.hash, buckets)
        order = np.argsort(where, kind="stable")
        for b, own in zip(*_cuts(where[order]), strict=True):
            yield int(b), order[own]


def _cuts(x: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The values of a sorted array and where each stands."""
    values, first = np.unique(x, return_index=True)
    return values, [slice(a, b) for a, b in zip(first, np.r_[first[1:], len(x)], strict=True)]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are the smallest hashes around, so their bits are spread before they are dealt."""
    return ((mixed(h) >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _announced(buckets: int):
    """The anchors of a piece by bucket: low bytes of their hashes and of their contexts', and documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p = _Docs(r)
                p.find()
                whole = memoryview(p.data)
                sign = np.fromiter((digest(whole[a:b]) for a, b in zip(p.lo.tolist(), p.hi.tolist(), strict=True)), np.uint64, len(p.at))
                low, sign = p.hash.astype(np.uint32), sign.astype(np.uint32)
                rows = []
                for b, own in p.dealt(buckets):
                    docs, local = np.unique(p.row[own], return_inverse=True)
                    rows.append((b, r.piece, low[own].tobytes(), sign[own].tobytes(), p.ids[docs].tobytes(), local.astype(np.uint16).tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "piece", "hashes", "signs", "ids", "docs"])

    return run


SETTLED, OPEN, HOT = 1, 2, 4


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is known of each anchor of a bucket: settled by a smaller id, or open, and whether hot."""
    sizes = [len(x) // 4 for x in pdf["hashes"]]
    key = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hashes"]]).astype(np.uint64) << np.uint64(32)
    key |= np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["signs"]])
    ids = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(d, np.uint16)] for i, d in zip(pdf["ids"], pdf["docs"], strict=True)])
    order = np.lexsort((ids, key))
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    least = ids[order][np.flatnonzero(new)]
    context = np.cumsum(new) - 1
    # contexts of each anchor hash
    high = sorted_key[new] >> np.uint64(32)
    group = np.cumsum(np.r_[True, high[1:] != high[:-1]]) - 1
    contexts = np.bincount(group)[group]
    settled = ids[order] > least[context]
    flags = np.where(settled, SETTLED, np.where(contexts[context] > 1, OPEN, 0) + np.where(contexts[context] > HOT_CONTEXTS, HOT, 0))
    back = np.empty(len(key), np.uint8)
    back[order] = flags
    parts = np.split(back, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"piece": pdf["piece"], "bucket": pdf["bucket"], "flags": [x.tobytes() for x in parts]})


def _flags(p: _Docs, answers, buckets: int) -> np.ndarray:
    told = {a["bucket"]: a["flags"] for a in answers}
    out = np.zeros(len(p.at), np.uint8)
    for b, own in p.dealt(buckets):
        out[own] = np.frombuffer(told[b], np.uint8)
    return out


_SPANS = "piece string, rows binary, starts binary, ends binary"
_CONTEXTS = "bucket long, piece string, keys binary, rows binary, ids binary, starts binary, sizes binary, data binary"


def _contexts(buckets: int):
    """Bytes around shared anchors by bucket; spans settled inside the piece come with bucket -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p = _Docs(r)
                p.find()
                yield from _emitted(p, r.piece, _flags(p, r.answers, buckets), buckets)

    return run


def _emitted(p: _Docs, piece: str, flags: np.ndarray, buckets: int) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]
    whole = p.hi - p.lo >= LENGTH
    settled = np.flatnonzero((flags & SETTLED > 0) & whole)
    if len(settled):
        row, lo, size = p.row[settled], p.lo[settled], (p.hi - p.lo)[settled]
        own = [x.astype(np.uint32).tobytes() for x in (row, lo - p.starts[row], size)]
        yield pd.DataFrame([(-1, piece, b"", own[0], b"", own[1], own[2], b"")], columns=names)
    pick = np.flatnonzero((flags & OPEN > 0) & whole)
    row, lo, hi, key, hot = p.row[pick], p.lo[pick], p.hi[pick], p.hash[pick], flags[pick] & HOT > 0
    if hot.any():
        # each string of a hot anchor by itself, dealt by its own bytes
        n = hi[hot] - lo[hot] - LENGTH + 1
        first = np.repeat(lo[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.fromiter((xxhash.xxh3_64_intdigest(p.data[s : s + LENGTH]) for s in first.tolist()), np.uint64, len(first))
        row = np.concatenate([row[~hot], np.repeat(row[hot], n)])
        lo, hi = np.concatenate([lo[~hot], first]), np.concatenate([hi[~hot], first + LENGTH])
        key = np.concatenate([key[~hot], own])
    where = _bucket(key, buckets)
    order = np.argsort(where, kind="stable")
    pack = zstandard.ZstdCompressor(1)
    rows = []
    for b, at in zip(*_cuts(where[order]), strict=True):
        x = order[at]
        data = b"".join([p.data[s:e] for s, e in zip(lo[x].tolist(), hi[x].tolist(), strict=True)])
        small = [v.astype(np.uint32).tobytes() for v in (row[x], lo[x] - p.starts[row[x]], (hi - lo)[x])]
        rows.append((int(b), piece, key[x].tobytes(), small[0], p.ids[row[x]].tobytes(), small[1], small[2], pack.compress(data)))
    if rows:
        yield pd.DataFrame(rows, columns=names)


def equal_strings(text: np.ndarray, length: int) -> np.ndarray:
    """Classes of the places of a text by the ``length`` symbols from there on.

    ``text`` holds symbols from 1 on, and a different symbol above 256 at the end of each context.
    The order of suffixes is made deep enough for the length; then the boundaries between intervals
    of a common prefix are moved backwards through the transform, one symbol a step. The order in
    which equal symbols follow each other in the transform is that of the suffixes behind them, so
    a step is a walk over the intervals in that order: a boundary appears where symbol or interval
    changes.
    """
    n = len(text)
    # several symbols at once for a start, as many as fit into one number
    rank, depth, bits = text.astype(np.int64), 1, int(text.max()).bit_length()
    while depth < 4 and bits * 2 * depth <= 62:
        behind = np.zeros(n, np.int64)
        behind[: n - depth] = rank[depth:]
        rank = (rank << (bits * depth)) | behind
        depth *= 2
    key = rank
    while True:
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if depth >= length:
            break
        key = rank * (n + 1)
        key[: n - depth] += rank[depth:]
        depth *= 2
    before = text[order - 1]
    walk = np.argsort(before.astype(np.uint16) if before.max() < 1 << 16 else before, kind="stable")
    symbol_changes = np.ones(n, bool)
    symbol_changes[1:] = before[walk][1:] != before[walk][:-1]
    interval, boundary = np.zeros(n, np.int32), np.ones(n, bool)
    for _ in range(length):
        moved = interval.take(walk)
        np.not_equal(moved[1:], moved[:-1], out=boundary[1:])
        np.logical_or(boundary, symbol_changes, out=boundary)
        np.cumsum(boundary, dtype=np.int32, out=interval)
    out = np.empty(n, np.int64)
    out[order] = interval
    return out


def _expanded(data: bytes, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each context, the places in it whose string also starts in a smaller id's context."""
    raw = np.frombuffer(data, np.uint8)
    total = int(sizes.sum()) + len(sizes)
    text, owner = np.empty(total, np.int64), np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    source = np.repeat(begins, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[inside] = raw[source].astype(np.int64) + 1
    text[~inside] = 257 + np.arange(len(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    classes = equal_strings(text, LENGTH)
    place = np.arange(total) - (ends - sizes - 1)[owner]
    whole = place + LENGTH <= sizes[owner]
    who, cls, at = owner[whole], classes[whole], place[whole]
    least = np.full(int(classes.max()) + 1, NULL_ID)
    np.minimum.at(least, cls, ids[who])
    hit = ids[who] > least[cls]
    who, at = who[hit], at[hit]
    if not len(who):
        return
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(who)], strict=True):
        yield int(who[a]), at[a:b]


def _searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a bucket follow one another; spans to remove come out by piece."""
    held, at = [], None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.bucket == -1:
                starts = np.frombuffer(r.starts, np.uint32)
                ends = starts + np.frombuffer(r.sizes, np.uint32)
                yield _span_rows([(r.piece, r.rows, r.starts, ends.astype(np.uint32).tobytes())])
                continue
            if at is not None and r.bucket != at and held:
                yield _span_rows(_bucket_spans(held))
                held = []
            at = r.bucket
            held.append(r)
    if held:
        yield _span_rows(_bucket_spans(held))


def _span_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["piece", "rows", "starts", "ends"])


def _bucket_spans(held: list) -> list[tuple]:
    unpack = zstandard.ZstdDecompressor()
    data = b"".join(unpack.decompress(r.data) for r in held)
    key = np.concatenate([np.frombuffer(r.keys, np.uint64) for r in held])
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in held])
    row = np.concatenate([np.frombuffer(r.rows, np.uint32) for r in held]).astype(np.int64)
    start = np.concatenate([np.frombuffer(r.starts, np.uint32) for r in held]).astype(np.int64)
    size = np.concatenate([np.frombuffer(r.sizes, np.uint32) for r in held]).astype(np.int64)
    piece = np.repeat(np.arange(len(held)), [len(r.keys) // 8 for r in held])
    begin = np.cumsum(size) - size
    sign = np.fromiter(
        (xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)), np.uint64, len(size)
    )
    order = np.lexsort((ids, sign, key))
    key, sign, ids, row, start, size, piece, begin = (x[order] for x in (key, sign, ids, row, start, size, piece, begin))
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= sign[1:] != sign[:-1]
    first = np.flatnonzero(new)
    variant = np.cumsum(new) - 1
    out_entry, out_from, out_to = [], [], []
    settled = np.flatnonzero(ids > ids[first][variant])
    out_entry.append(settled)
    out_from.append(start[settled])
    out_to.append(start[settled] + size[settled])
    # variants of a key that has several, key by key in blocks
    group = (np.cumsum(new_key) - 1)[first]
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    holders = _holders(variant, ids, first)
    done = 0
    while done < len(several):
        reach = np.searchsorted(np.cumsum(size[first[several[done:]]]), BLOCK_CHARS) + done + 1
        while reach < len(several) and group[several[reach]] == group[several[reach - 1]]:
            reach += 1
        block = several[done:reach]
        v = first[block]
        for k, places in _expanded(data, begin[v], size[v], ids[v]):
            a, b = _runs(places)
            for e in holders(int(block[k])):
                out_entry.append(np.full(len(a), e))
                out_from.append(start[e] + a)
                out_to.append(start[e] + b)
        done = reach
    entry, lo, hi = np.concatenate(out_entry), np.concatenate(out_from), np.concatenate(out_to)
    owner = piece[entry]
    by = np.argsort(owner, kind="stable")
    entry, lo, hi, owner = entry[by], lo[by], hi[by], owner[by]
    rows = []
    for k in np.unique(owner):
        x, y = np.searchsorted(owner, k), np.searchsorted(owner, k, "right")
        rows.append(
            (held[k].piece, row[entry[x:y]].astype(np.uint32).tobytes(), lo[x:y].astype(np.uint32).tobytes(), hi[x:y].astype(np.uint32).tobytes())
        )
    return rows


def _holders(variant: np.ndarray, ids: np.ndarray, first: np.ndarray):
    """The entries of a variant that have its smallest id."""

    def of(v: int) -> range:
        a = int(first[v])
        b = a
        while b < len(ids) and variant[b] == v and ids[b] == ids[a]:
            b += 1
        return range(a, b)

    return of


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered stretches of strings that start at sorted places."""
    cut = np.flatnonzero(places[1:] > places[:-1] + LENGTH) + 1
    return places[np.r_[0, cut]], places[np.r_[cut - 1, len(places) - 1]] + LENGTH


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            p = _Docs(r)
            gone = np.zeros(len(p.data) + 1, np.int32)
            for s in r.spans:
                base = p.starts[np.frombuffer(s["rows"], np.uint32).astype(np.int64)]
                np.add.at(gone, base + np.frombuffer(s["starts"], np.uint32), 1)
                np.add.at(gone, base + np.frombuffer(s["ends"], np.uint32), -1)
            removed = np.cumsum(gone[:-1]) > 0
            data = np.frombuffer(p.data, np.uint8)
            rows = []
            for i, a, b in zip(p.ids.tolist(), p.starts.tolist(), p.ends.tolist(), strict=True):
                own = removed[a:b]
                n = int(own.sum())
                spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
                kept = data[a:b][~own].tobytes() if n else p.data[a:b]
                rows.append((None if i == NULL_ID else i, b - a, n, spans, kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n_bytes, n_removed, n_spans and the kept bytes of each document."""
    spark = docs.sparkSession
    bounded_batches(spark, 200)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // BUCKET_BYTES))
    pieces = written(texts.mapInPandas(_packed, _PIECE), "pieces")
    spread = min(buckets, 100_000)
    asked = pieces.mapInPandas(_announced(buckets), "bucket long, piece string, hashes binary, signs binary, ids binary, docs binary")
    answers = asked.repartition(spread, "bucket").groupBy("bucket").applyInPandas(_answered, "piece string, bucket long, flags binary")
    told = answers.groupBy("piece").agg(F.collect_list(F.struct("bucket", "flags")).alias("answers"))
    contexts = pieces.join(told, "piece").mapInPandas(_contexts(buckets), _CONTEXTS)
    met = contexts.repartition(spread, "bucket", F.when(F.col("bucket") == -1, F.col("piece"))).sortWithinPartitions("bucket")
    spans = met.mapInPandas(_searched, _SPANS)
    by_piece = spans.groupBy("piece").agg(F.collect_list(F.struct("rows", "starts", "ends")).alias("spans"))
    none = F.array().cast("array<struct<rows:binary,starts:binary,ends:binary>>")
    whole = pieces.join(by_piece, "piece", "left").withColumn("spans", F.coalesce("spans", none))
    return whole.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def digest(kept: bytes) -> str:
    """The query's digest of kept bytes (for tests)."""
    return hashlib.sha256(kept).hexdigest()
