"""Whitening of embeddings by an incremental eigendecomposition.

Each entry c becomes the whole number floor(256 * c). The spectrum of the distinct vectors is built up,
never from a finished covariance:

1. Distinct vectors (combined on the map side, so a common vector leaves a task once) are dealt to
   pieces of about ``PIECE`` rows. A piece takes its vectors one by one: a centred rank-one change of
   its scatter, whose new eigenvalues are the roots of a secular equation, after deflation of entries
   and pairs that don't move (``grown``).
2. Pieces are combined in a tree of ``FAN`` at a time: the eigenpairs of one are rank-one changes of
   the other, and one more carries the distance of the means.
3. Rayleigh-Ritz: every task projects its centred vectors on the basis so found and sums the products;
   the eigenvectors of that nearly diagonal matrix turn the basis into the components.
4. One more pass measures the covariance of the whitened vectors.

A task holds FAN spectra of d x d doubles at most, d being the length of a vector; the driver holds one
model per length. Sums are whole numbers of any size, so n, S and the deviation are exact.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry give no rows; nor do
empty vectors, which have no component. Vectors of different lengths are populations of their own.
Repeated vectors count once in the fit and each get their rows; a null vec_id is kept. Entries too large
for a long stay at its bounds, as in Spark's floor. Shorter vectors than ``COMPONENTS`` have as many components as
entries. A component without variance (e not above d * eps * the largest) has a null whitened value and
stays out of identity_error; explained is then 0, or null where nothing varies. A deviation beyond a long is null there and
whole in deviation_exact. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm.text import bounded_batches, table
from seriesmill.session import written

COMPONENTS = 4
#: Vectors of a piece, about six seconds of updates at 64 entries; and pieces at most.
PIECE, PIECES = 10_000, 20_000
#: Spectra or sums that one task combines.
FAN = 8
EPS = float(np.finfo(np.float64).eps)
WHOLE = 1 << 62

SPECTRUM = "d int, place long, n long, sums array<string>, spread array<double>, basis binary"
PRODUCTS = "d int, place long, products binary"
PRODUCT_FIELDS = pa.schema([("d", pa.int32()), ("place", pa.int64()), ("products", pa.binary())])
ROWS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
    "deviation_exact string, refinement double"
)


def entries(embedding: Column) -> Column:
    """The whole numbers of a vector, or null where the row is to be dropped."""
    whole = F.transform(embedding, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long") + F.lit(0))
    broken = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | F.abs(c.cast("double")).isin(float("inf")))
    return F.when(embedding.isNotNull() & ~broken & (F.size(embedding) > 0), whole)


# The spectrum of a piece


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x), one right of each d (rising).

    Returned as the pole nearest to each and the root's distances ``x - d`` from all poles, which keeps
    their digits. Each step solves the equation with two poles left that agrees in value and slopes on
    both sides; steps that leave the bracket are halvings.
    """
    r = len(d)
    top = z2.sum()
    poles = np.append(d, d[-1] + top)
    gap = np.diff(poles)
    left = np.tril(np.ones((r, r), bool))
    middle = 1 + ((z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1))
    near = np.arange(r) + (middle < 0)
    near[-1] = r - 1
    start = poles[near]
    delta = d[None, :] - start[:, None]
    low = np.where(near == np.arange(r), 0.0, -gap / 2)
    high = np.where(near == np.arange(r), gap / 2, 0.0)
    high[-1] = top
    own, after = poles[:-1] - start, poles[1:] - start
    x = (low + high) / 2
    for _ in range(80):
        parts = z2 / (delta - x[:, None])
        slopes = parts / (delta - x[:, None])
        value = 1 + parts.sum(1)
        size = 1 + np.abs(parts).sum(1)
        done = np.abs(value) <= 2 * EPS * size
        low = np.where(value < 0, x, low)
        high = np.where(value > 0, x, high)
        done |= high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high))
        if done.all():
            break
        slope_left = np.where(left, slopes, 0.0).sum(1)
        slope_right = slopes.sum(1) - slope_left
        a0, b0 = own - x, after - x
        c = value - a0 * slope_left - b0 * slope_right
        a = (a0 + b0) * value - a0 * b0 * (slope_left + slope_right)
        b = a0 * b0 * value
        root = np.sqrt(np.abs(a * a - 4 * b * c))
        step = np.where(a <= 0, (a - root) / np.where(c == 0, 1.0, 2 * c), 2 * b / np.where(a + root == 0, 1.0, a + root))
        new = x + step
        inside = (new > low) & (new < high) & np.isfinite(new)
        x = np.where(done, x, np.where(inside, new, (low + high) / 2))
    return start + x, x[:, None] - delta


def _turned(d: np.ndarray, z: np.ndarray, basis: np.ndarray, live: np.ndarray, small: float) -> None:
    """Where two eigenvalues are too close to be told apart, turn their vectors until only one feels the change."""
    if len(live) < 2:
        return
    a, b = live[:-1], live[1:]
    if not ((d[b] - d[a]) * np.abs(z[a] * z[b]) <= small * (z[a] ** 2 + z[b] ** 2)).any():
        return
    at = live[0]
    for k in live[1:]:
        both = math.hypot(z[at], z[k])
        c, s = z[k] / both, z[at] / both
        if (d[k] - d[at]) * abs(c * s) <= small:
            first, second = basis[:, at].copy(), basis[:, k].copy()
            basis[:, at], basis[:, k] = c * first - s * second, s * first + c * second
            d[at], d[k] = c * c * d[at] + s * s * d[k], s * s * d[at] + c * c * d[k]
            z[at], z[k] = 0.0, both
        at = k


def grown(spread: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``basis diag(spread) basisᵀ + v vᵀ``; a direction not seen before is a new column."""
    length = math.sqrt(float(v @ v))
    if length == 0:
        return spread, basis
    z = basis.T @ v
    rest = v - basis @ z
    if basis.shape[1] < len(v):
        more = basis.T @ rest
        rest, z = rest - basis @ more, z + more
        beta = math.sqrt(float(rest @ rest))
        if beta > 64 * EPS * length:
            spread = np.concatenate(([0.0], spread))
            basis = np.column_stack((rest / beta, basis))
            z = np.concatenate(([beta], z))
    small = 8 * EPS * max(float(spread[-1]) if len(spread) else 0.0, length * length)
    spread, basis = spread.copy(), basis.copy()
    _turned(spread, z, basis, np.flatnonzero(np.abs(z) > small / length), small)
    live = np.abs(z) > small / length
    if not live.any():
        return spread, basis
    d, zl = spread[live], z[live]
    order = np.argsort(d, kind="stable")
    d, zl = d[order], zl[order]
    roots, off = _roots(d, zl * zl)
    # The change that has exactly these roots; with it the new vectors are orthogonal to the last digit.
    between = d[:, None] - d[None, :]
    np.fill_diagonal(between, 1.0)
    again = np.sqrt(np.abs((off / between).prod(0))) * np.sign(zl)
    inner = again[:, None] / np.where(off.T == 0, EPS * EPS, off.T)
    inner /= np.sqrt((inner * inner).sum(0))
    spread[live] = roots
    basis[:, live] = basis[:, live][:, order] @ inner
    order = np.argsort(spread, kind="stable")
    return spread[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, exact sums and scatter eigenpairs (rising) of some vectors."""

    n: int
    sums: list[int]
    spread: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.empty(0), np.empty((d, 0)))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def take(self, x: np.ndarray) -> None:
        """One vector more."""
        if self.n:
            v = (x.astype(np.float64) - self.mean()) * math.sqrt(self.n / (self.n + 1))
            self.spread, self.basis = grown(self.spread, self.basis, v)
        self.sums = [s + k for s, k in zip(self.sums, x.tolist())]
        self.n += 1

    def join(self, other: Spectrum) -> None:
        """The eigenpairs of the other one, as successive rank-one changes."""
        if not self.n or not other.n:
            if other.n:
                self.n, self.sums, self.spread, self.basis = other.n, other.sums, other.spread, other.basis
            return
        apart = (self.mean() - other.mean()) * math.sqrt(self.n / (self.n + other.n) * other.n)
        self.spread, self.basis = grown(self.spread, self.basis, apart)
        for size, vector in zip(other.spread, other.basis.T):
            if size > 0:
                self.spread, self.basis = grown(self.spread, self.basis, vector * math.sqrt(size))
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self.n += other.n


# Tables of spectra and sums


def _vectors(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length: that length, the places of its rows and their entries."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _spectrum_rows(found: dict[int, Spectrum], place: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "d": pa.array(list(found), pa.int32()),
            "place": pa.array([place] * len(found), pa.int64()),
            "n": pa.array([s.n for s in found.values()], pa.int64()),
            "sums": pa.array([[str(k) for k in s.sums] for s in found.values()], pa.list_(pa.string())),
            "spread": pa.array([s.spread.tolist() for s in found.values()], pa.list_(pa.float64())),
            "basis": pa.array([s.basis.tobytes() for s in found.values()], pa.binary()),
        }
    )


def _spectrum(d: int, row: dict) -> Spectrum:
    basis = np.frombuffer(row["basis"], np.float64).reshape(d, -1) if row["spread"] else np.empty((d, 0))
    return Spectrum(row["n"], [int(s) for s in row["sums"]], np.array(row["spread"], np.float64), basis)


def _piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Spectrum] = {}
    for batch in batches:
        for d, _, x in _vectors(batch.column(0)):
            own = found.setdefault(d, Spectrum.empty(d))
            for row in x:
                own.take(row)
    if found:
        yield _spectrum_rows(found, TaskContext.get().partitionId())


def _joined(key: tuple, rows: pa.Table) -> pa.Table:
    d, place = key[0].as_py(), key[1].as_py()
    total = Spectrum.empty(d)
    for row in rows.sort_by("place").to_pylist():
        total.join(_spectrum(d, row))
    return pa.Table.from_batches([_spectrum_rows({d: total}, place)])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(row["products"], np.float64) for row in rows.sort_by("place").to_pylist())
    return pa.table({"d": [key[0].as_py()], "place": [key[1].as_py()], "products": [total.tobytes()]}, PRODUCT_FIELDS)


def _tree(rows: DataFrame, combine: Callable, schema: str, name: str) -> DataFrame:
    """Combine the rows of a length, ``FAN`` at a time, until one is left of each."""
    while True:
        most = rows.groupBy("d").count().agg(F.max("count")).first()[0]
        if most is None or most <= 1:
            return rows
        # Places are partition numbers, so they fall below FAN after as many steps as they have digits.
        now = rows.withColumn("group", F.floor(F.col("place") / FAN))
        rows = written(now.groupBy("d", "group").applyInArrow(combine, schema), name)


# The fit


@dataclass
class Model:
    """What whitens the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    values: np.ndarray
    explained: np.ndarray
    refinement: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(np.where(self.values > 0, self.values, np.nan))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact: in 64 bits where no step can leave them."""
        most = self.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in self.sums)
        if most * most * x.shape[1] < WHOLE:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        return [sum((self.n * k - s) ** 2 for k, s in zip(row, self.sums)) for row in x.tolist()]


def _products(fit: DataFrame, project: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """Per partition and length, the summed products of projected vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _vectors(batch.column(0)):
                y = project(d, x)
                found[d] = found.get(d, 0.0) + y.T @ y
        if found:
            place = TaskContext.get().partitionId()
            rows = {"d": list(found), "place": [place] * len(found), "products": [m.tobytes() for m in found.values()]}
            yield pa.RecordBatch.from_pydict(rows, PRODUCT_FIELDS)

    return written(fit.mapInArrow(run, PRODUCTS), "products")


def _refined(spectrum: Spectrum, products: np.ndarray) -> Model:
    """Rayleigh-Ritz: the products in the basis are nearly diagonal; their eigenvectors correct the basis."""
    rank, n = spectrum.basis.shape[1], spectrum.n
    d = spectrum.basis.shape[0]
    kept = min(COMPONENTS, d)
    b = products.reshape(rank, rank) / n
    values, turn = np.linalg.eigh((b + b.T) / 2) if rank else (np.empty(0), np.empty((0, 0)))
    values, turn = values[::-1], turn[:, ::-1]
    total = float(np.trace(b)) if rank else 0.0
    largest = float(values[0]) if rank else 0.0
    off = float(np.abs(b - np.diag(np.diag(b))).max() / largest) if largest > 0 else 0.0
    vectors = np.zeros((d, kept))
    sizes = np.zeros(kept)
    take = min(kept, rank)
    vectors[:, :take] = spectrum.basis @ turn[:, :take]
    sizes[:take] = np.where(values[:take] > d * EPS * largest, values[:take], 0.0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(kept)] < 0, -1.0, 1.0)
    return Model(n, spectrum.sums, vectors, sizes, sizes / total if total > 0 else np.full(kept, np.nan), off)


def distinct_entries(embeddings: DataFrame) -> DataFrame:
    """The fit list: each distinct vector of whole numbers once."""
    return written(embeddings.select(entries(F.col("embedding")).alias("x")).where("x IS NOT NULL").distinct(), "fit")


def spectra(fit: DataFrame) -> DataFrame:
    """One spectrum per length of vector."""
    n = fit.count()
    pieces = fit.repartition(max(1, min(PIECES, math.ceil(n / PIECE))))
    return _tree(written(pieces.mapInArrow(_piece, SPECTRUM), "spectra"), _joined, SPECTRUM, "spectra")


def fitted(embeddings: DataFrame) -> dict[int, Model]:
    """A model per length of vector."""
    bounded_batches(embeddings.sparkSession, 2000)
    fit = distinct_entries(embeddings)
    found: dict[int, Spectrum] = {}
    for row in spectra(fit).toLocalIterator():
        s = _spectrum(row["d"], row.asDict())
        # Small errors of thousands of updates add up in the basis; it is made orthonormal again.
        s.basis = np.linalg.qr(s.basis)[0] if len(s.spread) else s.basis
        found[row["d"]] = s
    means = {d: (s.mean(), s.basis) for d, s in found.items()}
    sums = _tree(_products(fit, lambda d, x: (x.astype(np.float64) - means[d][0]) @ means[d][1]), _added, PRODUCTS, "products")
    models = {row["d"]: _refined(found[row["d"]], np.frombuffer(row["products"], np.float64)) for row in sums.toLocalIterator()}
    checks = _tree(_products(fit, lambda d, x: models[d].whitened(x)), _added, PRODUCTS, "products")
    for row in checks.toLocalIterator():
        model = models[row["d"]]
        moves = model.values > 0
        covariance = np.frombuffer(row["products"], np.float64).reshape(len(moves), -1) / model.n
        error = np.abs(covariance - np.eye(len(moves)))[np.ix_(moves, moves)]
        model.identity_error = float(error.max()) if moves.any() else None
    return models


def whitened(embeddings: DataFrame) -> DataFrame:
    """A row per vector that isn't dropped and component."""
    models = fitted(embeddings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _vectors(batch.column(1)):
                m = models[d]
                k = m.components.shape[1]
                deviations = m.deviations(x)
                ids = batch.column(0).take(pa.array(rows))
                each = np.repeat(np.arange(len(rows)), k)
                exact = [deviations[i] for i in each]
                values = m.whitened(x).reshape(-1)
                shares = np.tile(m.explained, len(rows))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(each)),
                        "component": pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                        "n": pa.array([m.n] * len(each), pa.int64()),
                        "deviation": pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                        "whitened": pa.array(values, pa.float64(), mask=np.isnan(values)),
                        "explained": pa.array(shares, pa.float64(), mask=np.isnan(shares)),
                        "identity_error": pa.array([m.identity_error] * len(each), pa.float64()),
                        "deviation_exact": pa.array([str(v) for v in exact], pa.string()),
                        "refinement": pa.array([m.refinement] * len(each), pa.float64()),
                    }
                )

    bounded_batches(embeddings.sparkSession, 2000)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries(F.col("embedding")).alias("x"))
    return rows.where("x IS NOT NULL").mapInArrow(run, ROWS)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
