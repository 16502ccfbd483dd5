"""Small vectorised fitters behind one Arrow batch call over the panel.

Spark partitions the panel by series; inside a batch the rows of equal length are stacked, so a
parameter grid is one NumPy recursion over (series × grid) rather than one fit per series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values ahead, [series, h]; and, of fitters that know it, the standard deviation of their errors at each step.
Answer = np.ndarray | tuple[np.ndarray, np.ndarray]
Fitter = Callable[[np.ndarray, int, int], Answer]

ALPHAS = np.array([0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
TREND_SHARES = np.array([0.05, 0.2, 0.5])
SEASON_SHARES = np.array([0.05, 0.2])
DAMPINGS = np.array([0.8, 0.9, 0.98])
MIN_LENGTH = 8
CHUNK = 512


def _grid(trend: str, seasonal: str) -> np.ndarray:
    """Columns alpha, beta, phi, gamma of every parameter combination of a form."""
    shares = TREND_SHARES if trend != "N" else np.zeros(1)
    phis = DAMPINGS if trend == "Ad" else np.ones(1)
    gammas = SEASON_SHARES if seasonal != "N" else np.zeros(1)
    a, b, p, g = (x.ravel() for x in np.meshgrid(ALPHAS, shares, phis, gammas, indexing="ij"))
    return np.stack([a, a * b, p, (1 - a) * g])


def smooth(y: np.ndarray, h: int, season: int, trend: str, seasonal: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best grid point per series of one exponential-smoothing form: (AICc, h values, their deviations).

    An error of one at some step moves the state by the smoothing weights, and with it every later value; the variance of a
    step is that of its own error and of the moves by all errors before it. For multiplicative seasons
    the moves are those of first order.
    """
    s, n = y.shape
    alpha, beta, phi, gamma = _grid(trend, seasonal)
    if seasonal == "N":
        reach = min(4, n - 1)
        slope = (y[:, reach] - y[:, 0]) / reach if trend != "N" else np.zeros(s)
        level = y[:, 0] - slope
    else:
        first, second = y[:, :season].mean(axis=1), y[:, season : 2 * season].mean(axis=1)
        slope = (second - first) / season if trend != "N" else np.zeros(s)
        level = first - slope * (season + 1) / 2
        base = level[:, None] + slope[:, None] * np.arange(1, season + 1)
        pattern = y[:, :season] - base if seasonal == "A" else y[:, :season] / np.where(base == 0, np.nan, base)
    shape = (s, alpha.size)
    lev, tre = np.broadcast_to(level[:, None], shape).copy(), np.broadcast_to(slope[:, None], shape).copy()
    cycle = [np.broadcast_to(pattern[:, [i]], shape).copy() for i in range(season)] if seasonal != "N" else None
    sse = np.zeros(shape)
    for t in range(n):
        ahead = lev + phi * tre
        if cycle is None:
            err = y[:, [t]] - ahead
            move = err
        else:
            now = cycle[t % season]
            err = y[:, [t]] - (ahead + now if seasonal == "A" else ahead * now)
            move = err if seasonal == "A" else err / now
            cycle[t % season] = now + gamma * (err if seasonal == "A" else err / ahead)
        lev, tre = ahead + alpha * move, phi * tre + beta * move
        sse += err * err
    sse = np.where(np.isfinite(sse), sse, np.inf)
    best, rows = sse.argmin(axis=1), np.arange(s)
    k = 2 + (0 if trend == "N" else 2) + (trend == "Ad") + (0 if seasonal == "N" else season)
    scale = np.maximum((y * y).sum(axis=1), 1.0) * 1e-12
    spare = n - k - 1
    fit = n * np.log(np.maximum(sse[rows, best], scale) / n)
    aicc = fit + 2 * k + (2 * k * (k + 1) / spare if spare > 0 else np.inf)
    steps = np.arange(1, h + 1)
    damp = np.cumsum(phi[best][:, None] ** steps, axis=1)
    trended = lev[rows, best][:, None] + damp * tre[rows, best][:, None]
    moved = alpha[best][:, None] + beta[best][:, None] * damp  # by an error 1, 2, ... steps before
    back = np.where(steps % max(season, 1) == 0, gamma[best][:, None], 0.0) if cycle is not None else np.zeros((s, h))
    out = trended
    if cycle is not None:
        wave = np.stack([cycle[(n + i) % season][rows, best] for i in range(h)], axis=1)
        out = trended + wave if seasonal == "A" else trended * wave
    total = np.ones((s, h))
    for i in range(h - 1):
        later = slice(i + 1, h)
        if seasonal == "M":
            move = moved[:, : h - 1 - i] * wave[:, later] / wave[:, [i]] + back[:, : h - 1 - i] * trended[:, later] / trended[:, [i]]
        else:
            move = moved[:, : h - 1 - i] + back[:, : h - 1 - i]
        total[:, later] += move * move
    deviation = np.sqrt(sse[rows, best] / max(n - k, 1))[:, None] * np.sqrt(total)
    return np.where(np.isfinite(sse[rows, best]), aicc, np.inf), out, deviation


def _pick(y: np.ndarray, h: int, season: int, forms: list[tuple[str, str]]) -> Answer:
    n = y.shape[1]
    usable = [f for f in forms if f[1] == "N" or (season > 1 and n >= 2 * season + 2)]
    fits = [smooth(y, h, season, trend, seasonal) for trend, seasonal in usable]
    order = np.stack([f[0] for f in fits]).argmin(axis=0)
    rows = np.arange(y.shape[0])
    return np.stack([f[1] for f in fits])[order, rows], np.stack([f[2] for f in fits])[order, rows]


def holt(y: np.ndarray, h: int, season: int) -> Answer:
    return smooth(y, h, season, "A", "N")[1:]


def holt_damped(y: np.ndarray, h: int, season: int) -> Answer:
    return smooth(y, h, season, "Ad", "N")[1:]


def auto_ets(y: np.ndarray, h: int, season: int) -> Answer:
    return _pick(y, h, season, [(t, s) for t in ("N", "A", "Ad") for s in ("N", "A", "M")])


def ets_damped(y: np.ndarray, h: int, season: int) -> Answer:
    return _pick(y, h, season, [("Ad", s) for s in ("N", "A", "M")])


def seasonal_index(y: np.ndarray, season: int) -> np.ndarray:
    """Additive seasonal means of the series around its centred moving average; zero if not seasonal."""
    s, n = y.shape
    if season < 2 or n < 2 * season:
        return np.zeros((s, max(season, 1)))
    weights = np.r_[0.5, np.ones(season - 1), 0.5] / season if season % 2 == 0 else np.ones(season) / season
    half = len(weights) // 2
    centre = np.stack([y[:, i : i + len(weights)] @ weights for i in range(n - len(weights) + 1)], axis=1)
    off = y[:, half : half + centre.shape[1]] - centre
    slots = (np.arange(centre.shape[1]) + half) % season
    index = np.stack([off[:, slots == j].mean(axis=1) for j in range(season)], axis=1)
    index -= index.mean(axis=1, keepdims=True)
    dev = y - y.mean(axis=1, keepdims=True)
    power = np.maximum((dev * dev).sum(axis=1), 1e-300)
    acf = np.stack([(dev[:, k:] * dev[:, :-k]).sum(axis=1) / power for k in range(1, season + 1)], axis=1)
    bound = 1.645 * np.sqrt((1 + 2 * (acf[:, :-1] ** 2).sum(axis=1)) / n)
    return np.where((np.abs(acf[:, -1]) > bound)[:, None], index, 0.0)


def auto_theta(y: np.ndarray, h: int, season: int) -> Answer:
    """Simple smoothing plus a share of the linear trend; the share with the least squared error.

    Only the level carries errors on, each by the smoothing weight.
    """
    s, n = y.shape
    index = seasonal_index(y, season)
    width = index.shape[1]
    z = y - index[:, np.arange(n) % width]
    t = np.arange(n) - (n - 1) / 2
    slope = (z @ t) / (t @ t)
    alpha = np.linspace(0.05, 0.95, 19)
    level = np.broadcast_to(z[:, [0]], (s, alpha.size)).copy()
    shares = (0.0, 0.5, 2 / 3)
    sse = [np.zeros((s, alpha.size)) for _ in shares]
    for i in range(1, n):
        grown = (1 - (1 - alpha) ** i) / alpha
        for j, share in enumerate(shares):
            sse[j] += (z[:, [i]] - level - share * slope[:, None] * grown) ** 2
        level = level + alpha * (z[:, [i]] - level)
    errors = np.concatenate(sse, axis=1)
    flat = errors.argmin(axis=1)
    sigma = np.sqrt(errors[np.arange(s), flat] / max(n - 3, 1))
    share, a = np.array(shares)[flat // alpha.size], alpha[flat % alpha.size]
    start = level[np.arange(s), flat % alpha.size]
    steps = np.arange(h)[None, :] + ((1 - (1 - a) ** n) / a)[:, None]
    out = start[:, None] + (share * slope)[:, None] * steps
    deviation = sigma[:, None] * np.sqrt(1 + np.arange(h)[None, :] * a[:, None] ** 2)
    return out + index[:, (n + np.arange(h)) % width], deviation


def _regress(z: np.ndarray, lags: tuple[int, ...], start: int, x: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of z on its lags (and x) from ``start`` on: (coefficients, squared error)."""
    s, n = z.shape
    cols = [np.ones((s, n - start))] + [z[:, start - k : n - k] for k in lags]
    if x is not None:
        cols += [x[:, start:, j] for j in range(x.shape[2])]
    design, target = np.stack(cols, axis=2), z[:, start:]
    gram = np.einsum("sti,stj->sij", design, design)
    right = np.einsum("sti,st->si", design, target)
    ridge = 1e-9 * np.maximum(np.einsum("sii->s", gram), 1.0)
    coef = np.linalg.solve(gram + ridge[:, None, None] * np.eye(gram.shape[1]), right[..., None])[..., 0]
    resid = target - np.einsum("sti,si->st", design, coef)
    return coef, (resid * resid).sum(axis=1)


def _roll(z: np.ndarray, lags: tuple[int, ...], coef: np.ndarray, h: int, x_next: np.ndarray | None) -> np.ndarray:
    path = z
    for i in range(h):
        step = coef[:, 0] + sum(coef[:, 1 + j] * path[:, -k] for j, k in enumerate(lags))
        if x_next is not None:
            step = step + (coef[:, 1 + len(lags) :] * x_next[:, i, :]).sum(axis=1)
        path = np.concatenate([path, step[:, None]], axis=1)
    return path[:, z.shape[1] :]


def _responses(lags: tuple[int, ...], coef: np.ndarray, h: int) -> np.ndarray:
    """What an error of one leaves in the values 0, 1, ... h - 1 steps later."""
    psi = np.zeros((coef.shape[0], h))
    psi[:, 0] = 1.0
    for j in range(1, h):
        psi[:, j] = sum((coef[:, 1 + i] * psi[:, j - k] for i, k in enumerate(lags) if k <= j), np.zeros(coef.shape[0]))
    return psi


def auto_ar(y: np.ndarray, h: int, season: int, x: np.ndarray | None = None, x_next: np.ndarray | None = None) -> Answer:
    """Order search over p ≤ 3, one seasonal lag and first differences, by AICc on one sample."""
    s, n = y.shape
    # a series that no order fits stays without an answer
    best, out, deviation = np.full(s, np.inf), np.full((s, h), np.nan), np.full((s, h), np.nan)
    seasonal = season > 1 and n >= 2 * season + 8
    start = (season if seasonal else 3) + 1
    for d in (0, 1):
        z = np.diff(y, axis=1) if d else y
        xd = None if x is None else (np.diff(x, axis=1) if d else x)
        fd = None
        if x_next is not None:
            fd = np.diff(np.concatenate([x[:, -1:], x_next], axis=1), axis=1) if d else x_next
        for p in range(4):
            for extra in ((), (season,)) if seasonal else ((),):
                lags = (*range(1, p + 1), *extra)
                used = start - d
                obs, k = z.shape[1] - used, 2 + len(lags) + (0 if x is None else x.shape[2])
                if obs - k - 1 <= 0:
                    continue
                coef, sse = _regress(z, lags, used, xd)
                scale = np.maximum((y * y).sum(axis=1), 1.0) * 1e-12
                aicc = obs * np.log(np.maximum(sse, scale) / obs) + 2 * k + 2 * k * (k + 1) / (obs - k - 1)
                path = _roll(z, lags, coef, h, fd)
                path = y[:, -1:] + np.cumsum(path, axis=1) if d else path
                psi = _responses(lags, coef, h)
                psi = np.cumsum(psi, axis=1) if d else psi
                spread = np.sqrt(sse / (obs - k))[:, None] * np.sqrt(np.cumsum(psi * psi, axis=1))
                better = (aicc < best) & np.isfinite(path).all(axis=1)
                best = np.where(better, aicc, best)
                out, deviation = np.where(better[:, None], path, out), np.where(better[:, None], spread, deviation)
    return out, deviation


FITTERS: dict[str, Fitter] = {
    "Holt": holt,
    "HoltDamped": holt_damped,
    "AutoETS": auto_ets,
    "ETS_Damped": ets_damped,
    "AutoTheta": auto_theta,
    "AutoAR": auto_ar,
}


def _lists(values: np.ndarray) -> list:
    return [list(map(float, row)) if np.isfinite(row).all() else None for row in values]


def _both(answer: Answer) -> tuple[list, list]:
    """Values and deviations as lists; a fitter without deviations has none."""
    if isinstance(answer, tuple):
        return _lists(answer[0]), _lists(answer[1])
    return _lists(answer), [None] * len(answer)


def deviation_of(name: str) -> str:
    return f"{name} deviation"


def _fit_batch(ys: pd.Series, h: pd.Series, chosen: dict[str, Fitter], season: int, least: int) -> pd.DataFrame:
    out = {c: np.full(len(ys), None, dtype=object) for name in chosen for c in (name, deviation_of(name))}
    lengths, horizons = ys.map(len).to_numpy(), h.to_numpy()
    for n, steps in {(a, b) for a, b in zip(lengths, horizons) if a >= least}:
        rows = np.flatnonzero((lengths == n) & (horizons == steps))
        for part in np.array_split(rows, -(-len(rows) // CHUNK)):
            stacked = np.vstack([np.asarray(ys.iloc[i], dtype=float) for i in part])
            for name, fit in chosen.items():
                with np.errstate(all="ignore"):
                    found = _both(fit(stacked, int(steps), season))
                for c, lists in zip((name, deviation_of(name)), found):
                    for i, row in zip(part, lists):
                        out[c][i] = row
    return pd.DataFrame(out)


def fit_panel(panel: DataFrame, chosen: dict[str, Fitter], season: int, least: int = 1) -> DataFrame:
    """Add ``fits``: per fitter an array of h values, null where it could not answer, and their deviations.

    Any user function ``(values[series, time], h, season) -> values[series, h]`` can be passed, or one that
    returns deviations of the same shape beside the values; it is called for every series of at least ``least``
    values.
    """
    fields = [c for name in chosen for c in (name, deviation_of(name))]
    schema = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in fields])

    def fit(ys: pd.Series, h: pd.Series) -> pd.DataFrame:
        return _fit_batch(ys, h, chosen, season, least)

    return panel.withColumn("fits", F.pandas_udf(fit, schema)("ys", "h"))


def with_fits(panel: DataFrame, names: list[str], season: int) -> DataFrame:
    return fit_panel(panel, {n: FITTERS[n] for n in names}, season, MIN_LENGTH)


def _fit_exogenous_batch(ys: pd.Series, xs: pd.Series, x_next: pd.Series, h: pd.Series, season: int) -> pd.DataFrame:
    """Rows of equal length, regressor count and horizon are stacked, as in ``_fit_batch``."""
    out = {c: np.full(len(ys), None, dtype=object) for c in ("raw", "deviation")}
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, (y, x, f, steps) in enumerate(zip(ys, xs, x_next, h)):
        if x is not None and f is not None and len(y) >= MIN_LENGTH:
            groups.setdefault((len(y), len(x[0]), int(steps)), []).append(i)
    for (_, _, steps), rows in groups.items():
        for part in np.array_split(rows, -(-len(rows) // CHUNK)):
            y = np.vstack([np.asarray(ys.iloc[i], dtype=float) for i in part])
            past = np.stack([np.stack(list(xs.iloc[i])).astype(float) for i in part])
            future = np.stack([np.stack(list(x_next.iloc[i])).astype(float) for i in part])
            with np.errstate(all="ignore"):
                found = _both(auto_ar(y, steps, season, past, future))
            for c, lists in zip(out, found):
                for i, row in zip(part, lists):
                    out[c][i] = row
    return pd.DataFrame(out)


def fit_exogenous(panel: DataFrame, season: int) -> DataFrame:
    """Autoregression with the panel's ``xs`` (history × regressor) and ``x_next`` columns: ``raw`` and ``deviation``."""

    def fit(ys: pd.Series, xs: pd.Series, x_next: pd.Series, h: pd.Series) -> pd.DataFrame:
        return _fit_exogenous_batch(ys, xs, x_next, h, season)

    udf = F.pandas_udf(fit, "raw array<double>, deviation array<double>")
    return panel.withColumn("_fit", udf("ys", "xs", "x_next", "h")).select("*", "_fit.*").drop("_fit")
