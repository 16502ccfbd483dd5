"""Methods that are plain array expressions, their limits and eligibility."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.config import (
    INTERMITTENT_MODELS,
    INTERVAL_MARGIN,
    MIN_FINAL_HISTORY,
    MIN_INTERMITTENT_POSITIVES,
    MODEL_ORDER,
    MODEL_RANK,
    ForecastConfig,
    StudyConfig,
)

# Smoothing weights of the intermittent methods and shortest usable training parts.
CROSTON_ALPHA = 0.1
TSB_ALPHA_DEMAND = 0.2
TSB_ALPHA_PROBABILITY = 0.2
MIN_TRAIN = {
    "Naive": 1,
    "MediaMovel3": 3,
    "MediaMovel6": 6,
    "MediaMovel12": 12,
    "HistoricAverage": 1,
    "RegLinearDrift": 2,
    "Holt": 8,
    "HoltDamped": 8,
    "AutoETS": 8,
    "ETS_Damped": 8,
    "AutoAR": 8,
    "AutoAR_X": 8,
    "AutoTheta": 8,
    "CrostonSBA": 1,
    "TSB": 1,
    "ZeroBaseline": 1,
}
# End of fixed values.

NATIVE = (
    "ZeroBaseline",
    "Naive",
    "MediaMovel3",
    "MediaMovel6",
    "MediaMovel12",
    "HistoricAverage",
    "SeasonalNaive",
    "RegLinearDrift",
    "CrostonSBA",
    "TSB",
)
#: Methods whose own errors give their limits; of the others backtest errors do.
WITH_LIMITS = ("Naive", "HistoricAverage", "SeasonalNaive", "RegLinearDrift", "Holt", "HoltDamped", "AutoETS", "ETS_Damped", "AutoAR", "AutoTheta")
FITTED = ("Holt", "HoltDamped", "AutoETS", "ETS_Damped", "AutoAR", "AutoTheta")


@dataclass(frozen=True)
class ModelSpec:
    alias: str
    rank: int
    min_train: int
    intermittent: bool
    native: bool
    interval: bool


def candidate_registry(study: StudyConfig, config: ForecastConfig, fitted: bool = True) -> list[ModelSpec]:
    """Methods that compete: by frequency and the user's list, in rank order."""
    names = [m for m in MODEL_ORDER if m in NATIVE or (fitted and m in FITTED)]
    if study.model_frequency not in ("monthly", "quarterly"):
        names.remove("SeasonalNaive")
    if config.models:
        names = [m for m in names if m in config.models or m == "ZeroBaseline"]
    return [
        ModelSpec(
            alias=m,
            rank=MODEL_RANK[m],
            min_train=(config.season_length or study.season) if m == "SeasonalNaive" else MIN_TRAIN[m],
            intermittent=m in INTERMITTENT_MODELS,
            native=m in NATIVE,
            interval=m in WITH_LIMITS,
        )
        for m in names
    ]


def eligible(spec: ModelSpec) -> Column:
    """All-zero series keep only the zero baseline; intermittent methods need positives only."""
    all_zero = F.col("n_zero") == F.col("n_total")
    if spec.alias == "ZeroBaseline":
        return all_zero
    ok = ~all_zero
    if spec.intermittent:
        ok = ok & (F.col("n_negative") == 0) & (F.col("n_positive") >= MIN_INTERMITTENT_POSITIVES)
    return ok


def enough_history() -> Column:
    return F.col("n_total") >= MIN_FINAL_HISTORY


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def _mean(xs: Column) -> Column:
    return _total(xs) / F.size(xs)


def _steps(h: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), h), fn)


def croston_sba(ys: Column) -> Column:
    """Smoothed size over smoothed interval, with the bias correction."""
    a = CROSTON_ALPHA
    start = F.struct(
        F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("q"), F.lit(1.0).alias("gap")
    )

    def move(s, y):
        z = F.coalesce(s["z"] * (1 - a) + y * a, y)
        q = F.coalesce(s["q"] * (1 - a) + s["gap"] * a, s["gap"])
        return F.when(y > 0, F.struct(z.alias("z"), q.alias("q"), F.lit(1.0).alias("gap"))).otherwise(
            F.struct(s["z"].alias("z"), s["q"].alias("q"), (s["gap"] + 1.0).alias("gap"))
        )

    return F.aggregate(ys, start, move, lambda s: F.coalesce(s["z"] / s["q"] * (1 - a / 2), F.lit(0.0)))


def tsb(ys: Column) -> Column:
    """Smoothed demand probability times smoothed demand size."""
    ad, ap = TSB_ALPHA_DEMAND, TSB_ALPHA_PROBABILITY
    start = F.struct(F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("z"))

    def move(s, y):
        d = F.when(y > 0, 1.0).otherwise(0.0)
        p = F.coalesce(s["p"] * (1 - ap) + d * ap, d)
        z = F.when(y > 0, F.coalesce(s["z"] * (1 - ad) + y * ad, y)).otherwise(s["z"])
        return F.struct(p.alias("p"), z.alias("z"))

    return F.aggregate(ys, start, move, lambda s: F.coalesce(s["p"] * s["z"], F.lit(0.0)))


def point_forecast(alias: str, season: int) -> Column:
    """``ys, n, h`` of the panel row to an array of h values."""
    ys, n, h = F.col("ys"), F.col("n"), F.col("h")
    last = F.element_at(ys, -1)
    if alias == "ZeroBaseline":
        return F.array_repeat(F.lit(0.0), h)
    if alias == "Naive":
        return F.array_repeat(last, h)
    if alias.startswith("MediaMovel"):
        width = int(alias.removeprefix("MediaMovel"))
        return F.array_repeat(_mean(F.slice(ys, -width, width)), h)
    if alias == "HistoricAverage":
        return F.array_repeat(_mean(ys), h)
    if alias == "SeasonalNaive":
        return _steps(h, lambda k: F.try_element_at(ys, (-season + F.pmod(k - 1, F.lit(season))).cast("int")))
    if alias == "RegLinearDrift":
        slope = (last - F.element_at(ys, 1)) / (n - 1)
        return _steps(h, lambda k: last + k * slope)
    if alias == "CrostonSBA":
        return F.array_repeat(croston_sba(ys), h)
    if alias == "TSB":
        return F.array_repeat(tsb(ys), h)
    raise KeyError(alias)


def z_of(level: int) -> float:
    return NormalDist().inv_cdf(0.5 + level / 200)


def widths_of(deviations: Column, level: int) -> Column:
    """z(level) × the deviations that a fitter gives."""
    return F.transform(deviations, lambda d: d * z_of(level))


def half_widths(alias: str, season: int, level: int) -> Column:
    """z(level) × σ of the in-sample residuals × growth with the step."""
    z = z_of(level)
    ys, n, h = F.col("ys"), F.col("n"), F.col("h")

    def sigma(residuals: Column, divisor: Column) -> Column:
        return F.sqrt(F.try_divide(_total(F.transform(residuals, lambda e: e * e)), divisor))

    def lagged(k: int, shift: Column) -> Column:
        tail = F.slice(ys, F.lit(k + 1), F.greatest(n - k, F.lit(0)).cast("int"))
        return F.transform(tail, lambda y, i: y - F.get(ys, i) - shift)

    if alias == "Naive":
        s = sigma(lagged(1, F.lit(0.0)), n - 1)
        return _steps(h, lambda k: z * s * F.sqrt(k))
    if alias == "HistoricAverage":
        m = _mean(ys)
        s = sigma(F.transform(ys, lambda y: y - m), n - 1)
        return F.array_repeat(z * s * F.sqrt(1 + 1 / n), h)
    if alias == "SeasonalNaive":
        s = sigma(lagged(season, F.lit(0.0)), n - season)
        return _steps(h, lambda k: z * s * F.sqrt(F.floor((k - 1) / season) + 1))
    if alias == "RegLinearDrift":
        slope = (F.element_at(ys, -1) - F.element_at(ys, 1)) / (n - 1)
        s = sigma(lagged(1, slope), n - 2)
        return _steps(h, lambda k: z * s * F.sqrt(k * (1 + k / (n - 1))))
    raise KeyError(alias)


def interval_allowed() -> Column:
    return F.col("n") >= 2 * F.col("h") + INTERVAL_MARGIN


def floor_zero(value: Column) -> Column:
    """Mandatory zero floor; null, NaN and infinities are left for the caller to see."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, value).otherwise(F.greatest(value, F.lit(0.0)))
