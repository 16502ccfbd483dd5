"""Backtest windows and the one-row-per-(series, cutoff) panel that every model reads.

The only shuffle is on ``series_id``; folds, models and steps are exploded inside it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.config import MIN_FINAL_HISTORY, MIN_FIRST_TRAIN, ForecastConfig, StudyConfig
from seriesmill.functions.once import once
from seriesmill.functions.periods import period_sequence, shift_date
from seriesmill.operators.quality import SERIES

FINAL_FOLD = -1


@dataclass(frozen=True)
class Fold:
    number: int
    cutoff: date


def fold_count(n: int, h: int, wanted: int) -> int:
    """Folds of ``h`` periods that ``n`` periods allow, at most ``wanted``.

    Every fold leaves at least MIN_FIRST_TRAIN periods before the first. Calendars too short for
    that many whole folds still give one, if more than three periods stand before it.
    """
    whole = max(0, min(wanted * h, n - MIN_FIRST_TRAIN)) // h
    if whole >= MIN_FIRST_TRAIN or n >= MIN_FIRST_TRAIN * h:
        return whole
    return max(whole, 1) * (n > h + 3)


def folds_possible(n: Column, h: int, wanted: int) -> Column:
    """``fold_count`` of a column, looked up: from the last entry on the count doesn't change."""
    most = max(wanted, MIN_FIRST_TRAIN) * h + MIN_FIRST_TRAIN + 1
    counts = F.array(*[F.lit(fold_count(k, h, wanted)) for k in range(most + 1)])
    return F.get(counts, F.least(n, F.lit(most)).cast("int"))


def cv_windows(values: DataFrame, study: StudyConfig, config: ForecastConfig) -> DataFrame:
    """Expanding windows over the distinct dates (one row per fold)."""
    h = config.resolved_cv_horizon(study)
    calendar = values.select("ds").distinct()
    ordered = Window.orderBy("ds")
    whole = Window.partitionBy()
    ranked = calendar.select(
        "ds",
        F.row_number().over(ordered).alias("rn"),
        F.count("*").over(whole).alias("n"),
        F.min("ds").over(whole).alias("train_start"),
    ).withColumn("k", folds_possible(F.col("n"), h, config.cv_windows))
    back = (F.col("n") - F.col("rn")) / h
    picked = ranked.where(((F.col("n") - F.col("rn")) % h == 0) & back.between(1, F.col("k")))
    return picked.select(
        (F.col("k") - back).cast("int").alias("fold"),
        F.col("ds").alias("cutoff"),
        "train_start",
        F.col("ds").alias("train_end"),
        F.add_months("ds", study.step).alias("test_start"),
        F.add_months("ds", h * study.step).alias("test_end"),
    )


def collect_folds(windows: DataFrame) -> list[Fold]:
    """Folds as settings; at most ``cv_windows`` rows come back."""
    return [Fold(r["fold"], r["cutoff"]) for r in windows.select("fold", "cutoff").orderBy("fold").collect()]


def calendar_folds(study: StudyConfig, config: ForecastConfig) -> list[Fold]:
    """The same folds from the study grid alone, for series filled up to its end: no data pass."""
    h = config.resolved_cv_horizon(study)
    k = fold_count(study.history_periods, h, config.cv_windows)
    return [Fold(j, shift_date(study.history_end, -(k - j) * h * study.step)) for j in range(k)]


def series_arrays(values: DataFrame, folds: list[Fold] = (), reach: int = 0) -> DataFrame:
    """One row per series: its ordered points (bounded by the grid), counts for eligibility, and
    per fold the training and test sizes (``reach`` months of test), all in one aggregate."""
    y, ds = F.col("y"), F.col("ds")
    sizes = []
    for f in folds:
        past = ds <= F.lit(f.cutoff)
        sizes.append(F.count_if(past).alias(f"train_{f.number}"))
        sizes.append(F.count_if(~past & (ds <= F.lit(shift_date(f.cutoff, reach)))).alias(f"test_{f.number}"))
    return values.groupBy(*SERIES).agg(
        F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("points"),
        F.count("*").alias("n_total"),
        F.count_if(y > 0).alias("n_positive"),
        F.count_if(y < 0).alias("n_negative"),
        F.count_if(y == 0).alias("n_zero"),
        *sizes,
    )


def train_panel(
    values: DataFrame, study: StudyConfig, config: ForecastConfig, folds: list[Fold], final: bool = True
) -> DataFrame:
    """Training values, evaluation dates and actuals per (series, fold).

    ``final`` adds the pseudo-fold that trains on everything; its dates lie in the future.
    ``cv_n`` is the longest training part of a fold that can be evaluated. Points are ordered,
    so a fold is a slice of known length.
    """
    step, h_cv = study.step, config.resolved_cv_horizon(study)
    arrays = series_arrays(values, folds, h_cv * step)
    last = F.element_at(F.col("points"), -1)["ds"]
    usable = [
        F.when((F.col(f"test_{f.number}") > 0) & (F.col(f"train_{f.number}") >= MIN_FINAL_HISTORY), F.col(f"train_{f.number}"))
        for f in folds
    ]
    entries = [
        F.struct(
            F.lit(f.number).alias("fold"),
            F.lit(f.cutoff).alias("cutoff"),
            F.lit(h_cv).alias("h"),
            F.col(f"train_{f.number}").alias("n"),
        )
        for f in folds
    ]
    if final:
        entries.append(
            F.struct(
                F.lit(FINAL_FOLD).alias("fold"), last.alias("cutoff"), F.lit(config.horizon).alias("h"), F.col("n_total").alias("n")
            )
        )
    counts = ["n_total", "n_positive", "n_negative", "n_zero"]
    rows = (
        arrays.withColumn("cv_n", F.coalesce(F.greatest(F.lit(0).cast("long"), *usable, F.lit(0).cast("long")), F.lit(0)))
        .select(*SERIES, *counts, "cv_n", "points", F.explode(F.array(*entries)).alias("w"))
        .select(*SERIES, *counts, "cv_n", "points", "w.*")
        .where((F.col("n") >= MIN_FINAL_HISTORY) | (F.col("fold") == FINAL_FOLD))
    )
    n = F.col("n").cast("int")
    rows = once(
        rows,
        {
            "train": F.slice("points", F.lit(1), n),
            "rest": F.slice("points", n + 1, F.size("points")),
            "eval_dates": period_sequence(
                F.add_months("cutoff", step), F.add_months("cutoff", F.col("h") * step), step
            ),
        },
    )
    actual = F.transform(
        "eval_dates", lambda d: F.get(F.filter("rest", lambda p: p["ds"] == d), F.lit(0))["y"]
    )
    return rows.select(
        *SERIES,
        *counts,
        "cv_n",
        "fold",
        "cutoff",
        "h",
        "eval_dates",
        F.when(F.col("fold") == FINAL_FOLD, F.array().cast("array<double>")).otherwise(actual).alias("actuals"),
        F.col("train.ds").alias("dss"),
        F.col("train.y").alias("ys"),
        "n",
    )
