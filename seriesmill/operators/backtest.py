"""Panel → forecasts → backtest rows, scores, selection, final predictions.

All steps after the panel keep its ``series_id`` partitioning: models and steps are exploded in
place and the per-series decisions are windows over the same key, so no step shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.config import (
    CORE_MODELS,
    FAST_ZERO_SHARE,
    INTERMITTENT_MODELS,
    MODEL_RANK,
    ForecastConfig,
    StudyConfig,
)
from seriesmill.operators import fitters, models
from seriesmill.operators.panel import FINAL_FOLD
from seriesmill.operators.quality import SERIES

NODE = ["node_id", "measure"]
NO_LIMITS = "array<double>"


def rank_of(alias: Column) -> Column:
    flat = [F.lit(x) for pair in MODEL_RANK.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*flat), alias), F.lit(100))


def forecast_frame(
    panel: DataFrame,
    study: StudyConfig,
    config: ForecastConfig,
    fitted: bool = True,
    limits: bool = True,
    specs: list[models.ModelSpec] | None = None,
) -> DataFrame:
    """One row per (series, fold, eligible method) with its h values and optional limits.

    ``specs`` are the methods; without them they come from the settings.

    A method that cannot be computed keeps its row with a null ``yhat`` and a reason, so a
    failure never turns silently into another method.
    """
    specs = models.candidate_registry(study, config, fitted) if specs is None else specs
    season = config.season_length or study.season
    fitted_names = [s.alias for s in specs if not s.native]
    source = panel
    if fitted_names:
        source = fitters.with_fits(panel, fitted_names, season)
    none = F.lit(None).cast(NO_LIMITS)
    entries, any_scored = [], F.lit(False)
    for spec in specs:
        usable = F.col("n") >= spec.min_train
        scored = F.col("cv_n") >= spec.min_train
        any_scored = any_scored | (models.eligible(spec) & scored)
        point = models.point_forecast(spec.alias, season) if spec.native else F.col(f"fits.{spec.alias}")
        width = none
        if spec.interval and limits and spec.native:
            width = models.half_widths(spec.alias, season, config.interval_level)
        elif spec.interval and limits:
            width = models.widths_of(F.col(f"fits.`{fitters.deviation_of(spec.alias)}`"), config.interval_level)
        wanted = (F.col("fold") == FINAL_FOLD) & models.interval_allowed() & usable
        entries.append(
            F.when(
                models.eligible(spec) & models.enough_history(),
                F.struct(
                    F.lit(spec.alias).alias("model_alias"),
                    F.when(usable, point).alias("raw"),
                    F.when(wanted, width).alias("width"),
                    F.when(usable, "").otherwise("insufficient_history").alias("failure_reason"),
                    (scored if spec.native else F.lit(None).cast("boolean")).alias("evaluable"),
                ),
            )
        )
    short = F.when(
        ~models.enough_history(),
        F.struct(
            F.lit("Naive").alias("model_alias"),
            none.alias("raw"),
            none.alias("width"),
            F.lit("insufficient_history").alias("failure_reason"),
            F.lit(False).alias("evaluable"),
        ),
    )
    kept = F.filter(F.array(*entries, short), lambda m: m.isNotNull())
    meta = ["fold", "cutoff", "h", "n", "n_total", "n_positive", "n_negative", "n_zero", "eval_dates", "actuals"]
    out = source.select(*SERIES, *meta, any_scored.alias("any_evaluable"), F.explode(kept).alias("m"))
    out = out.select(*SERIES, *meta, "any_evaluable", "m.*")
    return out.withColumn("failure_reason", F.when(
        (F.col("failure_reason") == "") & F.col("raw").isNull(), "model_failed"
    ).otherwise(F.col("failure_reason")))


def cv_predictions(frame: DataFrame) -> DataFrame:
    """Backtest rows: one per (node, measure, method, fold, date)."""
    cells = F.transform(
        "eval_dates",
        lambda d, i: F.struct(
            d.alias("ds"), F.get("actuals", i).alias("y_actual"), models.floor_zero(F.get("raw", i)).alias("yhat")
        ),
    )
    rows = frame.where(F.col("fold") != FINAL_FOLD).select(
        F.col("series_id").alias("node_id"),
        "measure",
        "entity_id",
        "model_alias",
        "fold",
        "cutoff",
        "failure_reason",
        (F.col("n_zero") == F.col("n_total")).alias("all_zero"),
        _mostly_zero().alias("mostly_zero"),
        F.explode(cells).alias("c"),
    )
    seen = F.col("c.y_actual").isNotNull()
    return rows.select(
        *NODE,
        "entity_id",
        "model_alias",
        "fold",
        "cutoff",
        "c.ds",
        "c.y_actual",
        "c.yhat",
        (seen & F.col("c.yhat").isNotNull()).alias("evaluated"),
        F.when(F.col("failure_reason") != "", F.col("failure_reason"))
        .when(~seen, "no_observed_test")
        .otherwise("")
        .alias("failure_reason"),
        "all_zero",
        "mostly_zero",
    )


def _mostly_zero() -> Column:
    share = (F.col("n_total") - F.col("n_positive")) / F.col("n_total")
    return (F.col("n_zero") < F.col("n_total")) & (F.col("n_negative") == 0) & (share >= FAST_ZERO_SHARE)


def error_metrics(prefix_keys: list[str], rows: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """MAE, RMSE, WAPE, bias and n_eval over the evaluated rows of each key."""
    ok = F.col("evaluated") & F.col("y_actual").isNotNull() & F.col("yhat").isNotNull()
    e = F.when(ok, F.col("yhat") - F.col("y_actual"))
    actual = F.when(ok, F.abs("y_actual"))
    return rows.groupBy(*prefix_keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.sum(actual) > 0, F.try_divide(F.sum(F.abs(e)), F.sum(actual))).alias("wape"),
        F.avg(e).alias("bias"),
        F.count(e).alias("n_eval"),
        *extra,
    )


def score_models(cv: DataFrame) -> DataFrame:
    """Scores per (node, measure, method); methods without evaluable folds keep an ineligible row.

    Distinct folds are collected per method (as many as the settings ask for), so one aggregate
    pass is enough.
    """
    scores = error_metrics(
        [*NODE, "model_alias"],
        cv,
        [
            F.size(F.collect_set(F.when(F.col("evaluated"), F.col("fold")))).cast("long").alias("n_folds"),
            F.first("all_zero").alias("all_zero"),
            F.first("mostly_zero").alias("mostly_zero"),
        ],
    )
    has = F.col("n_eval") > 0
    return scores.withColumns(
        {"eligible": has, "failure_reason": F.when(has, "").otherwise("no_evaluable_folds")}
    )


def select_model(scores: DataFrame, config: ForecastConfig) -> DataFrame:
    """Winner and alternatives among the core methods, or every method of the user's list.

    Errors are compared at nine digits, so equal methods tie whatever order their sums ran in.
    """
    if config.models:
        return scores.withColumns({"selected": F.col("eligible"), "selection_reason": F.lit("usuario")})
    intermittent = F.col("mostly_zero") & F.col("model_alias").isin(*INTERMITTENT_MODELS)
    core = F.col("eligible") & (
        F.col("model_alias").isin(*CORE_MODELS) | (F.col("all_zero") & (F.col("model_alias") == "ZeroBaseline"))
    )
    order = Window.partitionBy(*NODE).orderBy(
        F.when(core, 0).otherwise(1),
        F.coalesce(F.round("wape", 9), F.lit(float("inf"))),
        F.when(intermittent, 0).otherwise(1),
        F.coalesce(F.round("mae", 9), F.lit(float("inf"))),
        rank_of(F.col("model_alias")),
    )
    place = F.row_number().over(order)
    ranked = scores.withColumn("_place", F.when(core, place))
    return ranked.withColumns(
        {
            "selected": F.coalesce(F.col("_place") == 1, F.lit(False)),
            "selection_reason": F.when(
                F.col("_place") == 1,
                F.when(F.col("all_zero"), "perfil_zero_total")
                .when(intermittent, "perfil_intermitente")
                .otherwise("auto_wape_1fold"),
            )
            .when(F.col("_place") > 1, F.concat(F.lit("alternativa_rank_"), (F.col("_place") - 1).cast("string")))
            .when(F.col("eligible"), "nao_avaliado_no_core")
            .otherwise("usuario"),
        }
    ).drop("_place")


def final_forecast(frame: DataFrame, native_only: bool = False) -> DataFrame:
    """Future values of every method that had an evaluable fold; with none, Naive as fallback.

    Array methods are evaluable by their training length alone (``native_only`` frames), so
    nothing is sorted. A fit can also fail, so otherwise the backtest rows of the same partition
    decide.
    """
    if native_only:
        rows = frame.withColumns({"_m": F.col("evaluable").cast("int"), "_any": F.col("any_evaluable").cast("int")})
    else:
        scored = (F.col("fold") != FINAL_FOLD) & F.col("raw").isNotNull() & F.exists("actuals", lambda a: a.isNotNull())
        by_model = Window.partitionBy("series_id", "measure", "model_alias")
        by_series = Window.partitionBy("series_id", "measure")
        rows = frame.withColumns(
            {"_m": F.max(scored.cast("int")).over(by_model), "_any": F.max(scored.cast("int")).over(by_series)}
        )
    fallback = (F.col("_any") == 0) & (F.col("model_alias") == "Naive")
    rows = rows.where((F.col("fold") == FINAL_FOLD) & F.col("raw").isNotNull() & ((F.col("_m") == 1) | fallback))
    cells = F.transform(
        "eval_dates",
        lambda d, i: F.struct(d.alias("ds"), F.get("raw", i).alias("raw"), F.get("width", i).alias("width")),
    )
    out = rows.select(
        F.col("series_id").alias("node_id"),
        "entity_id",
        F.lit("folha").alias("level"),
        "measure",
        F.lit("base").alias("scenario_id"),
        "model_alias",
        F.when(F.col("_any") == 0, "fallback").otherwise("ok").alias("status"),
        F.when(F.col("width").isNotNull(), "native")
        .when(~models.interval_allowed(), "unavailable_insufficient_history")
        .otherwise("null")
        .alias("interval_method"),
        F.explode(cells).alias("c"),
    )
    raw, width = F.col("c.raw"), F.col("c.width")
    return out.where(~F.isnan(raw)).select(
        "node_id",
        "entity_id",
        "level",
        "measure",
        "scenario_id",
        "c.ds",
        models.floor_zero(raw).alias("yhat"),
        models.floor_zero(raw - width).alias("lo80"),
        models.floor_zero(raw + width).alias("hi80"),
        "model_alias",
        "interval_method",
        "status",
        (raw < 0).alias("clipped"),
    )


def conformal_intervals(predictions: DataFrame, cv: DataFrame, level: int, any_history: bool = True) -> DataFrame:
    """Limits for point-only methods from the quantile of absolute backtest errors per step.

    With ``any_history`` off, rows marked as too short for limits stay without.
    """
    order = Window.partitionBy("node_id", "measure", "model_alias", "cutoff").orderBy("ds")
    steps = cv.where("evaluated").withColumn("step", F.row_number().over(order))
    spread = steps.groupBy("node_id", "measure", "model_alias", "step").agg(
        F.percentile(F.abs(F.col("yhat") - F.col("y_actual")), F.lit(level / 100)).alias("_r")
    )
    ahead = Window.partitionBy("node_id", "measure", "scenario_id", "model_alias").orderBy("ds")
    rows = predictions.withColumn("step", F.row_number().over(ahead))
    longest = Window.partitionBy("node_id", "measure", "model_alias")
    spread = spread.withColumn("_last", F.max("step").over(longest))
    horizon = spread.groupBy("node_id", "measure", "model_alias").agg(
        F.map_from_entries(F.collect_list(F.struct("step", "_r"))).alias("_by_step"), F.max("_last").alias("_last")
    )
    joined = rows.join(horizon, ["node_id", "measure", "model_alias"], "left")
    radius = F.try_element_at("_by_step", F.least("step", "_last"))
    open_ = F.col("lo80").isNull() & radius.isNotNull()
    if not any_history:
        open_ = open_ & (F.col("interval_method") != "unavailable_insufficient_history")
    return joined.withColumns(
        {
            "lo80": F.when(open_, F.greatest(F.col("yhat") - radius, F.lit(0.0))).otherwise(F.col("lo80")),
            "hi80": F.when(open_, F.col("yhat") + radius).otherwise(F.col("hi80")),
            "interval_method": F.when(open_, "conformal").otherwise(F.col("interval_method")),
        }
    ).drop("step", "_by_step", "_last")


def fallback_chain(frame: DataFrame, wanted: str) -> DataFrame:
    """Per series: the wanted method, else the next computable one by rank, else Naive."""
    rank = rank_of(F.col("model_alias"))
    first = F.when(F.col("model_alias") == wanted, 0).when(F.col("model_alias") == "Naive", 2).otherwise(1)
    order = Window.partitionBy("series_id", "measure").orderBy(first, rank)
    rows = frame.where((F.col("fold") == FINAL_FOLD) & F.col("raw").isNotNull())
    return (
        rows.withColumn("_place", F.row_number().over(order))
        .where("_place = 1")
        .select(
            F.col("series_id").alias("node_id"),
            "measure",
            "model_alias",
            (F.col("model_alias") != wanted).alias("fallback_used"),
            F.transform("raw", models.floor_zero).alias("yhat"),
        )
    )


def candidate_on_demand(frame: DataFrame, node: Column, alias: str) -> DataFrame:
    """One method for chosen leaves, without fallback: its values, or the reason there are none."""
    rows = frame.where((F.col("fold") == FINAL_FOLD) & (F.col("model_alias") == alias) & node)
    return rows.select(
        F.col("series_id").alias("node_id"),
        "measure",
        "model_alias",
        F.when(F.col("raw").isNull(), F.col("failure_reason")).otherwise("ok").alias("status"),
        F.transform("raw", models.floor_zero).alias("yhat"),
    )


def run_summary(values: DataFrame, predictions: DataFrame) -> DataFrame:
    """Prediction count, series without any prediction and the run status."""
    wanted = values.select(F.col("series_id").alias("node_id")).distinct()
    per_node = predictions.groupBy("node_id").agg(F.count("*").alias("n"))
    joined = wanted.join(per_node, "node_id", "left")
    out = joined.agg(
        F.count("*").alias("n_series"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_predictions"),
        F.count_if(F.col("n").isNull()).alias("n_failed"),
    )
    return out.withColumn(
        "status",
        F.when(F.col("n_predictions") == 0, "failed").when(F.col("n_failed") > 0, "partial").otherwise("completed"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    return (
        scores.where("eligible")
        .groupBy("measure", "model_alias")
        .agg(
            F.avg("mae").alias("mae_mean"),
            F.avg("rmse").alias("rmse_mean"),
            F.avg("wape").alias("wape_mean"),
            F.avg("bias").alias("bias_mean"),
            F.count_distinct("node_id").alias("n_series"),
        )
    )


def top_alternatives(scores: DataFrame, count: int = 3) -> DataFrame:
    """Methods with the lowest mean WAPE per measure."""
    means = leaderboard(scores).select("measure", "model_alias", "wape_mean", "n_series")
    order = Window.partitionBy("measure").orderBy(F.round("wape_mean", 9).asc_nulls_last(), rank_of(F.col("model_alias")))
    return means.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def best_model_per_node(selected: DataFrame) -> DataFrame:
    order = Window.partitionBy(*NODE).orderBy(
        F.round("wape", 9).asc_nulls_last(), F.round("mae", 9).asc_nulls_last(), rank_of(F.col("model_alias"))
    )
    return selected.where("selected").withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose (node, measure, method) is among the pairs.

    They meet by node alone: rows that lie by series already stay where they are, and none is sorted.
    """
    pair = F.struct("measure", "model_alias")
    named = pairs.where(F.col("measure").isNotNull() & F.col("model_alias").isNotNull())
    kept = named.groupBy("node_id").agg(F.collect_set(pair).alias("_kept"))
    found = rows.join(kept.hint("shuffle_hash"), "node_id").where(F.array_contains("_kept", pair))
    return found.select(*rows.columns)


def backtest_by_model(cv: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pooled metrics per method over the (node, method) pairs that have predictions."""
    keys = ["node_id", "measure", "model_alias"]
    rows = of_pairs(cv.where("evaluated"), predictions.select(*keys).distinct())
    per_cut = rows.groupBy(*keys, "cutoff").agg(F.count("*").alias("_n"))
    shape = (
        per_cut.groupBy(*keys)
        .agg(F.count("*").alias("_folds"), F.max("_n").alias("_h"))
        .groupBy("measure", "model_alias")
        .agg(F.sum("_folds").alias("n_folds"), F.max("_h").alias("cv_horizon"))
    )
    return error_metrics(["measure", "model_alias"], rows).join(shape, ["measure", "model_alias"])


def selected_backtest(cv: DataFrame, selected: DataFrame) -> DataFrame:
    """Pooled WAPE and bias of each node's selected method."""
    picked = best_model_per_node(selected).select("node_id", "measure", "model_alias")
    rows = of_pairs(cv.where("evaluated"), picked)
    return error_metrics(["measure"], rows)
