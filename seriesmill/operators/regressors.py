"""Exogenous series: validation, scope, availability over the horizon, model matrices.

Values are long rows (regressor_id, ds, value, is_future). Specs are settings, at most a
handful per run, so regressors become columns of one calendar-sized table.
"""

from __future__ import annotations

from datetime import date
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.config import ForecastConfig, RegressorSpec, StudyConfig
from seriesmill.functions.periods import grid_start, shift_date
from seriesmill.operators import fitters, models
from seriesmill.operators.panel import FINAL_FOLD, Fold, train_panel
from seriesmill.operators.scenarios import in_scope

COLLINEAR = 0.999
MIN_PAIRS = 3


def _enabled(specs: tuple[RegressorSpec, ...]) -> list[RegressorSpec]:
    return [s for s in specs if s.enabled]


def by_date(values: DataFrame, specs: tuple[RegressorSpec, ...]) -> DataFrame:
    """One row per date, one column per regressor: as many rows as the calendar has periods.

    Where a date is told twice, history goes before the future, and of equals the smaller value stands.
    """
    told = values if "is_future" in values.columns else values.withColumn("is_future", F.lit(False))
    wide = told.groupBy("ds").pivot("regressor_id", [s.regressor_id for s in _enabled(specs)])
    order = F.when(F.col("value").isNotNull(), F.struct("is_future", "value"))
    return wide.agg(F.min_by("value", order))


def pearson_pairs(values: DataFrame, specs: tuple[RegressorSpec, ...]) -> DataFrame:
    """Correlation of each pair on common dates, in one pass over the calendar table."""
    names = sorted(s.regressor_id for s in _enabled(specs))
    wide = by_date(values.where(~F.col("is_future")), specs)
    pairs = list(combinations(names, 2))

    def both(a: str, b: str) -> Column:
        return F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()

    stats = [
        F.struct(
            F.lit(a).alias("left_id"),
            F.lit(b).alias("right_id"),
            F.count_if(both(a, b)).alias("n_pairs"),
            F.corr(F.when(both(a, b), F.col(f"`{a}`")), F.when(both(a, b), F.col(f"`{b}`"))).alias("r"),
        )
        for a, b in pairs
    ]
    if not stats:
        return wide.sparkSession.createDataFrame([], "left_id string, right_id string, n_pairs long, r double, collinear boolean")
    out = wide.agg(F.array(*stats).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return out.where(F.col("n_pairs") >= MIN_PAIRS).withColumn("collinear", F.abs("r") > COLLINEAR)


def missing_future_periods(values: DataFrame, specs: tuple[RegressorSpec, ...], horizon: list[date]) -> DataFrame:
    """Horizon dates a regressor has no future value for."""
    spark = values.sparkSession
    wanted = spark.createDataFrame(
        [(s.regressor_id, d) for s in _enabled(specs) for d in horizon], "regressor_id string, ds date"
    )
    known = values.where("is_future AND value IS NOT NULL").select("regressor_id", "ds")
    return wanted.join(known, ["regressor_id", "ds"], "left_anti")


def regressor_validate(values: DataFrame, specs: tuple[RegressorSpec, ...], horizon: list[date]) -> DataFrame:
    """Flat history, missing future, unknown without a hold, and collinear pairs as issue rows."""
    spark = values.sparkSession
    live = _enabled(specs)
    settings = spark.createDataFrame(
        [(s.regressor_id, s.known_in_advance, s.fill_policy) for s in live],
        "regressor_id string, known boolean, fill string",
    )
    past = F.when(~F.col("is_future") & (F.col("value") != 0), F.col("value"))
    future = F.col("is_future") & F.col("value").isNotNull() & F.col("ds").isin(*horizon)
    stats = values.groupBy("regressor_id").agg(
        F.min(past).alias("lo"),
        F.max(past).alias("hi"),
        F.count_distinct(F.when(future, F.col("ds"))).alias("n_future"),
        F.count_if(F.col("is_future") & F.col("value").isNotNull()).alias("n_any_future"),
    )
    rows = settings.join(stats, "regressor_id", "left")
    flat = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    gaps = F.col("known") & (F.coalesce("n_future", F.lit(0)) < len(horizon))
    blocking = (F.coalesce("n_any_future", F.lit(0)) == 0) & (F.col("fill") == "none")

    def issue(condition: Column, code: str, severity: Column) -> Column:
        return F.when(condition, F.struct(F.lit(code).alias("code"), severity.alias("severity")))

    found = F.array(
        issue(flat, "E_REGRESSOR_FLAT", F.lit("warning")),
        issue(gaps, "E_REGRESSOR_INCOMPLETE_FUTURE", F.when(blocking, "error").otherwise("warning")),
        issue(~F.col("known") & (F.col("fill") == "none"), "E_REGRESSOR_UNAVAILABLE_AT_CUTOFF", F.lit("error")),
    )
    single = rows.select("regressor_id", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select(
        "i.code", "i.severity", "regressor_id", F.lit(None).cast("string").alias("other_id")
    )
    pairs = pearson_pairs(values, specs).where("collinear").select(
        F.lit("E_REGRESSOR_COLLINEAR").alias("code"),
        F.lit("error").alias("severity"),
        F.col("left_id").alias("regressor_id"),
        F.col("right_id").alias("other_id"),
    )
    return single.unionByName(pairs)


def regressor_scope(entities: DataFrame, specs: tuple[RegressorSpec, ...]) -> DataFrame:
    """(entity, regressor) wherever the regressor's scope covers the entity."""
    hits = [F.when(in_scope(s.scope, F.col("dims")), F.lit(s.regressor_id)) for s in _enabled(specs)]
    found = F.filter(F.array(*hits), lambda r: r.isNotNull())
    return entities.select("entity_id", F.explode(found).alias("regressor_id"))


def regressor_asof(values: DataFrame, last: date) -> DataFrame:
    """Latest known value at or before the date."""
    known = values.where(~F.col("is_future") & F.col("value").isNotNull() & (F.col("ds") <= F.lit(last)))
    newest = F.max(F.struct("ds", "value")).alias("m")
    return known.groupBy("regressor_id").agg(newest).select(
        "regressor_id", F.col("m.ds").alias("hold_ds"), F.col("m.value").alias("hold_value")
    )


def regressor_repeat_last(values: DataFrame, horizon: list[date], last: date) -> DataFrame:
    dates = F.explode(F.array(*[F.lit(d) for d in horizon])).alias("ds")
    return regressor_asof(values, last).select("regressor_id", dates, F.col("hold_value").alias("value"))


def regressor_future(
    values: DataFrame,
    specs: tuple[RegressorSpec, ...],
    horizon: list[date],
    last: date,
    overrides: dict[str, dict[date, float]] | None = None,
) -> DataFrame:
    """Value per (regressor, horizon date): scenario override, known future or held value, else null."""
    spark = values.sparkSession
    wanted = spark.createDataFrame(
        [
            (s.regressor_id, d, s.known_in_advance, s.fill_policy, (overrides or {}).get(s.regressor_id, {}).get(d))
            for s in _enabled(specs)
            for d in horizon
        ],
        "regressor_id string, ds date, known boolean, fill string, override double",
    )
    future = values.where("is_future").select("regressor_id", "ds", F.col("value").alias("future_value"))
    held = regressor_asof(values, last).select("regressor_id", "hold_value")
    usable = F.when(F.col("known"), F.col("future_value")).when(F.col("fill") == "explicit_hold", F.col("hold_value"))
    blocked = ~F.col("known") & (F.col("fill") == "none")
    return (
        wanted.join(future, ["regressor_id", "ds"], "left")
        .join(held, "regressor_id", "left")
        .select("regressor_id", "ds", F.when(~blocked, F.coalesce("override", usable)).alias("value"))
    )


def _as_known(spec: RegressorSpec, place: int):
    """The value of a regressor at a date after a fold's cutoff, as it was known at the cutoff.

    One known in advance has its real value, one that is held its last value up to the cutoff; any
    other is unavailable, as it is in the final fit.
    """
    if spec.known_in_advance:
        return lambda d: F.get(F.try_element_at("_calendar", d), F.lit(place))
    if spec.fill_policy != "explicit_hold":
        return lambda d: F.lit(None).cast("double")
    past = F.filter(
        F.map_entries("_calendar"),
        lambda e: (e["key"] <= F.col("cutoff")) & F.get(e["value"], F.lit(place)).isNotNull(),
    )
    last = F.array_max(F.transform(past, lambda e: F.struct(e["key"], F.get(e["value"], F.lit(place)).alias("v"))))
    return lambda d: last["v"]


def _calendar(values: DataFrame, study: StudyConfig, config: ForecastConfig) -> DataFrame:
    """History inside grid and horizon, and the last value before it."""
    start = F.lit(grid_start(study.history_end, study.history_periods, study.step))
    end = F.lit(shift_date(study.history_end, config.horizon * study.step))
    known = values.where(~F.col("is_future")).select("regressor_id", "ds", "value", "is_future")
    newest = F.max(F.struct("ds", "value")).alias("m")
    before = known.where((F.col("ds") < start) & F.col("value").isNotNull()).groupBy("regressor_id").agg(newest)
    held = before.select("regressor_id", "m.ds", "m.value", F.lit(False).alias("is_future"))
    return known.where(F.col("ds").between(start, end)).unionByName(held)


def exogenous_panel(
    series: DataFrame,
    entities: DataFrame,
    values: DataFrame,
    future: DataFrame,
    specs: tuple[RegressorSpec, ...],
    study: StudyConfig,
    config: ForecastConfig,
    folds: list[Fold],
) -> DataFrame:
    """The training panel with ``xs`` and ``x_next``: one row of values per date, scoped regressors only.

    The regressor calendar is one map with the dates of grid and horizon, and of each regressor the last date
    before them, which a hold may need. It reaches the panel as one aggregated row keyed by a constant, broadcast
    because the settings bound its size.
    """
    live = _enabled(specs)
    rows = by_date(_calendar(values, study, config).unionByName(future.select("regressor_id", "ds", "value", F.lit(True).alias("is_future"))), specs)
    row = F.struct(F.col("ds").alias("key"), F.array(*[F.col(f"`{s.regressor_id}`") for s in live]).alias("value"))
    calendar = rows.groupBy(F.lit(1).alias("_one")).agg(F.map_from_entries(F.collect_list(row)).alias("_calendar"))
    panel = train_panel(series, study, config, folds).withColumn("_one", F.lit(1))
    panel = panel.join(F.broadcast(calendar), "_one", "left").join(
        entities.select("entity_id", "dims"), "entity_id", "left"
    )
    scoped = F.array(*[in_scope(s.scope, F.col("dims")) for s in live])
    live_at_fold = [_as_known(s, i) for i, s in enumerate(live)]

    def scoped_only(values: Column) -> Column:
        return F.filter(values, lambda _, i: F.element_at(scoped, i + 1))

    def matrix(dates: Column) -> Column:
        def at(d: Column) -> Column:
            return scoped_only(F.try_element_at("_calendar", d))

        return F.transform(dates, at)

    return panel.withColumns(
        {
            "n_regressors": F.size(F.filter(scoped, lambda s: s)),
            "xs": matrix(F.col("dss")),
            "x_next": F.when(F.col("fold") == FINAL_FOLD, matrix(F.col("eval_dates"))).otherwise(
                F.transform("eval_dates", lambda d: scoped_only(F.array(*[value(d) for value in live_at_fold])))
            ),
        }
    ).drop("_one", "_calendar", "dims")


def ar_exog(panel: DataFrame, season: int, level: int = 80) -> DataFrame:
    """Autoregression with regressors; unavailable inputs keep their row with the reason."""

    def holes(matrix: str) -> Column:
        return F.exists(matrix, lambda r: r.isNull() | F.exists(r, lambda v: v.isNull()))

    reason = (
        F.when(F.col("n_regressors") == 0, "regressor_unavailable")
        .when(holes("xs"), "regressor_unavailable")
        .when(holes("x_next"), "regressor_future_unavailable")
        .when(F.col("n") < models.MIN_TRAIN["AutoAR_X"], "insufficient_history")
        .otherwise("")
    )
    marked = panel.withColumn("_why", reason)
    usable = F.col("_why") == ""
    ready = marked.withColumns({c: F.when(usable, F.col(c)) for c in ("xs", "x_next")})
    out = fitters.fit_exogenous(ready, season)
    return out.withColumns(
        {
            "model_alias": F.lit("AutoAR_X"),
            "failure_reason": F.when(F.col("_why") != "", F.col("_why"))
            .when(F.col("raw").isNull(), "model_failed")
            .otherwise(""),
            "width": F.when((F.col("fold") == FINAL_FOLD) & models.interval_allowed(), models.widths_of(F.col("deviation"), level)),
            "evaluable": F.lit(None).cast("boolean"),
            "any_evaluable": F.lit(None).cast("boolean"),
        }
    ).drop("_why", "xs", "x_next", "deviation")


def final_rows(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("fold") == FINAL_FOLD)
