"""Result views over stored tables: filters, histories, cards, KPIs, curves, exceptions."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.operators import backtest as FC
from seriesmill.operators import hierarchy as H
from seriesmill.operators import mat as M
from seriesmill.operators.models import floor_zero
from seriesmill.operators.panel import FINAL_FOLD
from seriesmill.session import written

# Reason texts and limits of the exceptions ranking.
HIGH_ERROR = 0.30
MANY_ZEROS = 0.60
REASON_ERROR = "erro alto no backtest (WAPE %s%%)"
REASON_ZEROS = "muitos zeros no histórico"
REASON_OTHER = "maior impacto (volume × erro) da rodada"
# End of fixed values.


@dataclass(frozen=True)
class ResultFilter:
    scenario_id: str = "base"
    measure: str | None = None
    level: str | None = None
    node_ids: tuple[str, ...] = ()
    model_alias: str | None = None
    start: date | None = None
    end: date | None = None
    node_contains: str | None = None
    dimensions: dict[str, tuple[str, ...]] = field(default_factory=dict)


def filter_by_dimensions(entities: DataFrame, bridge: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Nodes that cover at least one entity in scope: AND across dimensions, OR inside, any case."""
    rows = entities
    for name, allowed in wanted.items():
        rows = rows.where(F.lower(name).isin(*[a.lower() for a in allowed]))
    return bridge.join(rows.select("entity_id"), "entity_id", "left_semi").select("node_id").distinct()


def query_predictions(
    predictions: DataFrame, flt: ResultFilter, entities: DataFrame | None = None, bridge: DataFrame | None = None
) -> DataFrame:
    """Conjunctive filter; plain comparisons, so they reach the scan of a stored table."""
    out = predictions.where(F.col("scenario_id") == flt.scenario_id)
    for column, value in (("measure", flt.measure), ("level", flt.level), ("model_alias", flt.model_alias)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if flt.node_ids:
        out = out.where(F.col("node_id").isin(*flt.node_ids))
    if flt.start is not None:
        out = out.where(F.col("ds") >= F.lit(flt.start))
    if flt.end is not None:
        out = out.where(F.col("ds") <= F.lit(flt.end))
    if flt.node_contains:
        out = out.where(F.lower("node_id").contains(flt.node_contains.lower()))
    if flt.dimensions:
        out = out.join(filter_by_dimensions(entities, bridge, flt.dimensions), "node_id", "left_semi")
    return out


def pred_nodes(predictions: DataFrame, nodes: DataFrame) -> DataFrame:
    meta = nodes.select("node_id", F.col("level").alias("node_level"), F.col("entity_id").alias("node_entity"))
    return predictions.join(meta, "node_id", "left")


def node_dims(rows: DataFrame, entities: DataFrame, dimensions: list[str]) -> DataFrame:
    return rows.join(entities.select("entity_id", *dimensions), "entity_id", "left")


def dimension_values(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("dims").alias("dimension", "value")).distinct()


def search_items(entities: DataFrame, dimension: str, text: str) -> DataFrame:
    values = entities.select(F.col(dimension).alias("value")).distinct()
    return values.where(F.lower("value").contains(text.lower()))


def cascade_items(entities: DataFrame, level: str, marked: tuple[str, ...], below: str) -> DataFrame:
    """Values of the next dimension under the marked ones."""
    return entities.where(F.col(level).isin(*marked)).select(F.col(below).alias("value")).distinct()


def node_history(values: DataFrame, above: DataFrame) -> DataFrame:
    """Per (node, measure, date): summed value, everything observed, anything adjusted.

    ``above`` has a row per entity with its nodes as an array (``hierarchy.ancestors``): the values meet a table of
    the entities' size, and rows per node exist only until they are combined in the same task.
    """
    return (
        values.select("entity_id", "measure", "ds", "y", "observed", "was_adjusted")
        .join(above, "entity_id")
        .select(F.explode("ancestors").alias("node_id"), "measure", "ds", "y", "observed", "was_adjusted")
        .groupBy("node_id", "measure", "ds")
        .agg(
            F.sum("y").alias("y"),
            F.bool_and("observed").alias("observed"),
            F.bool_or("was_adjusted").alias("was_adjusted"),
        )
    )


def chosen_history(values: DataFrame, above: DataFrame, asked: DataFrame | tuple[str, ...]) -> DataFrame:
    """``node_history`` of chosen nodes; an id that is no node of the hierarchy is looked up as a series.

    A table of ids has them in ``node_id``, as many as there may be: they meet nodes and series by joins.
    """
    if not isinstance(asked, DataFrame):
        asked = values.sparkSession.createDataFrame([(i,) for i in asked], "node_id string")
    wanted = asked.select("node_id").distinct()
    nodes = above.select("entity_id", F.explode("ancestors").alias("node_id"))
    below = nodes.join(wanted, "node_id", "left_semi").select("entity_id", F.array("node_id").alias("ancestors"))
    rest = wanted.join(nodes.select("node_id").distinct(), "node_id", "left_anti")
    series = values.join(rest.withColumnRenamed("node_id", "series_id"), "series_id", "left_semi")
    own = leaf_history(series).select("node_id", "measure", "ds", "y", "observed", "was_adjusted")
    return node_history(values, below).unionByName(own)


def uncovered_history(values: DataFrame, bridge: DataFrame) -> DataFrame:
    """History per series of the entities that no node of the bridge covers."""
    rest = values.join(bridge.select("entity_id").distinct(), "entity_id", "left_anti")
    return rest.groupBy(F.col("series_id").alias("node_id"), "measure").agg(F.sum("y").alias("y"))


def leaf_history(values: DataFrame) -> DataFrame:
    return values.select(F.col("series_id").alias("node_id"), "measure", "entity_id", "ds", "y", "observed", "was_adjusted")


def view_cards(predictions: DataFrame, history: DataFrame, step: int = 1) -> DataFrame:
    """Totals and the change against the equally long calendar window before the forecast."""
    keys = ["measure", "scenario_id", "model_alias"]
    # A row per node first: it counts the nodes, and their dates are sets of the horizon's size.
    per_node = predictions.groupBy(*keys, "node_id").agg(
        F.count("*").alias("_n"), F.sum("yhat").alias("_sum"), F.array_sort(F.collect_set("ds")).alias("_dates")
    )
    ahead = per_node.groupBy(*keys).agg(
        F.count("*").alias("n_nodes"),
        F.sum("_n").alias("forecast_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_dates")))).alias("_span"),
        F.min(F.get("_dates", F.lit(0))).alias("_first"),
        F.sum("_sum").alias("total_forecast"),
    )
    per_date = history.groupBy("measure", "ds").agg(F.sum("y").alias("y"))
    inside = (F.col("ds") < F.col("_first")) & (F.col("ds") >= F.add_months("_first", -F.col("_span").cast("int") * step))
    joined = ahead.join(per_date, "measure", "left")
    out = joined.groupBy(*keys, "n_nodes", "forecast_rows", "total_forecast").agg(
        F.sum(F.when(inside, F.col("y"))).alias("total_history")
    )
    return out.withColumn(
        "variation", F.try_divide(F.col("total_forecast") - F.col("total_history"), F.col("total_history"))
    )


def equivalent_history_variation(predictions: DataFrame, history: DataFrame, horizon: int) -> DataFrame:
    """Forecast total against the last ``horizon`` history dates (rows, not calendar)."""
    per_date = history.groupBy("measure", "ds").agg(F.sum("y").alias("y"))
    recent = Window.partitionBy("measure").orderBy(F.desc("ds"))
    base = per_date.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= horizon)
    base = base.groupBy("measure").agg(F.sum("y").alias("equivalent_history"))
    total = predictions.groupBy("measure", "model_alias").agg(F.sum("yhat").alias("total_forecast"))
    return total.join(base, "measure", "left").withColumn(
        "variation", F.try_divide(F.col("total_forecast"), F.col("equivalent_history")) - 1
    )


def history_kpis(history: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """Last annual total, yearly change, compound growth, extremes and spread per group.

    ``history`` is (keys, ds, y), one row per date, ``step`` months apart. Annual figures need an
    unbroken calendar and take the periods of a year.
    """
    year = 12 // step
    recent = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    ranked = history.withColumn("_r", F.row_number().over(recent))
    size = Window.partitionBy(*keys)
    ranked = ranked.withColumn("_n", F.count("*").over(size))
    blocks = F.floor(F.col("_n") / year)

    def window_sum(low, high):
        return F.sum(F.when((F.col("_r") > low) & (F.col("_r") <= high), F.col("y")))

    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("hist_months"),
        (F.months_between(F.max("ds"), F.min("ds")) / step + 1 == F.count("*")).alias("_dense"),
        window_sum(F.lit(0), F.lit(year)).alias("_mat"),
        window_sum(F.lit(year), F.lit(2 * year)).alias("_prev"),
        window_sum(year * (blocks - 1), year * blocks).alias("_first"),
        F.max("y").alias("max"),
        F.min(F.struct(-F.col("y"), F.col("ds"))).alias("_max_at"),
        F.min("y").alias("min"),
        F.min(F.struct("y", "ds")).alias("_min_at"),
        F.stddev_samp("y").alias("std"),
    )
    n, years = F.col("hist_months"), F.floor(F.col("hist_months") / year) - 1
    mat = F.when(F.col("_dense") & (n >= year), F.col("_mat"))
    out = out.withColumn("mat", mat)
    grown = F.col("_dense") & (n >= 3 * year) & (F.col("_first") > 0) & (F.col("mat") >= 0)
    return out.select(
        *keys,
        "hist_months",
        "mat",
        F.when(F.col("_dense") & (n >= 2 * year), F.try_divide(F.col("mat") - F.col("_prev"), F.col("_prev"))).alias("yoy"),
        F.when(grown, F.pow(F.col("mat") / F.col("_first"), F.lit(1.0) / years) - 1).alias("cagr"),
        F.when(grown, years).alias("cagr_years"),
        "max",
        F.col("_max_at.ds").alias("max_ds"),
        "min",
        F.col("_min_at.ds").alias("min_ds"),
        "std",
        (F.col("std") / F.sqrt(n)).alias("sem"),
    )


def volume_12m(history: DataFrame) -> DataFrame:
    """Last twelve points per node: total, points, zeros."""
    recent = Window.partitionBy("node_id", "measure").orderBy(F.desc("ds"))
    last = history.withColumn("_r", F.row_number().over(recent)).where("_r <= 12")
    return last.groupBy("node_id", "measure").agg(
        F.sum("y").alias("volume_12m"), F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("n_zeros")
    )


def exceptions_topk(scores: DataFrame, history: DataFrame, top: int) -> DataFrame:
    """Nodes to review, by volume × WAPE of the best selected method; the limit is the report itself."""
    best = FC.best_model_per_node(scores).select("node_id", "measure", "model_alias", "wape")
    joined = best.join(volume_12m(history), ["node_id", "measure"], "left")
    share = F.try_divide(F.col("n_zeros").cast("double"), F.col("n"))
    percent = F.bround(F.col("wape") * 100, 0).cast("int").cast("string")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("wape") >= HIGH_ERROR, F.format_string(REASON_ERROR, percent)),
        F.when(share >= MANY_ZEROS, F.lit(REASON_ZEROS)),
    )
    scored = joined.withColumns(
        {
            "score": F.coalesce("volume_12m", F.lit(0.0)) * F.coalesce("wape", F.lit(0.0)),
            "reason": F.when(reasons == "", REASON_OTHER).otherwise(reasons),
        }
    )
    return scored.orderBy(F.desc("score"), "node_id").limit(top).select(
        "node_id", "measure", "model_alias", "wape", "volume_12m", "score", "reason"
    )


def _items(rows: DataFrame, entities: DataFrame, dimension: str, items: tuple[str, ...] | None) -> DataFrame:
    dims = entities.select("entity_id", F.col(dimension).alias("item"))
    if items is not None:
        dims = dims.where(F.col("item").isin(*items))
    return rows.join(H.looked_up(dims), "entity_id")


def _single(column: str) -> Column:
    return F.when(F.count("*") == 1, F.min(column)).alias(column)


def series_view(
    values: DataFrame,
    predictions: DataFrame,
    cv: DataFrame,
    scores: DataFrame,
    entities: DataFrame,
    dimension: str,
    items: tuple[str, ...] | None = None,
    model: str | None = None,
) -> dict[str, DataFrame]:
    """History, forecast, KPIs and alternatives per dimension value.

    The forecast sums each leaf's best selected method, or one forced method. Limits are given
    only where a single series is behind the point.
    """
    keys = ["item", "measure"]
    history = _items(values, entities, dimension, items).groupBy(*keys, "ds").agg(F.sum("y").alias("y"))
    picked = predictions
    chosen_cv = cv.where("evaluated")
    if model is not None:
        picked, chosen_cv = (d.where(F.col("model_alias") == model) for d in (picked, chosen_cv))
    else:
        best = FC.best_model_per_node(scores).select("node_id", "measure", "model_alias")
        picked, chosen_cv = (FC.of_pairs(d, best) for d in (picked, chosen_cv))
    forecast = _items(picked, entities, dimension, items).groupBy(*keys, "ds").agg(
        F.sum("yhat").alias("yhat"), _single("lo80"), _single("hi80"), F.count("*").alias("n_series")
    )
    errors = FC.error_metrics(keys, _items(chosen_cv, entities, dimension, items)).select(
        *keys, F.col("wape").alias("wape_pooled"), "bias", "n_eval"
    )
    totals = forecast.groupBy(*keys).agg(F.sum("yhat").alias("horizon_total"), F.max("n_series").alias("n_series"))
    kpis = history_kpis(history, keys).join(totals, keys, "left").join(errors, keys, "left")
    means = _items(_with_entity(scores.where("eligible"), values), entities, dimension, items)
    means = means.groupBy(*keys, "model_alias").agg(F.avg("wape").alias("wape_mean"), F.count("*").alias("n_series"))
    place = Window.partitionBy(*keys).orderBy(
        F.round("wape_mean", 9).asc_nulls_last(), FC.rank_of(F.col("model_alias"))
    )
    alternatives = means.withColumn("place", F.row_number().over(place)).where("place <= 3")
    return {"history": history, "forecast": forecast, "kpis": kpis, "alternatives": alternatives}


def _with_entity(scores: DataFrame, values: DataFrame) -> DataFrame:
    owner = values.select(F.col("series_id").alias("node_id"), "entity_id").distinct()
    return scores.join(owner, "node_id")


def series_by_model(
    predictions: DataFrame, cv: DataFrame, entities: DataFrame, dimension: str, items: tuple[str, ...] | None = None
) -> DataFrame:
    """One summed curve per method and dimension value, with its volume-weighted WAPE."""
    keys = ["item", "measure", "model_alias"]
    curves = _items(predictions, entities, dimension, items).groupBy(*keys, "ds").agg(
        F.sum("yhat").alias("yhat"), F.count("*").alias("n_series")
    )
    errors = FC.error_metrics(keys, _items(cv.where("evaluated"), entities, dimension, items))
    return curves.join(errors.select(*keys, F.col("wape").alias("wape_pooled")), keys, "left")


def series_by_model_panel(
    frame: DataFrame, entities: DataFrame, dimension: str, horizon: int, step: int = 1, items: tuple[str, ...] | None = None
) -> DataFrame:
    """``series_by_model`` of a frame of array methods, in one pass over it.

    Final rows add their values position by position, fold rows their errors; both meet in one aggregate per
    dimension value and method, and only its few rows are exploded.
    """
    keys = ["item", "measure", "model_alias"]
    final = F.col("fold") == FINAL_FOLD
    shown = final & F.col("raw").isNotNull() & (F.col("evaluable") | (~F.col("any_evaluable") & (F.col("model_alias") == "Naive")))
    value = [F.when(shown, floor_zero(F.get("raw", F.lit(k)))) for k in range(horizon)]
    pairs = F.transform("actuals", lambda a, i: F.struct(a.alias("a"), floor_zero(F.get("raw", i)).alias("f")))
    known = F.filter(pairs, lambda p: p["a"].isNotNull() & p["f"].isNotNull())

    def total(f) -> Column:
        return F.when(~final, F.aggregate(known, F.lit(0.0), lambda acc, p: acc + f(p)))

    rows = _items(frame, entities, dimension, items).select(
        *keys,
        F.when(shown, F.get("eval_dates", F.lit(0))).alias("start"),
        total(lambda p: F.abs(p["f"] - p["a"])).alias("off"),
        total(lambda p: F.abs(p["a"])).alias("actual"),
        *[F.when(~F.isnan(v), v).alias(f"y{k}") for k, v in enumerate(value)],
    )
    sums = [F.sum(f"y{k}").alias(f"y{k}") for k in range(horizon)]
    counts = [F.count(f"y{k}").alias(f"n{k}") for k in range(horizon)]
    summed = rows.groupBy(*keys, "start").agg(F.sum("off").alias("off"), F.sum("actual").alias("actual"), *sums, *counts)
    whole = Window.partitionBy(*keys)
    wape = F.when(F.sum("actual").over(whole) > 0, F.sum("off").over(whole) / F.sum("actual").over(whole))
    cells = [
        F.struct(F.add_months("start", k * step).alias("ds"), F.col(f"y{k}").alias("yhat"), F.col(f"n{k}").alias("n"))
        for k in range(horizon)
    ]
    curves = summed.withColumn("wape_pooled", wape).where(F.col("start").isNotNull())
    long = curves.select(*keys, "wape_pooled", F.explode(F.array(*cells)).alias("c")).where("c.n > 0")
    return long.groupBy(*keys, "c.ds").agg(
        F.sum("c.yhat").alias("yhat"), F.sum("c.n").alias("n_series"), F.first("wape_pooled").alias("wape_pooled")
    )


def executive_table(
    predictions: DataFrame, entities: DataFrame, dimension: str, model: str, periods: list[date], items: tuple[str, ...] | None = None
) -> DataFrame:
    """One method, items by periods."""
    rows = _items(predictions.where(F.col("model_alias") == model), entities, dimension, items)
    names = [p.strftime("%Y-%m") for p in periods]
    return (
        rows.withColumn("_p", F.date_format("ds", "yyyy-MM"))
        .groupBy("item", "measure")
        .pivot("_p", names)
        .agg(F.sum("yhat"))
    )


def distinct_scenarios(predictions: DataFrame) -> DataFrame:
    """Scenarios present, the base first."""
    names = predictions.select("scenario_id").distinct()
    return names.orderBy(F.when(F.col("scenario_id") == "base", 0).otherwise(1), "scenario_id")


def distinct_measures(predictions: DataFrame) -> DataFrame:
    return predictions.select("measure").distinct().orderBy("measure")


def dashboard_selection(run: dict[str, DataFrame], entities: DataFrame, bridge: DataFrame, flt: ResultFilter) -> DataFrame:
    """One row per chosen (node, measure) with all that a dashboard shows of it as arrays.

    Predictions, history, backtest and scores of a node meet in a single shuffle. A node's arrays are bounded by
    the study grid, the horizon, methods and scenarios.
    """
    preds = query_predictions(run["predictions"], flt, entities, bridge)
    history = run["values"].withColumn("node_id", F.col("series_id"))
    sources = {"preds": preds, "history": history, "cv": run["cv"], "scores": run["scores"]}
    if flt.measure is not None:
        sources = {name: rows.where(F.col("measure") == flt.measure) for name, rows in sources.items()}
    kinds = {name: F.struct(*[F.col(c) for c in rows.columns]) for name, rows in sources.items()}
    both = None
    for name, rows in sources.items():
        own = rows.select("node_id", "measure", kinds[name].alias(name))
        both = own if both is None else both.unionByName(own, allowMissingColumns=True)
    lists = [F.collect_list(name).alias(name) for name in sources]
    return both.groupBy("node_id", "measure").agg(*lists).where(F.size("preds") > 0)


def _history_by_date(selection: DataFrame) -> DataFrame:
    points = selection.select("measure", F.explode("history").alias("h"))
    return points.groupBy("measure", "h.ds").agg(F.sum("h.y").alias("y"))


def _cards(curves: DataFrame, per_date: DataFrame, step: int) -> DataFrame:
    """``view_cards`` from curves: the history joins once per measure, as one array of dates."""
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["yhat"], F.lit(0.0)))
    dates = F.flatten(F.collect_set(F.col("points.ds")))
    ahead = curves.groupBy("measure", "scenario_id", "model_alias").agg(
        F.count("*").alias("n_nodes"),
        F.sum(F.size("points")).alias("forecast_rows"),
        F.sum(total).alias("total_forecast"),
        F.array_distinct(dates).alias("_dates"),
    )
    past = per_date.groupBy("measure").agg(F.collect_list(F.struct("ds", "y")).alias("_past"))
    first = F.array_min("_dates")
    since = F.add_months(first, -F.size("_dates") * step)
    inside = F.filter("_past", lambda h: (h["ds"] < first) & (h["ds"] >= since))
    out = ahead.join(past, "measure", "left").withColumn(
        "total_history",
        F.when(F.size(inside) > 0, F.aggregate(inside, F.lit(0.0), lambda acc, h: acc + F.coalesce(h["y"], F.lit(0.0)))),
    )
    out = out.drop("_dates", "_past")
    return out.withColumn("variation", F.try_divide(F.col("total_forecast") - F.col("total_history"), F.col("total_history")))


def _metrics(selection: DataFrame) -> DataFrame:
    """``backtest_by_model`` from the selection: a node's errors are summed in its row."""
    methods = F.array_distinct(F.transform("preds", lambda p: p["model_alias"]))
    rows = selection.select("measure", "cv", F.explode(methods).alias("model_alias"))
    own = F.filter("cv", lambda c: c["evaluated"] & (c["model_alias"] == F.col("model_alias")))
    rows = rows.select("measure", "model_alias", own.alias("own"))

    def total(f) -> Column:
        return F.aggregate("own", F.lit(0.0), lambda acc, c: acc + f(c["yhat"] - c["y_actual"], c["y_actual"]))

    cuts = F.array_distinct(F.transform("own", lambda c: c["cutoff"]))
    longest = F.array_max(F.transform(cuts, lambda k: F.size(F.filter("own", lambda c: c["cutoff"] == k))))
    per_node = rows.where(F.size("own") > 0).select(
        "measure",
        "model_alias",
        F.size("own").alias("n"),
        total(lambda e, y: F.abs(e)).alias("off"),
        total(lambda e, y: e * e).alias("square"),
        total(lambda e, y: e).alias("lean"),
        total(lambda e, y: F.abs(y)).alias("actual"),
        F.size(cuts).alias("folds"),
        longest.cast("long").alias("h"),
    )
    n = F.sum("n")
    return per_node.groupBy("measure", "model_alias").agg(
        (F.sum("off") / n).alias("mae"),
        F.sqrt(F.sum("square") / n).alias("rmse"),
        F.when(F.sum("actual") > 0, F.sum("off") / F.sum("actual")).alias("wape"),
        (F.sum("lean") / n).alias("bias"),
        n.alias("n_eval"),
        F.sum("folds").alias("n_folds"),
        F.max("h").alias("cv_horizon"),
    )


def dashboard_query(
    run: dict[str, DataFrame], entities: DataFrame, bridge: DataFrame, flt: ResultFilter, step: int = 1
) -> dict[str, DataFrame]:
    """Filtered predictions with everything shown beside them.

    The selection is made and written once; all parts are read from it, most of them row by row.
    """
    selection = written(dashboard_selection(run, entities, bridge, flt), "dashboard")
    curves = M.curves(selection)
    per_date = _history_by_date(selection)
    covered = run["predictions"].where(F.col("scenario_id") == flt.scenario_id).groupBy("status").agg(
        F.count_distinct("node_id").alias("n_nodes")
    )
    out = {
        "predictions": selection.select(F.inline("preds")),
        "scores": selection.select(F.inline("scores")),
        "coverage": covered,
        "cards": _cards(curves, per_date, step),
        "metrics": _metrics(selection),
        "history": per_date,
        "mat": M.curve_positions(curves, step),
    }
    return out | {"issues": run["issues"]} if "issues" in run else out
