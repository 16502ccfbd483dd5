"""Moving annual totals: the consecutive periods of twelve months, components floored at zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.once import once

SPAN = 12


def rolling_mat(rows: DataFrame, keys: list[str], value: str, step: int = 1, span: int = SPAN) -> DataFrame:
    """``mat`` where the last ``span`` rows cover exactly ``span`` consecutive periods, else null."""
    frame = Window.partitionBy(*keys).orderBy("ds").rowsBetween(-(span - 1), 0)
    whole = (F.count(value).over(frame) == span) & (
        F.min("ds").over(frame) == F.add_months("ds", -(span - 1) * step)
    )
    floored = F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(0.0)))
    return rows.withColumn("mat", F.when(whole, F.sum(floored).over(frame)))


def mat_history(history: DataFrame, step: int = 1) -> DataFrame:
    return rolling_mat(history, ["node_id", "measure"], "y", step, SPAN // step).where("mat IS NOT NULL").drop("y")


def curves(selection: DataFrame) -> DataFrame:
    """One row per (node, measure, scenario, method) with its predictions in order of time.

    ``selection`` has a row per node and measure with the arrays ``history`` (ds, y) and ``preds``.
    """
    keys = F.array_distinct(F.transform("preds", lambda p: F.struct(p["scenario_id"].alias("scenario_id"), p["model_alias"].alias("model_alias"))))
    rows = selection.select("node_id", "measure", "history", "preds", F.explode(keys).alias("k"))
    own = F.filter("preds", lambda p: p["scenario_id"].eqNullSafe(F.col("k.scenario_id")) & (p["model_alias"] == F.col("k.model_alias")))
    points = F.sort_array(F.transform(own, lambda p: F.struct(p["ds"].alias("ds"), p["yhat"].alias("yhat"))))
    return rows.select("node_id", "measure", "k.scenario_id", "k.model_alias", "history", points.alias("points"))


def curve_positions(rows: DataFrame, step: int = 1) -> DataFrame:
    """MAT of each forecast date of ``curves``, row by row, where all periods of its year are there."""
    span = SPAN // step
    old = F.transform("history", lambda h: F.struct(h["ds"].alias("ds"), h["y"].alias("y")))
    past = F.slice(F.sort_array(old, asc=False), 1, span - 1) if span > 1 else F.slice(old, 1, 0)
    new = F.transform("points", lambda p: F.struct(p["ds"].alias("ds"), p["yhat"].alias("y")))
    known = F.concat(F.filter(past, lambda h: h["y"].isNotNull()), F.filter(new, lambda p: p["y"].isNotNull()))
    rows = once(rows.select("node_id", "measure", "scenario_id", "model_alias", "points", "history"), {"known": known})

    def year(d: Column) -> Column:
        # Dates are distinct, so as many values as periods inside the year are exactly its periods.
        inside = F.filter("known", lambda v: (v["ds"] <= d) & (v["ds"] > F.add_months(d, -SPAN)))
        start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("total"))
        return F.aggregate(
            inside,
            start,
            lambda acc, v: F.struct((acc["n"] + 1).alias("n"), (acc["total"] + F.greatest(v["y"], F.lit(0.0))).alias("total")),
            lambda acc: F.when(acc["n"] == span, acc["total"]),
        )

    cells = F.transform("points", lambda p: F.struct(p["ds"].alias("ds"), year(p["ds"]).alias("mat")))
    out = rows.select("node_id", "measure", "scenario_id", "model_alias", F.explode(cells).alias("c"))
    return out.where(F.col("c.mat").isNotNull()).select("node_id", "measure", "scenario_id", "model_alias", "c.ds", "c.mat")


def mat_forecast(history: DataFrame, predictions: DataFrame, step: int = 1) -> DataFrame:
    """MAT positions of the forecast dates, per scenario and method.

    History and forecasts of a node meet in one shuffle; the totals are worked out inside its row.
    """
    past = history.select("node_id", "measure", F.struct("ds", F.col("y").cast("double").alias("y")).alias("h"))
    ahead = predictions.select("node_id", "measure", F.struct("scenario_id", "model_alias", "ds", "yhat").alias("p"))
    both = past.unionByName(ahead, allowMissingColumns=True)
    lists = [F.collect_list("h").alias("history"), F.collect_list("p").alias("preds")]
    return curve_positions(curves(both.groupBy("node_id", "measure").agg(*lists)), step)


def mat_direct(predictions: DataFrame) -> DataFrame:
    """The series already are annual totals: the forecast is the position."""
    return predictions.select("node_id", "measure", "scenario_id", "model_alias", "ds", F.col("yhat").alias("mat"))


def mat_cards(history: DataFrame, predictions: DataFrame, step: int = 1) -> DataFrame:
    """Last forecast position against the last full historical one, per node and summed per curve."""
    keys = ["node_id", "measure"]
    ahead = mat_forecast(history, predictions, step)
    last = ahead.groupBy(*keys, "scenario_id", "model_alias").agg(F.max_by("mat", "ds").alias("mat_final"))
    positions = mat_history(history, step).groupBy(*keys).agg(F.max_by("mat", "ds").alias("mat_history"))
    joined = last.join(positions, keys, "left")
    out = joined.groupBy("measure", "scenario_id", "model_alias").agg(
        F.count("*").alias("n_nodes"), F.sum("mat_final").alias("mat_final"), F.sum("mat_history").alias("mat_history")
    )
    return out.withColumn(
        "mat_variation", F.try_divide(F.col("mat_final") - F.col("mat_history"), F.col("mat_history"))
    )
