"""Export frames and sinks."""

from __future__ import annotations

from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import AssumptionRule, ForecastConfig, RegressorSpec, StudyConfig
from seriesmill.functions.text import is_formula, protect_formula
from seriesmill.operators import mat as M

# Columns of the long export.
LONG_TAIL = [
    "node_id", "level", "entity_id", "measure", "scenario_id", "ds", "tipo", "valor", "yhat_base",
    "observado", "ajustado", "lo80", "hi80", "model_alias", "interval_method", "status",
    "run_id", "preparation_id", "dataset_id",
]
# End of fixed values.


def history_rows(history: DataFrame) -> DataFrame:
    none = F.lit(None)
    return history.select(
        "node_id",
        F.lit("folha").alias("level"),
        "entity_id",
        "measure",
        none.cast("string").alias("scenario_id"),
        "ds",
        F.lit("historico").alias("tipo"),
        F.col("y").alias("valor"),
        none.cast("double").alias("yhat_base"),
        F.col("observed").alias("observado"),
        F.col("was_adjusted").alias("ajustado"),
        none.cast("double").alias("lo80"),
        none.cast("double").alias("hi80"),
        none.cast("string").alias("model_alias"),
        none.cast("string").alias("interval_method"),
        none.cast("string").alias("status"),
    )


def forecast_rows(predictions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    rows = predictions
    if base is None:
        rows = rows.withColumn("yhat_base", F.lit(None).cast("double"))
    else:
        keys = ["node_id", "measure", "ds", "model_alias"]
        rows = rows.join(base.select(*keys, F.col("yhat").alias("yhat_base")), keys, "left")
    return rows.select(
        "node_id",
        "level",
        "entity_id",
        "measure",
        "scenario_id",
        "ds",
        F.lit("previsao").alias("tipo"),
        F.col("yhat").alias("valor"),
        "yhat_base",
        F.lit(None).cast("boolean").alias("observado"),
        F.lit(None).cast("boolean").alias("ajustado"),
        "lo80",
        "hi80",
        "model_alias",
        "interval_method",
        "status",
    )


def export_long(
    history: DataFrame,
    predictions: DataFrame,
    entities: DataFrame,
    dimensions: list[str],
    ids: dict[str, str],
    base: DataFrame | None = None,
    mat: bool = False,
    step: int = 1,
) -> DataFrame:
    """History and forecast in one long table with dimensions, base value, limits and run ids.

    ``step`` is the number of months in a period; annual totals take twelve months of them.
    """
    past, ahead = history_rows(history), forecast_rows(predictions, base)
    if mat:
        points = history.select("node_id", "measure", "ds", "y")
        old = M.mat_history(points, step).select("node_id", "measure", "ds", "mat")
        new = M.mat_forecast(points, predictions, step)
        past = past.join(old, ["node_id", "measure", "ds"]).withColumn("valor", F.col("mat")).drop("mat")
        ahead = ahead.join(new, ["node_id", "measure", "scenario_id", "model_alias", "ds"])
        ahead = ahead.withColumn("valor", F.col("mat")).drop("mat")
        ahead = ahead.withColumns({c: F.lit(None).cast("double") for c in ("lo80", "hi80", "yhat_base")})
    both = past.unionByName(ahead).withColumns({k: F.lit(v) for k, v in ids.items()})
    named = both.join(entities.select("entity_id", *dimensions), "entity_id", "left")
    return named.select(*dimensions, *LONG_TAIL)


def sorted_export(long: DataFrame) -> DataFrame:
    """Stable order by node, measure and date: a range-partitioned sort, not one task."""
    return long.orderBy("node_id", "measure", "ds", "tipo", "model_alias")


def to_wide(long: DataFrame, dimensions: list[str], history: list[date], horizon: list[date], model: str) -> DataFrame:
    """One row per node: ``historico_<date>`` and ``previsao_<date>`` columns of one method."""
    index = [*dimensions, "node_id", "level", "entity_id", "measure"]
    names = [f"historico_{d.isoformat()}" for d in history] + [f"previsao_{d.isoformat()}" for d in horizon]
    rows = long.where((F.col("tipo") == "historico") | (F.col("model_alias") == model))
    rows = rows.withColumn("_c", F.concat_ws("_", "tipo", F.date_format("ds", "yyyy-MM-dd")))
    wide = rows.groupBy(*index).pivot("_c", names).agg(F.first("valor", ignorenulls=True))
    meta = rows.where("tipo = 'previsao'").groupBy("node_id", "measure").agg(
        F.max("model_alias").alias("model_alias"), F.max("status").alias("status")
    )
    return wide.join(meta, ["node_id", "measure"], "left")


def wide_by_node(rows: DataFrame, index: list[str], value: str, periods: list[date]) -> DataFrame:
    """Index columns and one column per period: YYYYMM where every period starts a month, else ISO."""
    python_format, spark_format = ("%Y%m", "yyyyMM") if all(p.day == 1 for p in periods) else ("%Y-%m-%d", "yyyy-MM-dd")
    names = [p.strftime(python_format) for p in periods]
    return (
        rows.withColumn("_p", F.date_format("ds", spark_format)).groupBy(*index).pivot("_p", names).agg(F.sum(value))
    )


def scores_frame(scores: DataFrame, owners: DataFrame, entities: DataFrame, dimensions: list[str]) -> DataFrame:
    named = scores.join(owners.select("node_id", "entity_id").distinct(), "node_id", "left")
    return named.join(entities.select("entity_id", *dimensions), "entity_id", "left").select(
        *dimensions, "node_id", "measure", "model_alias", "mae", "rmse", "wape", "bias", "n_eval", "n_folds",
        "selected", "selection_reason",
    )


def quality_frame(issues: DataFrame) -> DataFrame:
    return issues.select("code", "severity", "message", "source_row_id", "entity_id")


def assumptions_frame(spark: SparkSession, rules: tuple[AssumptionRule, ...], regressors: tuple[RegressorSpec, ...]) -> DataFrame:
    """Rules and regressors of a run as rows (settings, so a handful)."""
    rows = [("rule", r.scenario_id, r.rule_id, r.family, r.measure, r.effect, r.rate, r.to_json()) for r in rules]
    rows += [("regressor", "", r.regressor_id, r.name, "", r.fill_policy, None, r.to_json()) for r in regressors]
    schema = "kind string, scenario_id string, id string, name string, measure string, effect string, rate double, detail string"
    return spark.createDataFrame(rows, schema)


def export_manifest(
    spark: SparkSession,
    run: dict[str, str],
    study: StudyConfig,
    config: ForecastConfig,
    scores: DataFrame | None = None,
    issues: DataFrame | None = None,
) -> DataFrame:
    """Section, key and value rows describing a run: its settings, what was selected how often, and its issues.

    Settings are a few rows known to the driver; the rest is counted from the run's tables.
    """
    rows = [("run", k, str(v)) for k, v in run.items()]
    rows += [("study", k, str(v)) for k, v in asdict(study).items()]
    rows += [("forecast", k, str(v)) for k, v in asdict(config).items()]
    out = spark.createDataFrame(rows, "section string, key string, value string")
    if scores is not None:
        out = out.unionByName(_counted("selection", scores.where("selected"), ("measure", "model_alias", "selection_reason")))
    return out if issues is None else out.unionByName(_counted("issues", issues, ("code", "severity")))


def _counted(section: str, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return found.select(F.lit(section).alias("section"), F.concat_ws(" / ", *keys).alias("key"), F.col("n").cast("string").alias("value"))


def template_rows(entities: DataFrame, periods: list[date], start: int = 1) -> DataFrame:
    """Example rows in the long layout: one per entity and period, values from their positions."""
    at = F.posexplode(F.array(*[F.lit(p) for p in periods])).alias("i", "ds")
    rows = entities.select("*", at).withColumn("unidades", 10 * (F.col("i") + 1) + start)
    return rows.withColumn("valor", F.col("unidades") * 1.5).withColumn("periodo", F.date_format("ds", "yyyy-MM")).drop("i", "ds")


def template_wide(entities: DataFrame, periods: list[date], measures: tuple[str, ...]) -> DataFrame:
    """Example rows in the wide layout: one per entity and measure, a column per period."""
    rows = entities.select("*", F.explode(F.array(*[F.lit(m) for m in measures])).alias("medida"))
    scale = F.when(F.col("medida") == "unidades", F.lit(1.0)).otherwise(F.lit(1.5))
    return rows.withColumns({p.strftime("%Y-%m"): scale * (10 + j) for j, p in enumerate(periods)})


def protect_table(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text cells that could be read as formulas get an apostrophe; second frame counts them."""
    texts = [name for name, kind in df.dtypes if kind == "string"]
    counts = [F.count_if(is_formula(F.col(f"`{c}`"))) for c in texts]
    total = counts[0] if counts else F.lit(0).cast("long")
    for c in counts[1:]:
        total = total + c
    protected = df.withColumns({c: protect_formula(F.col(f"`{c}`")) for c in texts})
    return protected, df.agg(total.alias("n_protected"))


def write_csv(df: DataFrame, path: str, delimiter: str = ";") -> None:
    protect_table(df)[0].write.mode("overwrite").csv(path, sep=delimiter, header=True, escape='"')


def write_by_model(wide: DataFrame, path: str) -> None:
    """One folder per method."""
    wide.write.mode("overwrite").partitionBy("model_alias").parquet(path)
