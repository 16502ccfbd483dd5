"""One method for a few chosen series, out of a stored panel, with a cache of what was asked before.

The panel of a run is stored by parts of the series id, so a question reads the files of the series it names. Only
the method that is asked for is computed, and only for series that aren't in the cache yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import ForecastConfig, StudyConfig
from seriesmill.operators import backtest as FC
from seriesmill.operators import models
from seriesmill.operators.panel import FINAL_FOLD
from seriesmill.session import path_exists

#: Parts of a stored panel; a part has as many series as the run has, by this many.
PARTS = 256
CACHE = (
    "part int, node_id string, measure string, model_alias string, status string, dates array<date>, yhat array<double>"
)


def _part(series: Column) -> Column:
    return F.pmod(F.xxhash64(series), F.lit(PARTS)).cast("int")


def store_panel(panel: DataFrame, path: str) -> None:
    """Keep the final training parts of all series, one folder per part."""
    rows = panel.where(F.col("fold") == FINAL_FOLD).withColumn("part", _part(F.col("series_id")))
    rows.repartition("part").sortWithinPartitions("part", "series_id").write.partitionBy("part").parquet(path)


def _chosen(rows: DataFrame, parts: list[int], column: str, names: tuple[str, ...]) -> DataFrame:
    return rows.where(F.col("part").isin(*parts) & F.col(column).isin(*names))


def candidate_frame(panel: DataFrame, alias: str, study: StudyConfig, config: ForecastConfig) -> DataFrame:
    """Final rows of one method; series it can't be used for keep a row that says so. There is no fallback."""
    specs = [s for s in models.candidate_registry(study, config) if s.alias == alias]
    if not specs:
        raise ValueError(f"{alias} is no method of this run")
    frame = FC.forecast_frame(panel, study, config, limits=False, specs=specs)
    out = frame.where(F.col("model_alias") == alias).select(
        F.col("series_id").alias("node_id"), "measure", "failure_reason", F.col("eval_dates").alias("dates"), "raw"
    )
    known = panel.select(F.col("series_id").alias("node_id"), "measure", "n_total")
    why = F.when(F.col("n_total") < models.MIN_FINAL_HISTORY, "insufficient_history").otherwise("not_eligible")
    ok = F.col("raw").isNotNull()
    return known.join(out, ["node_id", "measure"], "left").select(
        "node_id",
        "measure",
        F.lit(alias).alias("model_alias"),
        F.when(ok, "ok").otherwise(F.coalesce("failure_reason", why)).alias("status"),
        F.when(ok, F.col("dates")).alias("dates"),
        F.transform("raw", models.floor_zero).alias("yhat"),
    )


def candidate(
    spark: SparkSession, panel_path: str, cache_path: str, node_ids: tuple[str, ...], alias: str, study: StudyConfig, config: ForecastConfig
) -> DataFrame:
    """The method's values for the named series, or the reason there are none; what is new goes into the cache.

    The list of names comes with the question, so what is looked up on the driver has its size.
    """
    names = spark.createDataFrame([(n,) for n in node_ids], "node_id string")
    parts = sorted({r["part"] for r in names.select(_part(F.col("node_id")).alias("part")).collect()})
    cached = _cached(spark, cache_path, parts, node_ids, alias)
    known = {r["node_id"] for r in cached.select("node_id").distinct().collect()}
    rest = tuple(n for n in node_ids if n not in known)
    if rest:
        panel = _chosen(spark.read.parquet(panel_path), parts, "series_id", rest).drop("part")
        fresh = candidate_frame(panel, alias, study, config).withColumn("part", _part(F.col("node_id")))
        fresh.write.mode("append").partitionBy("part", "model_alias").parquet(cache_path)
    # Two questions at the same time may both have added a series; their rows are the same.
    return _cached(spark, cache_path, parts, node_ids, alias).drop("part").distinct()


def _cached(spark: SparkSession, path: str, parts: list[int], node_ids: tuple[str, ...], alias: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(path)
    return _chosen(rows.where(F.col("model_alias") == alias), parts, "node_id", node_ids)
