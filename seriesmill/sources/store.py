"""Stored datasets, preparations, runs and drafts.

Tables are Parquet folders; what counts is said by small append-only logs (``log``). A run or a
preparation is written into folders of its own first and becomes visible with one row of its log, all tables
at once; what an interrupted writer left is never read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.config import RegressorSpec, Scenario
from seriesmill.operators.normalize import Canonical
from seriesmill.sources import log

# Primary keys of the stored result tables.
FORECAST_KEY = ["run_id", "node_id", "measure", "scenario_id", "ds", "model_alias"]
CV_KEY = ["run_id", "node_id", "measure", "model_alias", "cutoff", "ds"]
SCORE_KEY = ["run_id", "node_id", "measure", "model_alias"]
NODE_KEY = ["run_id", "node_id"]
ISSUE_KEY = ["run_id", "stage", "code", "subject"]
LEAF = "folha"
# End of fixed values.


def save_canonical(data: Canonical, root: str, dataset_id: str) -> None:
    """The three canonical tables, one partition per dataset; saving again replaces it."""
    for name in ("source_rows", "entities", "observations"):
        replace_partition(getattr(data, name), f"{root}/{name}", "dataset_id", dataset_id)


def load_canonical(spark: SparkSession, root: str, dataset_id: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{root}/{name}").where(F.col("dataset_id") == dataset_id).drop("dataset_id")
        for name in ("source_rows", "entities", "observations")
    }


def replace_partition(df: DataFrame, path: str, column: str, value: str) -> None:
    """Idempotent write: only the named partition is overwritten."""
    (
        df.withColumn(column, F.lit(value))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(path)
    )


def save_preparation(values: DataFrame, root: str, preparation_id: str, **others: DataFrame) -> bool:
    """Keep a preparation under its content id; one that is there already is not computed again.

    ``others`` are further tables of it. The catalog row comes last and makes it visible.
    """
    spark = values.sparkSession
    if _preparation(spark, root, preparation_id) is not None:
        return False
    place = uuid.uuid4().hex
    for name, rows in {"values": values, **others}.items():
        rows.write.parquet(f"{root}/{name}/{place}")
    log.append(spark.createDataFrame([(preparation_id, place, _now())], PREPARATIONS), f"{root}/catalog")
    return True


PREPARATIONS = "preparation_id string, place string, version string"


def _preparation(spark: SparkSession, root: str, preparation_id: str) -> str | None:
    rows = log.read(spark, f"{root}/catalog", PREPARATIONS).where(F.col("preparation_id") == preparation_id)
    found = log.newest(rows, ["preparation_id"]).first()
    return found["place"] if found else None


def load_preparation(spark: SparkSession, root: str, preparation_id: str, name: str = "values") -> DataFrame | None:
    """A table of a kept preparation, or None if there is none."""
    place = _preparation(spark, root, preparation_id)
    return None if place is None else spark.read.parquet(f"{root}/{name}/{place}")


# Runs

RUN_TABLES = {
    "predictions": FORECAST_KEY,
    "aggregates": FORECAST_KEY,
    "cv": CV_KEY,
    "scores": SCORE_KEY,
    "selection": SCORE_KEY,
    "nodes": NODE_KEY,
    "issues": ISSUE_KEY,
    "summary": ["run_id"],
}
COMMITS = "run_id string, version long, tables map<string,string>, n_series long, models string"
RUNS = "run_id string, dataset_id string, preparation_id string, status string, started_at string, ended_at string, config_json string, version long"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest row of each key, so the choice doesn't depend on the order of rows."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def _commit(spark: SparkSession, root: str, run_id: str) -> dict | None:
    """The newest commit of a run; a single row."""
    rows = log.read(spark, f"{root}/commits", COMMITS).where(F.col("run_id") == run_id)
    found = rows.orderBy(F.desc("version"), F.desc(F.to_json("tables"))).limit(1).collect()
    return found[0].asDict() if found else None


def persist_run(results: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write the result tables of a run; rows with the keys of stored ones replace them.

    Every call writes new folders and ends with a commit row that names the folder of each table, so readers
    see the old state or the new one, never a part. Tables that aren't given stay as they were.
    """
    spark = next(iter(results.values())).sparkSession
    before = _commit(spark, root, run_id)
    tables = dict(before["tables"]) if before else {}
    place = uuid.uuid4().hex
    for name, keys in RUN_TABLES.items():
        if name not in results:
            continue
        batch = one_per_key(results[name].drop("run_id").withColumn("run_id", F.lit(run_id)), keys)
        if name in tables:
            old = _table(spark, root, run_id, name, tables[name])
            batch = upsert(old.select(*batch.columns), batch, keys)
        batch.drop("run_id").write.parquet(f"{root}/{name}/{quote(run_id, safe='')}/{place}")
        tables[name] = place
    n_series, models = _described(spark, root, run_id, tables)
    version = before["version"] + 1 if before else 1
    log.append(spark.createDataFrame([(run_id, version, tables, n_series, models)], COMMITS), f"{root}/commits")


def _described(spark: SparkSession, root: str, run_id: str, tables: dict[str, str]) -> tuple[int | None, str]:
    """Series and methods of a run for its catalog, from the stored scores."""
    if "scores" not in tables:
        return None, ""
    found = _table(spark, root, run_id, "scores", tables["scores"]).agg(
        F.count_distinct("node_id").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("model_alias"))).alias("models")
    )
    row = found.first()
    return row["n"], row["models"]


def _table(spark: SparkSession, root: str, run_id: str, name: str, place: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/{quote(run_id, safe='')}/{place}").withColumn("run_id", F.lit(run_id))


def load_run(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame | None:
    """A table of the newest committed state of a run, or None."""
    found = _commit(spark, root, run_id)
    return _table(spark, root, run_id, name, found["tables"][name]) if found and name in found["tables"] else None


def record_run(spark: SparkSession, root: str, run_id: str, status: str, **fields: str) -> None:
    """Note a new state of a run; what isn't given stays as it was noted last."""
    rows = log.read(spark, f"{root}/runs", RUNS).where(F.col("run_id") == run_id)
    last = rows.orderBy(F.desc("version")).limit(1).collect()
    now = last[0].asDict() if last else {"run_id": run_id, "started_at": _now(), "version": 0}
    ended = None if status == "running" else _now()
    now |= {"ended_at": ended, **fields, "status": status, "version": now["version"] + 1}
    names = [c.split()[0] for c in RUNS.split(", ")]
    log.append(spark.createDataFrame([tuple(now.get(c) for c in names)], RUNS), f"{root}/runs")


def stored_runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of every run."""
    return log.newest(log.read(spark, f"{root}/runs", RUNS), ["run_id"])


def mark_interrupted_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs that were left running become interrupted; returns their ids."""
    left = stored_runs(spark, root).where("status = 'running'")
    marked = left.withColumns({"status": F.lit("interrupted"), "ended_at": F.lit(_now()), "version": F.col("version") + 1})
    ids = marked.select("run_id", "version").collect() if not left.isEmpty() else []
    if ids:
        names = [c.split()[0] for c in RUNS.split(", ")]
        log.append(marked.select(*names), f"{root}/runs")
    return spark.createDataFrame([(r["run_id"],) for r in ids], "run_id string")


def stored_catalog(spark: SparkSession, root: str, datasets: DataFrame) -> DataFrame:
    """Finished runs with a commit: their series, methods and horizon come from the commit row, no result is read."""
    commits = log.newest(
        log.read(spark, f"{root}/commits", COMMITS).select("run_id", "version", "n_series", "models"), ["run_id"]
    ).drop("version")
    finished = stored_runs(spark, root).where(F.col("status").isin("completed", "partial"))
    return (
        finished.join(commits, "run_id")
        .join(datasets.select("dataset_id", "filename"), "dataset_id", "left")
        .select(
            "run_id",
            "dataset_id",
            "filename",
            "status",
            "started_at",
            F.coalesce("n_series", F.lit(0)).alias("n_series"),
            F.get_json_object("config_json", "$.horizon").try_cast("long").alias("horizon"),
            F.coalesce("models", F.lit("")).alias("models"),
        )
    )


def last_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest row per key as an aggregate, so repeats shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    latest = F.max(F.struct(F.col(order), *rest)).alias("_m")
    return rows.groupBy(*keys).agg(latest).select(*keys, f"_m.{order}", *[f"_m.{c}" for c in rest])


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Stored rows not named by the batch, and the batch itself (last row per key)."""
    batch = incoming if order is None else last_per_key(incoming, keys, order).drop(order)
    return stored.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    filled = incoming.withColumns(
        {
            "level": F.coalesce("level", F.lit(LEAF)),
            "dimensions_json": F.coalesce("dimensions_json", F.lit("{}")),
        }
    )
    return upsert(stored, filled, NODE_KEY)


# Drafts

DRAFTS = "dataset_id string, kind string, draft_id string, payload string, updated_at string"
DRAFT_KEY = ["dataset_id", "kind", "draft_id"]


def draft_rows(spark: SparkSession, dataset_id: str, scenarios: tuple[Scenario, ...] = (), regressors: tuple[RegressorSpec, ...] = ()) -> DataFrame:
    """Scenarios and regressors being worked on, as rows of now."""
    now = _now()
    rows = [(dataset_id, "scenario", s.scenario_id, s.to_json(), now) for s in scenarios]
    rows += [(dataset_id, "regressor", r.regressor_id, r.to_json(), now) for r in regressors]
    return spark.createDataFrame(rows, DRAFTS)


def save_assumptions(drafts: DataFrame, path: str) -> None:
    """Add drafts; of those with one id the newest counts, whoever saved it."""
    log.append(drafts.select(*[c.split()[0] for c in DRAFTS.split(", ")]), path)


def load_assumptions(drafts: DataFrame) -> DataFrame:
    """Newest draft per (dataset, kind, id)."""
    return log.newest(drafts, DRAFT_KEY, "updated_at")


def saved_assumptions(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    return load_assumptions(log.read(spark, path, DRAFTS).where(F.col("dataset_id") == dataset_id))


def compact_assumptions(spark: SparkSession, path: str) -> int:
    """Keep the newest row of each draft only; writers and their rows of the meantime aren't disturbed."""
    return log.compact(spark, path, DRAFTS, DRAFT_KEY, "updated_at")


def run_catalog(runs: DataFrame, datasets: DataFrame, nodes: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Finished runs with leaf-series count, methods and horizon."""
    finished = runs.where(F.col("status").isin("completed", "partial"))
    leaves = nodes.where(F.col("level") == LEAF).groupBy("run_id").agg(F.count("*").alias("n_series"))
    methods = (
        forecasts.select("run_id", "model_alias")
        .distinct()
        .groupBy("run_id")
        .agg(F.concat_ws(",", F.sort_array(F.collect_list("model_alias"))).alias("models"))
    )
    return (
        finished.join(datasets.select("dataset_id", "filename"), "dataset_id", "left")
        .join(leaves, "run_id", "left")
        .join(methods, "run_id", "left")
        .select(
            "run_id",
            "dataset_id",
            "filename",
            "status",
            "started_at",
            F.coalesce("n_series", F.lit(0)).alias("n_series"),
            F.get_json_object("config_json", "$.horizon_periods").try_cast("long").alias("horizon"),
            F.coalesce("models", F.lit("")).alias("models"),
        )
    )


def newest_first(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(F.desc(column))


def list_runs(runs: DataFrame, dataset_id: str | None = None) -> DataFrame:
    picked = runs if dataset_id is None else runs.where(F.col("dataset_id") == dataset_id)
    return newest_first(picked, "started_at")


def list_datasets(datasets: DataFrame) -> DataFrame:
    return newest_first(datasets, "created_at")


def rank_newest(runs: DataFrame) -> DataFrame:
    """Position of each run inside its dataset, newest first."""
    w = Window.partitionBy("dataset_id").orderBy(F.desc("started_at"), "run_id")
    return runs.withColumn("position", F.row_number().over(w))
