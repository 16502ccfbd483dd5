"""Product hierarchy: node ids from dimension prefixes, bridge table, roll-ups.

Coverage lives in the (entity, node) bridge. A node that covers every entity is one more set of
bridge rows, never one huge array in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.config import HierarchyConfig
from seriesmill.functions import ids
from seriesmill.operators.models import floor_zero
from seriesmill.sources.store import LEAF

TOTAL_LEVEL = -1


def level_issues(hierarchy: HierarchyConfig) -> list[tuple[str, str]]:
    """Each level must extend the one above, and the forecast level must exist."""
    found = []
    for upper, lower in zip(hierarchy.levels, hierarchy.levels[1:]):
        if not set(upper) < set(lower):
            found.append(("E_HIERARCHY_INVALID", f"{'>'.join(lower)} does not extend {'>'.join(upper)}"))
    level = hierarchy.forecast_level
    if level is not None and not 0 <= level < len(hierarchy.levels):
        found.append(("E_HIERARCHY_INVALID", f"forecast level {level} is not in the hierarchy"))
    return found


def ambiguous_leaves(entities: DataFrame, hierarchy: HierarchyConfig) -> DataFrame:
    """Leaf keys shared by several entities."""
    leaf = list(hierarchy.levels[-1])
    return (
        entities.select("entity_id", *leaf)
        .distinct()
        .groupBy(*leaf)
        .agg(F.count("*").alias("n_entities"))
        .where("n_entities > 1")
        .withColumn("code", F.lit("E_HIERARCHY_INVALID"))
    )


def _level_id(level: int, hierarchy: HierarchyConfig) -> Column:
    return ids.node_id(level, [F.col(d) for d in hierarchy.levels[level]])


def _nodes_of(hierarchy: HierarchyConfig) -> list[tuple[int, Column, Column, Column]]:
    """(level, level name, node id, parent id) of an entity's row, from the top down."""
    total = ids.total_node_id()
    none = F.lit(None).cast("string")
    entries = [(TOTAL_LEVEL, F.lit("Total"), total, none)] if hierarchy.include_total else []
    for level, dims in enumerate(hierarchy.levels):
        if level > 0:
            parent = _level_id(level - 1, hierarchy)
        else:
            parent = total if hierarchy.include_total else none
        entries.append((level, F.concat_ws(" > ", *dims), _level_id(level, hierarchy), parent))
    return entries


def node_bridge(entities: DataFrame, hierarchy: HierarchyConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """(entity, node) for every level; ids come from the row's own dimensions, so nothing joins.

    Columns named in ``keep`` stay beside each node of their entity.
    """
    nodes = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"), name.alias("level_name"), node.alias("node_id"), up.alias("parent_node_id")
            )
            for level, name, node, up in _nodes_of(hierarchy)
        ]
    )
    return entities.select("entity_id", *keep, F.explode(nodes).alias("b")).select("entity_id", *keep, "b.*")


def ancestors(entities: DataFrame, hierarchy: HierarchyConfig, leaves: bool = False) -> DataFrame:
    """One row per entity with the ids of its nodes above the leaves as an array, or of all its nodes."""
    deepest = len(hierarchy.levels) - 1
    above = [node for level, _, node, _ in _nodes_of(hierarchy) if leaves or level < deepest]
    found = F.array(*above) if above else F.array().cast("array<string>")
    return entities.select("entity_id", found.alias("ancestors"))


def looked_up(rows: DataFrame) -> DataFrame:
    """Rows of entities that meet many times as many others: kept in a hash table a task, so that the others need no sort."""
    return rows.hint("shuffle_hash")


def expected_leaves(entities: DataFrame, hierarchy: HierarchyConfig) -> DataFrame:
    """Per node above the leaves: its name and the leaves it should have."""
    above = node_bridge(entities, hierarchy).where(F.col("level") < len(hierarchy.levels) - 1)
    return above.groupBy("node_id", "level_name").agg(F.count("*").alias("_expected"))


def build_nodes(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("node_id", "level", "level_name", "parent_node_id").agg(F.count("*").alias("n_entities"))


def run_nodes(values: DataFrame, entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Leaf series nodes and hierarchy nodes in one table, with dimensions where one entity is covered."""
    dims = entities.select("entity_id", F.to_json("dims").alias("dimensions_json"))
    series = values.select(F.col("series_id").alias("node_id"), "entity_id").distinct()
    leaves = series.join(dims, "entity_id", "left").select(
        "node_id",
        F.lit(LEAF).alias("level"),
        F.lit(None).cast("string").alias("parent_node_id"),
        "entity_id",
        F.coalesce("dimensions_json", F.lit("{}")).alias("dimensions_json"),
        F.lit(1).cast("long").alias("n_entities"),
    )
    grouped = bridge.groupBy("node_id", "level_name", "parent_node_id").agg(
        F.count("*").alias("n_entities"), F.min("entity_id").alias("_one")
    )
    single = F.when(F.col("n_entities") == 1, F.col("_one"))
    upper = (
        grouped.withColumn("entity_id", single)
        .join(dims, "entity_id", "left")
        .select(
            "node_id",
            F.col("level_name").alias("level"),
            "parent_node_id",
            "entity_id",
            F.coalesce("dimensions_json", F.lit("{}")).alias("dimensions_json"),
            "n_entities",
        )
    )
    return leaves.unionByName(upper)


def aggregate_history(values: DataFrame, bridge: DataFrame, level: int) -> DataFrame:
    """Summed history per node of one level; the result is again a set of series."""
    members = bridge.where(F.col("level") == level).select("entity_id", "node_id")
    return (
        values.join(members, "entity_id")
        .groupBy("node_id", "measure", "ds")
        .agg(F.sum("y").alias("y"), F.bool_and("observed").alias("observed"))
        .select(
            ids.series_id(F.col("node_id"), F.col("measure")).alias("series_id"),
            "measure",
            F.col("node_id").alias("entity_id"),
            "ds",
            "y",
            "observed",
        )
    )


def reconcile_bottom_up(predictions: DataFrame, bridge: DataFrame, hierarchy: HierarchyConfig) -> DataFrame:
    """Stored leaf forecasts, one row per date, summed at every ancestor.

    Sums combine before the shuffle, so the top node costs one row per task and period. A run that still
    has its horizon in arrays sums those instead (``outcome.roll_up``).
    """
    leaf_level = len(hierarchy.levels) - 1
    above = bridge.where(F.col("level") < leaf_level)
    expected = build_nodes(above).select("node_id", "level_name", F.col("n_entities").alias("_expected"))
    summed = (
        predictions.select("entity_id", "measure", "scenario_id", "ds", "model_alias", floor_zero(F.col("yhat")).alias("yhat"))
        .join(looked_up(above.select("entity_id", "node_id")), "entity_id")
        .groupBy("node_id", "measure", "scenario_id", "ds", "model_alias")
        .agg(F.sum("yhat").alias("yhat"), F.count("yhat").alias("n_leaves"))
    )
    return labelled(summed, expected, hierarchy)


def labelled(summed: DataFrame, expected: DataFrame, hierarchy: HierarchyConfig, keep: tuple[str, ...] = ()) -> DataFrame:
    """Summed nodes as predictions: status against the leaves a node should have.

    Limits of single series are not additive and stay null.
    """
    complete = F.col("n_leaves") == F.col("_expected")
    return summed.join(expected, "node_id").select(
        "node_id",
        F.col("node_id").alias("entity_id"),
        F.col("level_name").alias("level"),
        "measure",
        "scenario_id",
        "ds",
        "yhat",
        F.lit(None).cast("double").alias("lo80"),
        F.lit(None).cast("double").alias("hi80"),
        "model_alias",
        F.lit("unavailable_insufficient_history").alias("interval_method"),
        F.when(complete, "ok").otherwise("partial_coverage").alias("status"),
        "n_leaves",
        F.when(complete & F.lit(hierarchy.mode == "mintrace"), "MinT").otherwise("BottomUp").alias("reconciliation"),
        *keep,
    )


def run_tree(entities: DataFrame, dimensions: list[str]) -> DataFrame:
    """Series counts at every prefix of the ordered dimensions."""
    named = entities.select(
        "node_id", *[F.when(F.coalesce(d, F.lit("")) == "", "(vazio)").otherwise(F.col(d)).alias(d) for d in dimensions]
    ).distinct()
    return named.rollup(*dimensions).agg(F.count("*").alias("n_series"), F.grouping_id().alias("gid"))


def round_and_recompose(predictions: DataFrame, aggregates: DataFrame, bridge: DataFrame) -> DataFrame:
    """Whole units at the leaves; a parent is the sum of rounded leaves when all of them are there."""
    keys = ["measure", "scenario_id", "ds", "model_alias"]
    units = F.col("measure") == "unidades"
    leaves = predictions.withColumn("yhat", F.when(units, F.bround("yhat", 0)).otherwise(F.col("yhat")))
    above = bridge.select("entity_id", "node_id")
    sums = (
        leaves.where(units)
        .select("entity_id", *keys, "yhat")
        .join(above, "entity_id")
        .groupBy("node_id", *keys)
        .agg(F.sum("yhat").alias("_whole"))
    )
    parents = aggregates.join(sums, ["node_id", *keys], "left").withColumn(
        "yhat",
        F.when((F.col("status") == "ok") & F.col("_whole").isNotNull(), F.col("_whole")).otherwise(F.col("yhat")),
    )
    columns = ["node_id", "level", *keys, "yhat", "status"]
    return leaves.select(*columns).unionByName(parents.select(*columns))


def grain_rollup(rows: DataFrame, entities: DataFrame, dimension: str, keys: list[str], value: str) -> DataFrame:
    """Forecasts or history summed by the value of one dimension."""
    dims = entities.select("entity_id", F.col(dimension).alias("grain"))
    return rows.join(looked_up(dims), "entity_id").groupBy("grain", *keys).agg(F.sum(value).alias(value))
