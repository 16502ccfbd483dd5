"""What travels: joins with parts, ids in shuffles."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from seriesmill import testbed as T
from seriesmill.functions import ids
from seriesmill.operators import normalize
from seriesmill.operators import quality as Q


@pytest.fixture
def small(spark, tmp_path):
    parts = [(k, "name", f"Brand#{k % 2}", "ECONOMY", 5, 1.0) for k in range(1, 5)]
    items = [(k, k, 1, 1, 2.0, 10.5, 0.0, 0.0, "N", "O", datetime(2000, 1, k)) for k in range(1, 4)]
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(
        items,
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_parts_meet_their_months_by_a_shuffled_join(spark, small):
    for df in (T.observations(spark, small), T.monthly_sales(spark, small), T.observations(spark, small, "marca")):
        assert "BroadcastHashJoin" not in planned(df)
    assert T.observations(spark, small).count() == 6


def test_entities_meet_values_by_a_shuffled_join(spark, small):
    values = spark.range(3).select(F.col("id").cast("string").alias("entity_id"))
    assert "SortMergeJoin" in planned(values.join(T.entities(spark, small), "entity_id"))
    nodes = T.entities(spark, small).where("marca = 'Brand#1'").select("entity_id", "ean")
    assert "BroadcastHashJoin [entity_id" not in planned(values.join(nodes, "entity_id"))
    assert T.entities(spark, small).count() == 3


def test_packed_ids_come_back_as_they_were(spark):
    texts = [None, "", "a", "ab", "AB", "abc", "x" * 31, "0" * 63, "0f" * 32, "é\0", "\x01ab"]
    rows = [(e, s, m) for e in texts for s in [*texts, "made"] for m in ("valor", None)]
    df = spark.createDataFrame(rows, "entity_id string, series_id string, measure string")
    made = F.when(F.col("series_id") == "made", ids.series_id(F.col("entity_id"), F.col("measure"))).otherwise(F.col("series_id"))
    df = df.withColumn("series_id", made)
    e, m = F.col("entity_id"), F.col("measure")
    packed = df.select("*", ids.packed(e).alias("p"), ids.packed_series(F.col("series_id"), e, m).alias("q"))
    back = packed.select("entity_id", "series_id", ids.unpacked(F.col("p")).alias("x"), ids.unpacked_series(F.col("q"), e, m).alias("y"))
    assert all(r.entity_id == r.x and r.series_id == r.y for r in back.collect())
    whole = ids.packed(F.lit("0f" * 32)), ids.packed_series(ids.series_id(F.lit("a"), F.lit("b")), F.lit("a"), F.lit("b"))
    assert [len(x) for x in spark.range(1).select(*whole).first()] == [33, 1]


def test_ids_travel_packed(spark):
    row = ("s" * 64, "valor", "e" * 64, date(2000, 1, 1), Decimal("1.00"), 1)
    obs = spark.createDataFrame([row, row], "series_id string, measure string, entity_id string, ds date, y_raw decimal(20,2), _order long")
    for out in (Q.dedup_sum(obs), Q.keep_first_duplicate(obs), Q.profile_duplicates(obs)):
        assert out.count() == 1
        sent = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
        assert sent and not any("entity_id#" in x or "series_id#" in x for x in sent)
    rows = obs.withColumn("ean", F.lit("1"))
    plan = normalize.dimension_conflicts(rows, ["ean"], "entity_id", "_order")._jdf.queryExecution().executedPlan().toString()
    assert not any("entity_id#" in x for x in plan.splitlines() if "hashpartitioning" in x)


def test_sold_parts_meet_parts_by_a_shuffled_join(spark, small):
    for grain in ("ean", "marca"):
        nodes = T.entities(spark, small, grain)
        assert "Broadcast" not in planned(nodes)
        assert nodes.count() == (3 if grain == "ean" else 2)
