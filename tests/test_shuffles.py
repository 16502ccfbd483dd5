"""What travels between tasks on the way from observations to views, and that results stay those of the plain forms."""

from datetime import date
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesmill import testbed as T
from seriesmill.config import HierarchyConfig, TreatmentPolicy
from seriesmill.functions import ids
from seriesmill.operators import backtest as FC
from seriesmill.operators import hierarchy as H
from seriesmill.operators import panel as P
from seriesmill.operators import quality as Q
from seriesmill.plans import views as V

OBSERVED = "series_id string, measure string, entity_id string, ds date, y_raw decimal(20,2), _order long"
JAN, FEB = date(2001, 1, 1), date(2001, 2, 1)
HEX = "ab" * 32


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> list[str]:
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeats, nulls in every column, ids that aren't hex, one series id of two entities, equal orders."""
    rows = [
        (HEX, "valor", HEX, JAN, Decimal("3.00"), 2),
        (HEX, "valor", HEX, JAN, Decimal("1.00"), 2),
        (HEX, "valor", HEX, JAN, Decimal("9.00"), 5),
        (HEX, "valor", HEX, FEB, None, 1),
        (HEX, "valor", HEX, FEB, Decimal("4.00"), 1),
        (HEX, "valor", "other", JAN, Decimal("5.00"), 3),
        (HEX.upper(), "valor", HEX.upper(), JAN, Decimal("6.00"), None),
        (HEX.upper(), "valor", HEX.upper(), JAN, Decimal("2.00"), 1),
        (None, "valor", "x", JAN, Decimal("7.00"), 1),
        ("s", None, None, None, Decimal("8.00"), 1),
        ("s", None, None, None, None, None),
        ("s", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows * 2, OBSERVED).repartition(3)


def listed(df):
    return sorted(map(repr, map(tuple, df.select(*Q.SERIES, "ds", "y_raw").collect())))


def test_rows_that_met_give_the_same_sums(odd):
    met = Q.together(odd, ["y_raw"])
    assert listed(met) == listed(odd)
    assert listed(Q.dedup_sum(met, met=True)) == listed(Q.dedup_sum(odd))


def test_first_of_repeats_against_a_plain_pass(odd):
    def place(r):
        return tuple((v is not None, 0 if v is None else v) for v in (r["_order"], r["y_raw"]))

    best = {}
    for r in odd.collect():
        key = tuple(r[c] for c in (*Q.SERIES, "ds"))
        best[key] = min(best.get(key, r), r, key=place)
    want = sorted(repr((*key, r["y_raw"])) for key, r in best.items())
    assert listed(Q.keep_first_duplicate(odd)) == want
    assert listed(Q.keep_first_duplicate(Q.together(odd, ["y_raw", "_order"]), met=True)) == want


def test_first_of_repeats_sorts_nothing(odd):
    assert "Sort" not in plan(Q.keep_first_duplicate(odd))


def test_lists_of_a_series_are_bounded(monkeypatch):
    monkeypatch.setattr(Q, "RUN_ROWS", 4)
    n = 11
    rows = {"series_id": ["a"] * n, "measure": ["m"] * n, "entity_id": [b"e"] * n, "ds": [JAN] * n, "y_raw": list(range(n))}
    out = [b for b in Q._runs(iter([pa.RecordBatch.from_pydict(rows)]))]
    assert [len(v) for b in out for v in b.column("ds").to_pylist()] == [4, 4, 3]
    assert [v for b in out for x in b.column("y_raw").to_pylist() for v in x] == list(range(n))
    assert not [*Q._runs(iter([]))]


def test_panel_shuffles_series_once_and_as_lists(spark, odd):
    values = Q.prepare(odd, T.STUDY, TreatmentPolicy(duplicates="sum", missing="zero")).values
    arrays = P.series_arrays(values)
    assert len(shuffles(arrays)) == 1
    assert "hashpartitioning(series_id" in shuffles(arrays)[0]
    assert "MapInArrow" in plan(arrays)


def scored(spark):
    rows = [
        (f"n{i}", m, f"e{i}", a, i % 2, date(2001, 1 + k, 1), float(i + k), float(i + k + len(a)), True)
        for i in range(6) for m in ("valor", "unidades") for a in ("Naive", "TSB") for k in range(2)
    ]
    rows.append((None, "valor", "e0", "Naive", 0, JAN, 1.0, 2.0, True))
    rows.append(("n1", None, "e1", "Naive", 0, JAN, 1.0, 2.0, True))
    names = "node_id string, measure string, entity_id string, model_alias string, fold int, cutoff date, y_actual double, yhat double, evaluated boolean"
    return spark.createDataFrame(rows, names)


def test_rows_of_pairs_are_those_of_a_semi_join(spark):
    rows = scored(spark)
    keys = ["node_id", "measure", "model_alias"]
    pairs = rows.where("NOT (node_id = 'n2' AND model_alias = 'TSB') AND coalesce(node_id, '') <> 'n3'").select(*keys)
    want = rows.join(pairs, keys, "left_semi").select(*rows.columns)
    found = FC.of_pairs(rows, pairs)
    assert found.columns == rows.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def test_rows_of_pairs_stay_where_their_series_lie(spark):
    lying = scored(spark).repartition(4, "node_id")
    picked = lying.where("yhat > 3").select("node_id", "measure", "model_alias").distinct()
    text = plan(FC.of_pairs(lying, picked))
    assert len([line for line in text.splitlines() if "Exchange" in line]) == 2
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_rows_look_entities_up_without_a_sort(spark):
    rows = scored(spark).selectExpr("*", "'base' AS scenario_id", "cutoff AS ds")
    ents = spark.createDataFrame([(f"e{i}", f"t{i % 2}", f"m{i}") for i in range(6)], "entity_id string, tipo string, marca string")
    ents = ents.hint("merge")
    hierarchy = HierarchyConfig(levels=(("tipo",), ("tipo", "marca")))
    bridge = H.node_bridge(ents, hierarchy)
    stored = H.reconcile_bottom_up(rows, bridge, hierarchy)
    for df in (V._items(rows, ents, "tipo", None), H.grain_rollup(rows, ents, "tipo", ["measure"], "yhat"), stored):
        assert "ShuffledHashJoin" in plan(df)
    plain = rows.join(ents, "entity_id").groupBy("tipo", "measure").agg(F.sum("yhat").alias("s"))
    got = H.grain_rollup(rows, ents, "tipo", ["measure"], "yhat")
    assert sorted(map(repr, map(tuple, got.select("grain", "measure", "yhat").collect()))) == sorted(map(repr, map(tuple, plain.collect())))


def test_made_series_ids_come_back(spark):
    rows = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("entity_id"), F.lit("valor").alias("measure"), F.lit(JAN).alias("ds"))
    rows = rows.withColumn("series_id", ids.series_id(F.col("entity_id"), F.col("measure"))).withColumn("y_raw", F.lit(Decimal("1.00")))
    assert listed(Q.together(rows, ["y_raw"])) == listed(rows)
