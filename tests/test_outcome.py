"""Final rows in arrays against the row-per-date steps, and scenarios of runs at an upper level."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.q_hierarchy import rule
from seriesmill.config import ForecastConfig, RegressorSpec, Scenario, TreatmentPolicy
from seriesmill.functions.periods import shift_date
from seriesmill.operators import backtest, hierarchy, outcome, scenarios
from seriesmill.plans import forecast_run
from tests.test_methods import CONFIG, END, LEVELS, SEASONAL, SPARSE, STUDY, ZERO, frame, observations, regressor_rows, tree

SERIES = {"a1": SEASONAL, "a2": SPARSE, "b1": [20 + (i % 7) for i in range(60)], "b2": SEASONAL[-9:], "b3": [0.0] * 30, "b4": SEASONAL[-3:]}
DAYS = [shift_date(END, k) for k in range(1, 7)]
KEYS = ["node_id", "measure", "scenario_id", "ds", "model_alias"]


def same(left, right, columns, keys=KEYS):
    a = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in left.collect()}
    b = {tuple(r[k] for k in keys): [r[c] for c in columns] for r in right.collect()}
    assert set(a) == set(b) and a
    for key, row in a.items():
        for x, y in zip(row, b[key]):
            assert x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y, (key, row, b[key])


@pytest.fixture(scope="module")
def rows(spark):
    return frame(spark, SERIES, fitted=True).cache()


def test_limits_agree_with_the_joined_ones(spark, rows):
    cv = backtest.cv_predictions(rows)
    base = backtest.final_forecast(rows)
    whole = backtest.conformal_intervals(base, cv, 80, any_history=False)
    got = outcome.exploded(outcome.final_panel(rows, 80, 2))
    same(got, whole, ["yhat", "lo80", "hi80", "interval_method", "status", "clipped", "level", "entity_id"])
    assert got.columns == base.columns


def test_summary_agrees(spark, rows):
    values = forecast_run.Q.prepare(observations(spark, SERIES), STUDY, ZERO).values
    finals = outcome.final_panel(rows, 80, 2)
    assert outcome.summary(values, finals).first() == backtest.run_summary(values, outcome.exploded(finals)).first()


def test_scenarios_and_roll_up_agree(spark, rows):
    finals = outcome.final_panel(rows, 80, 2)
    sc = (
        Scenario("up", (rule("1", "up", "p", "unidades", "pulse", 0.5, DAYS[1], DAYS[2], 2, grupo=("A",)), rule("2", "up", "q", "unidades", "step", -0.2, DAYS[0]))),
        Scenario("tie", (rule("1", "tie", "p", "unidades", "step", 0.1, DAYS[0]), rule("2", "tie", "p", "unidades", "step", 0.2, DAYS[4]))),
        Scenario("clash", (rule("1", "clash", "p", "unidades", "step", 0.1, DAYS[0]),), {"r": {}}),
        Scenario("copy"),
    )
    more, issues = outcome.with_scenarios(finals, tree(spark), sc, DAYS, {"r": "p"})
    base = outcome.exploded(finals)
    plain, plain_issues, _ = scenarios.generate_scenarios(base, tree(spark), sc, DAYS, {"r": "p"}, with_base=True, own_dates=True)
    same(outcome.exploded(more), plain, ["yhat", "lo80", "hi80", "status"])
    assert sorted(map(tuple, issues.collect())) == sorted(map(tuple, plain_issues.collect()))
    bridge = hierarchy.node_bridge(tree(spark), LEVELS)
    up = outcome.roll_up(more, tree(spark), LEVELS, 6)
    same(up, hierarchy.reconcile_bottom_up(plain, bridge, LEVELS), ["yhat", "n_leaves", "status", "level", "reconciliation", "lo80"])


def test_series_that_end_earlier_meet_on_their_dates(spark):
    early = {"a1": SEASONAL[:-2] + [None, None], "a2": SEASONAL}
    policy = TreatmentPolicy(missing="keep_gaps")
    values = forecast_run.Q.prepare(observations(spark, early), STUDY, policy).values
    panel = forecast_run.P.train_panel(values, STUDY, CONFIG, forecast_run.P.calendar_folds(STUDY, CONFIG))
    finals = outcome.final_panel(backtest.forecast_frame(panel, STUDY, CONFIG, False), folds=2)
    up = outcome.roll_up(finals, tree(spark), LEVELS, 6).where("level = 'A' AND model_alias = 'Naive'").orderBy("ds").collect()
    assert [r["ds"] for r in up] == [shift_date(END, k) for k in range(-1, 7)]
    assert [r["n_leaves"] for r in up] == [1, 1, 2, 2, 2, 2, 1, 1]


def test_rounded_leaves_make_whole_parents(spark):
    rows = frame(spark, {"a1": [1.4] * 30, "a2": [2.4] * 30, "b1": [0.5] * 30}, fitted=False)
    finals = outcome.final_panel(rows, folds=2)
    up = outcome.roll_up(finals, tree(spark), LEVELS, 6, whole_units=True).where("model_alias = 'Naive'").collect()
    assert {(r["level"], r["yhat"]) for r in up} == {("A", 3.0), ("B", 0.0), ("Total", 3.0)}


def independent(spark, sc, series=None, level=0):
    cfg = replace(LEVELS, mode="independent", forecast_level=level)
    series = series or {"a1": SEASONAL, "a2": SEASONAL, "b1": SEASONAL}
    return forecast_run.run_forecast(observations(spark, series), tree(spark), replace(STUDY, measures=("unidades",)), ZERO, CONFIG, cfg, sc, fitted=False)


def test_a_rule_below_the_forecast_level_blocks_its_scenario(spark):
    deep = Scenario("deep", (rule("1", "deep", "p", "unidades", "step", 0.5, DAYS[2], None, 0, item=("a1",)),))
    out = independent(spark, (deep, Scenario("copy")))
    assert {r["scenario_id"] for r in out["predictions"].select("scenario_id").distinct().collect()} == {"base", "copy"}
    found = [(r["stage"], r["code"], r["severity"], r["subject"], r["n_cells"]) for r in out["issues"].collect()]
    assert found == [("scenario", "E_SCENARIO_PARTIAL_NODE", "error", "deep", 4)]


def test_rules_that_reach_all_leaves_alike_scale_the_node(spark):
    wide = Scenario("wide", (
        rule("1", "wide", "p", "unidades", "step", 0.5, DAYS[2], None, 0, item=("a1", "a2")),
        rule("2", "wide", "q", "unidades", "step", -0.5, DAYS[0], None, 0, grupo=("B",)),
    ))
    out = independent(spark, (wide,))
    assert out["issues"].count() == 0
    got = out["predictions"].where("model_alias = 'Naive'").collect()
    base = {(r["node_id"], r["ds"]): r["yhat"] for r in got if r["scenario_id"] == "base"}
    ratio = {(base[r["node_id"], r["ds"]], r["ds"]): r["yhat"] / base[r["node_id"], r["ds"]] for r in got if r["scenario_id"] == "wide"}
    one, two = SEASONAL[-1], 2 * SEASONAL[-1]
    assert {v for (b, _), v in ratio.items() if b == pytest.approx(one)} == {0.5}
    assert [ratio[b, d] for b, d in sorted(ratio, key=lambda k: k[1]) if b == pytest.approx(two)] == pytest.approx([1, 1, 1.5, 1.5, 1.5, 1.5])


def test_a_rate_of_zero_on_some_leaves_is_partial_too(spark):
    flat = Scenario("flat", (rule("1", "flat", "p", "unidades", "step", 0.0, DAYS[0], None, 0, item=("a1",)),))
    out = independent(spark, (flat,))
    assert [r["subject"] for r in out["issues"].collect()] == ["flat"]


def test_settings_are_checked_before_anything_is_read(spark):
    bad = Scenario("s", (rule("", "base", " ", "peso", "pulse", -1.0, date(2026, 5, 1), None, -1),))
    with pytest.raises(ValueError) as e:
        forecast_run.check_settings(STUDY, ForecastConfig(horizon=6), replace(LEVELS, forecast_level=7), (bad,), (RegressorSpec("r", "a"), RegressorSpec("r", "b")))
    for text in ("rule without id", "base scenario", "without family", "unknown measure", "-100%", "needs an end", "below zero", "level 7", "two regressors"):
        assert text in str(e.value)


def test_data_issues_come_with_the_run(spark):
    shallow = replace(LEVELS, levels=(("grupo",),))
    out = forecast_run.run_forecast(
        observations(spark, {"a1": SEASONAL, "a2": SEASONAL, "b1": SEASONAL}), tree(spark), replace(STUDY, measures=("unidades",)), ZERO, CONFIG, shallow, (),
        (RegressorSpec("r", "promo"),), regressor_rows(spark, False), fitted=False,
    )
    found = {(r["stage"], r["code"], r["subject"]) for r in out["issues"].collect()}
    assert ("hierarchy", "E_HIERARCHY_INVALID", "A") in found
    assert ("regressor", "E_REGRESSOR_INCOMPLETE_FUTURE", "r") in found
