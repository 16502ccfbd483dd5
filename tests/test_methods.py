"""Invariants and brute-force checks of preparation, methods, hierarchy and scenarios."""

from dataclasses import replace
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.q_hierarchy import rule
from seriesmill.config import (
    ForecastConfig,
    HierarchyConfig,
    MappingConfig,
    RegressorSpec,
    Scenario,
    StudyConfig,
    TreatmentPolicy,
)
from seriesmill.functions import ids
from seriesmill.functions.periods import shift_date
from seriesmill.operators import fitters, backtest, global_trees, hierarchy, mat, normalize, panel, quality, regressors, scenarios
from seriesmill.plans import exports, forecast_run, views
from seriesmill.sources import scan

END = date(2025, 12, 1)
STUDY = StudyConfig("t", ("grupo", "item"), END)
ZERO = TreatmentPolicy(duplicates="sum", missing="zero")
CONFIG = ForecastConfig(horizon=6, cv_windows=2)
MONTHS = [shift_date(END, k) for k in range(-59, 1)]


def observations(spark, series):
    """series: name → values ending at END (None leaves a gap)."""
    rows = []
    for name, values in series.items():
        for ds, y in zip(MONTHS[-len(values):], values):
            if y is not None:
                rows.append((name, "unidades", name, ds, float(y)))
    df = spark.createDataFrame(rows, "series_id string, measure string, entity_id string, ds date, y double")
    return df.select("series_id", "measure", "entity_id", "ds", F.col("y").cast("decimal(20,2)").alias("y_raw")).withColumn(
        "_order", F.monotonically_increasing_id()
    )


def frame(spark, series, config=CONFIG, fitted=True):
    values = quality.prepare(observations(spark, series), STUDY, ZERO).values
    rows = panel.train_panel(values, STUDY, config, panel.calendar_folds(STUDY, config))
    return backtest.forecast_frame(rows, STUDY, config, fitted)


def finals(spark, series, fitted=True):
    rows = backtest.final_forecast(frame(spark, series, fitted=fitted)).orderBy("ds").collect()
    out = {}
    for r in rows:
        out.setdefault((r["node_id"], r["model_alias"]), []).append(r["yhat"])
    return out


RNG = np.random.default_rng(7)
SEASONAL = [round(100 + 30 * np.sin(2 * np.pi * i / 12) + i, 2) for i in range(60)]
SPARSE = [int(v) if u > 0.7 else 0 for v, u in zip(RNG.integers(1, 20, 48), RNG.random(48))]


def test_constant_and_linear_series(spark):
    got = finals(spark, {"flat": [50] * 40, "line": [10 + 2 * i for i in range(40)]})
    for (node, alias), values in got.items():
        assert len(values) == 6
        if node == "flat" and alias not in ("CrostonSBA",):
            assert values == pytest.approx([50] * 6, rel=1e-4), alias
    ahead = [10 + 2 * (39 + k) for k in range(1, 7)]
    assert got["line", "RegLinearDrift"] == pytest.approx(ahead)
    assert got["line", "Holt"] == pytest.approx(ahead, rel=1e-6)
    assert got["line", "AutoAR"] == pytest.approx(ahead, rel=1e-3)


def test_seasonal_methods_follow_the_cycle(spark):
    got = finals(spark, {"s": SEASONAL})
    truth = [100 + 30 * np.sin(2 * np.pi * i / 12) + i for i in range(60, 66)]
    assert got["s", "SeasonalNaive"] == SEASONAL[48:54]
    for alias in ("AutoETS", "AutoAR", "AutoTheta"):
        assert np.abs(np.array(got["s", alias]) - truth).max() < 12, alias


def brute_croston(ys, a=0.1):
    z = q = None
    gap = 1
    for y in ys:
        if y > 0:
            z = y if z is None else a * y + (1 - a) * z
            q = gap if q is None else a * gap + (1 - a) * q
            gap = 1
        else:
            gap += 1
    return z / q * (1 - a / 2)


def brute_tsb(ys, a=0.2):
    p = z = None
    for y in ys:
        d = float(y > 0)
        p = d if p is None else a * d + (1 - a) * p
        if y > 0:
            z = y if z is None else a * y + (1 - a) * z
    return p * z


def test_intermittent_methods_against_loops(spark):
    got = finals(spark, {"i": SPARSE}, fitted=False)
    first = next(i for i, v in enumerate(SPARSE) if v >= 0)
    assert got["i", "CrostonSBA"] == pytest.approx([brute_croston(SPARSE[first:])] * 6)
    assert got["i", "TSB"] == pytest.approx([brute_tsb(SPARSE[first:])] * 6)


def test_no_leak_from_after_the_cutoff(spark):
    changed = SEASONAL[:-6] + [v * 10 for v in SEASONAL[-6:]]
    first = panel.calendar_folds(STUDY, CONFIG)[0].cutoff

    def fold(series):
        rows = backtest.cv_predictions(frame(spark, {"s": series})).where(F.col("cutoff") == F.lit(first))
        return {(r["model_alias"], r["ds"]): r["yhat"] for r in rows.collect()}

    a, b = fold(SEASONAL), fold(changed)
    assert a.keys() == b.keys() and len(a) > 30
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_eligibility_zero_short_and_floor(spark):
    series = {"zero": [0] * 30, "short": [5, 6, 7], "down": [100 - 9 * i for i in range(12)]}
    rows = frame(spark, series, fitted=False).select("series_id", "model_alias", "failure_reason").distinct().collect()
    by = {}
    for r in rows:
        by.setdefault(r["series_id"], set()).add(r["model_alias"])
    assert by["zero"] == {"ZeroBaseline"}
    assert by["short"] == {"Naive"}
    assert "SeasonalNaive" in by["down"]
    got = finals(spark, series, fitted=False)
    assert got["down", "RegLinearDrift"] == [0.0] * 6 or min(got["down", "RegLinearDrift"]) >= 0.0
    scores = backtest.select_model(backtest.score_models(backtest.cv_predictions(frame(spark, series, fitted=False))), CONFIG)
    chosen = {r["node_id"]: r["selection_reason"] for r in scores.where("selected").collect()}
    assert chosen["zero"] == "perfil_zero_total"


def test_user_list_selects_every_method(spark):
    config = replace(CONFIG, models=("Naive", "HistoricAverage"))
    scores = backtest.score_models(backtest.cv_predictions(frame(spark, {"s": SEASONAL}, config)))
    rows = backtest.select_model(scores, config).collect()
    assert {(r["model_alias"], r["selected"], r["selection_reason"]) for r in rows} == {
        ("Naive", True, "usuario"), ("HistoricAverage", True, "usuario"),
    }


def test_data_driven_windows_equal_the_calendar(spark):
    values = quality.prepare(observations(spark, {"s": SEASONAL}), STUDY, ZERO).values
    for wanted in (1, 2, 4):
        config = replace(CONFIG, cv_windows=wanted)
        found = panel.collect_folds(panel.cv_windows(values, STUDY, config))
        assert found == panel.calendar_folds(STUDY, config)


def test_fill_policies_duplicates_and_winsor(spark):
    obs = observations(spark, {"g": [10, None, 30, None], "d": [1, 2, 3, 4]})
    extra = obs.where("series_id = 'd'").withColumns({"_order": F.col("_order") + 10**6, "y_raw": F.lit(100).cast("decimal(20,2)")})
    both = obs.unionByName(extra)

    def ys(policy, sid):
        rows = quality.prepare(both, STUDY, policy).values.where(F.col("series_id") == sid).orderBy("ds").collect()
        return [r["y"] for r in rows]

    assert ys(TreatmentPolicy(missing="zero"), "g") == [10, 0, 30, 0]
    assert ys(TreatmentPolicy(missing="ffill"), "g") == [10, 10, 30, 30]
    assert ys(TreatmentPolicy(missing="keep_gaps"), "g") == [10, 30]
    assert ys(TreatmentPolicy(missing="exclude_series"), "g") == []
    assert ys(TreatmentPolicy(), "d") == [1, 2, 3, 4]
    assert ys(TreatmentPolicy(duplicates="sum"), "d") == [101, 102, 103, 104]
    capped = quality.prepare(both, STUDY, TreatmentPolicy(outliers="winsorize", upper_quantile=0.5)).values
    rows = capped.where("series_id = 'd'").orderBy("ds").collect()
    assert [r["y"] for r in rows] == [1, 2, 2.5, 2.5]
    assert [r["was_adjusted"] for r in rows] == [False, False, True, True]
    gone = quality.prepare(both, STUDY, TreatmentPolicy(missing="exclude_series")).excluded.collect()
    assert [r["series_id"] for r in gone] == ["g"]


def test_gap_before_the_grid_start(spark):
    early = shift_date(MONTHS[0], -2)
    rows = [("s", "unidades", "s", early, 5.0), ("s", "unidades", "s", MONTHS[2], 7.0)]
    df = spark.createDataFrame(rows, "series_id string, measure string, entity_id string, ds date, y double")
    df = df.select("series_id", "measure", "entity_id", "ds", F.col("y").cast("decimal(20,2)").alias("y_raw"), F.lit(0).alias("_order"))
    zero = quality.prepare(df, STUDY, ZERO).values.orderBy("ds").collect()
    assert [r["y"] for r in zero][:4] == [0, 0, 7, 0] and len(zero) == 60
    kept = quality.prepare(df, STUDY, replace(ZERO, missing="ffill")).values.orderBy("ds").collect()
    assert kept[0]["ds"] == MONTHS[2] and len(kept) == 58


def test_outliers_against_numpy(spark):
    ys = [10.0, 11, 9, 10, 12, 8, 10, 500, 11, 9]
    values = quality.prepare(observations(spark, {"o": ys}), STUDY, ZERO).values
    flagged = [r["y"] for r in quality.outlier_flags(values, 12).where("is_outlier").collect()]
    dev = np.abs(np.array(ys) - np.median(ys))
    assert flagged == [y for y, d in zip(ys, dev) if d > 3 * 1.4826 * np.median(dev)] == [500.0]


def tree(spark):
    rows = [("A", "a1"), ("A", "a2"), ("B", "b1")]
    df = spark.createDataFrame(rows, "grupo string, item string")
    return df.select(
        F.col("item").alias("entity_id"), "grupo", "item",
        F.create_map(F.lit("grupo"), F.col("grupo"), F.lit("item"), F.col("item")).alias("dims"),
    )


LEVELS = HierarchyConfig((("grupo",), ("grupo", "item")), include_total=True)


def test_parents_are_the_sum_of_children(spark):
    series = {"a1": SEASONAL, "a2": SPARSE, "b1": [5] * 30}
    predictions = backtest.final_forecast(frame(spark, series, fitted=False))
    bridge = hierarchy.node_bridge(tree(spark), LEVELS)
    up = hierarchy.reconcile_bottom_up(predictions, bridge, LEVELS)
    total = up.where("level = 'Total' AND model_alias = 'Naive'").agg(F.sum("yhat")).first()[0]
    leaves = predictions.where("model_alias = 'Naive'").agg(F.sum("yhat")).first()[0]
    assert total == pytest.approx(leaves)
    statuses = {(r["level"], r["model_alias"]): r["status"] for r in up.collect()}
    assert statuses["A", "Naive"] == "ok"
    partial = hierarchy.reconcile_bottom_up(predictions.where("node_id <> 'a2'"), bridge, LEVELS)
    assert {r["status"] for r in partial.where("level IN ('A', 'Total')").collect()} == {"partial_coverage"}


def test_annual_step_golden(spark):
    r = rule("r", "s", "price", "valor", "annual_step", 0.05, date(2026, 4, 1))
    days = [date(2026, 3, 1), date(2026, 4, 1), date(2027, 3, 1), date(2027, 4, 1)]
    df = spark.createDataFrame([(d,) for d in days], "ds date")
    got = [x[0] for x in df.orderBy("ds").select(scenarios.rule_factor(r, F.col("ds"))).collect()]
    assert got == pytest.approx([1.0, 1.05, 1.05, 1.1025])


def test_inline_and_table_factors_agree(spark):
    predictions = backtest.final_forecast(frame(spark, {"a1": SEASONAL, "a2": SEASONAL, "b1": SEASONAL}, fitted=False))
    days = [shift_date(END, k) for k in range(1, 7)]
    sc = Scenario("s", (
        rule("1", "s", "p", "unidades", "pulse", 0.5, days[1], days[2], 2, grupo=("A",)),
        rule("2", "s", "p", "unidades", "step", -0.2, days[0], None, 1),
        rule("3", "s", "q", "unidades", "step", 0.1, days[3], None, 0, ("a2",), item=("a1", "a2")),
        rule("4", "s", "q", "valor", "step", 9.0, days[0]),
    ))
    key = ["node_id", "ds", "model_alias"]
    a = scenarios.apply_scenario(predictions, tree(spark), (sc,))
    b = scenarios.factor_product(scenarios.compile_assumptions(tree(spark), days, sc.rules)).withColumnRenamed("entity_id", "node_id")
    found = a.join(b.select("node_id", "ds", "measure", F.col("factor").alias("y")), ["node_id", "ds", "measure"], "left")
    joined = found.select(*key, F.col("factor").alias("x"), F.coalesce("y", F.lit(1.0)).alias("y"))
    assert joined.count() == predictions.count()
    assert joined.where("abs(x - y) > 1e-12").count() == 0
    a1 = a.where("node_id = 'a1' AND model_alias = 'Naive'").orderBy("ds").collect()
    assert [r["factor"] for r in a1] == pytest.approx([0.8, 1.5, 1.5, 0.88, 0.88, 0.88])


def test_ties_and_clashes_block_a_scenario(spark):
    predictions = backtest.final_forecast(frame(spark, {"a1": SEASONAL}, fitted=False))
    days = [shift_date(END, k) for k in range(1, 7)]
    tied = Scenario("t", (rule("1", "t", "p", "unidades", "step", 0.1, days[0]), rule("2", "t", "p", "unidades", "step", 0.2, days[4])))
    clash = Scenario("c", (rule("1", "c", "p", "unidades", "step", 0.1, days[0]),), {"r": {}})
    out, issues, _ = scenarios.generate_scenarios(predictions, tree(spark), (tied, clash, Scenario("copy")), days, {"r": "p"})
    assert {r["scenario_id"] for r in out.select("scenario_id").distinct().collect()} == {"copy"}
    assert {(r["scenario_id"], r["code"]) for r in issues.collect()} == {
        ("t", "E_SCENARIO_PRIORITY_TIE"), ("c", "E_SCENARIO_REG_FAMILY_DUP"),
    }


def test_long_rule_lists(spark):
    days = [shift_date(END, 1)]
    many = tuple(rule(str(i), "s", f"f{i}", "unidades", "step", 0.0, days[0]) for i in range(300))
    assert scenarios.rule_expand(tree(spark), days, many).count() == 3 * len(many)


def test_rules_follow_the_dates_of_the_rows(spark):
    """A series that ends early gets its factors on its own dates, with few rules or with many."""
    early = {"a1": SEASONAL[:-3]}
    values = quality.prepare(observations(spark, early), STUDY, TreatmentPolicy(missing="keep_gaps")).values
    rows = backtest.final_forecast(backtest.forecast_frame(panel.train_panel(values, STUDY, CONFIG, []), STUDY, CONFIG, False))
    one = (rule("1", "s", "p", "unidades", "step", 0.5, shift_date(END, -12)),)
    many = one + tuple(rule(f"n{k}", "s", f"n{k}", "unidades", "step", 0.0, END) for k in range(100))
    for rules in (one, many):
        out = scenarios.apply_scenario(rows, tree(spark), (Scenario("s", rules),)).where("measure = 'unidades'")
        assert out.count() and out.where("abs(factor - 1.5) > 1e-9").count() == 0


def test_rates_that_leave_nothing_are_ignored(spark):
    days = [shift_date(END, 1)]
    rules = (rule("1", "s", "p", "unidades", "step", -1.0, days[0]), rule("2", "s", "p", "unidades", "step", 0.5, days[0]))
    assert {r["rule_id"] for r in scenarios.compile_assumptions(tree(spark), days, rules).collect()} == {"2"}


def test_dates_between_periods_are_not_lost_silently(spark):
    """Monthly rows in a quarterly study: every grid period keeps its own value, the rest are issues."""
    study = StudyConfig("q", ("item",), history_end=END, history_periods=8, model_frequency="quarterly")
    months = [shift_date(END, k - 11) for k in range(12)]
    rows = spark.createDataFrame([("s", "s", "unidades", d, float(k)) for k, d in enumerate(months)], "entity_id string, series_id string, measure string, ds date, y_raw double")
    dense = quality.densify(rows, study).orderBy("ds").collect()
    assert [(r["ds"], r["y"]) for r in dense] == [(months[k], float(k)) for k in (2, 5, 8, 11)]
    assert quality.off_grid(rows, study).count() == 8


def test_many_folds_are_counted(spark):
    rows = [("n", "unidades", "Naive", k, True, 1.0, 2.0, False, False) for k in range(70)]
    frame_ = spark.createDataFrame(rows, "node_id string, measure string, model_alias string, fold int, evaluated boolean, y_actual double, yhat double, all_zero boolean, mostly_zero boolean")
    for c in [c for c in backtest.NODE if c not in frame_.columns]:
        frame_ = frame_.withColumn(c, F.lit("x"))
    assert backtest.score_models(frame_).first()["n_folds"] == 70


def test_mat_positions_golden(spark):
    values = quality.prepare(observations(spark, {"s": SEASONAL}), STUDY, ZERO).values
    rows = views.leaf_history(values).select("node_id", "measure", "ds", "y")
    assert mat.mat_history(rows).count() == 49
    gappy = rows.where(F.col("ds") != F.lit(MONTHS[30]))
    assert mat.mat_history(gappy).count() == 49 - 12



def test_chosen_history_takes_a_table_of_ids(spark):
    """Nodes and series asked for by a table, with a null, a copy and an id that nothing has."""
    day = date(2026, 1, 1)
    values = spark.createDataFrame(
        [("e1", "s1", "valor", day, 1.0, True, False), ("e2", "s2", "valor", day, 2.0, False, False), ("e3", "s3", "valor", day, 4.0, True, True)],
        "entity_id string, series_id string, measure string, ds date, y double, observed boolean, was_adjusted boolean",
    )
    above = spark.createDataFrame([("e1", ["n1"]), ("e2", ["n1"]), ("e3", ["n2"])], "entity_id string, ancestors array<string>")
    ids = ("n1", "s3", "s3", "none", None)
    asked = spark.createDataFrame([(i,) for i in ids], "node_id string")
    want = [("n1", "valor", day, 3.0, False, False), ("s3", "valor", day, 4.0, True, True)]
    for given in (asked, ids):
        assert sorted(tuple(r) for r in views.chosen_history(values, above, given).collect()) == want
    assert views.chosen_history(values, above, ()).count() == 0

def test_global_model(spark):
    series = {f"s{i}": [round(20 + i + 5 * np.sin(j / 2 + i), 2) for j in range(40)] for i in range(25)}
    values = quality.prepare(observations(spark, series), STUDY, ZERO).values
    rows = panel.train_panel(values, STUDY, CONFIG, [])
    trained = global_trees.train_global_model(values, "unidades", 12, iterations=3)
    got = global_trees.forecast_global(rows, trained, 12, 6).collect()
    assert trained.status == "ok" and len(got) == 25
    assert all(len(r["raw"]) == 6 and min(r["raw"]) >= 0 for r in got)
    few = global_trees.train_global_model(values.where("series_id < 's11'"), "unidades", 12, iterations=3)
    assert few.status == "below_minimum"
    assert global_trees.forecast_global(rows, few, 12, 6).first()["failure_reason"] == "below_minimum"


def regressor_rows(spark, future=True):
    rows = [("r", d, float(i % 7), False) for i, d in enumerate(MONTHS)]
    if future:
        rows += [("r", shift_date(END, k), float(k), True) for k in range(1, 7)]
    return spark.createDataFrame(rows, "regressor_id string, ds date, value double, is_future boolean")


def test_exogenous_recovers_a_linear_effect(spark):
    ys = [round(50 + 4 * (i % 7), 2) for i in range(60)]
    values = quality.prepare(observations(spark, {"a1": ys, "b1": ys}), STUDY, ZERO).values
    specs = (RegressorSpec("r", "promo", {"grupo": ("A",)}),)
    reg = regressor_rows(spark)
    days = [shift_date(END, k) for k in range(1, 7)]
    ahead = regressors.regressor_future(reg, specs, days, END)
    rows = regressors.exogenous_panel(values, tree(spark), reg, ahead, specs, STUDY, CONFIG, [])
    got = {r["series_id"]: r for r in regressors.ar_exog(rows, 12).collect()}
    assert got["a1"]["raw"] == pytest.approx([50 + 4 * k for k in range(1, 7)], rel=1e-2)
    assert got["b1"]["failure_reason"] == "regressor_unavailable"
    none = regressors.regressor_future(regressor_rows(spark, False), specs, days, END)
    rows = regressors.exogenous_panel(values, tree(spark), regressor_rows(spark, False), none, specs, STUDY, CONFIG, [])
    why = {r["series_id"]: r["failure_reason"] for r in regressors.ar_exog(rows, 12).collect()}
    assert why["a1"] == "regressor_future_unavailable"


def test_collinear_regressors_of_either_sign(spark):
    rows = [("a", d, float(i), False) for i, d in enumerate(MONTHS)] + [("b", d, -2.0 * i, False) for i, d in enumerate(MONTHS)]
    values = spark.createDataFrame(rows, "regressor_id string, ds date, value double, is_future boolean")
    specs = (RegressorSpec("a", "a", fill_policy="explicit_hold"), RegressorSpec("b", "b", fill_policy="explicit_hold"))
    codes = [r["code"] for r in regressors.regressor_validate(values, specs, []).collect()]
    assert codes == ["E_REGRESSOR_COLLINEAR"]


def test_fitter_failure_keeps_a_row(spark):
    def broken(y, h, season):
        return np.full((y.shape[0], h), np.nan)

    values = quality.prepare(observations(spark, {"s": SEASONAL}), STUDY, ZERO).values
    rows = panel.train_panel(values, STUDY, CONFIG, panel.calendar_folds(STUDY, CONFIG))
    got = fitters.fit_panel(rows, {"broken": broken}, 12).collect()
    assert len(got) == 3 and all(r["fits"]["broken"] is None for r in got)


def test_whole_run_with_everything(spark):
    series = {"a1": SEASONAL, "a2": SPARSE, "b1": [20 + (i % 7) for i in range(60)]}
    days = [shift_date(END, k) for k in range(1, 7)]
    sc = (Scenario("up", (rule("1", "up", "p", "unidades", "step", 0.1, days[0]),)), Scenario("what", (), {"r": {days[0]: 3.0}}))
    out = forecast_run.run_forecast(
        observations(spark, series), tree(spark), replace(STUDY, measures=("unidades",)), ZERO, CONFIG, LEVELS, sc,
        (RegressorSpec("r", "promo"),), regressor_rows(spark), keep_frame=True,
    )
    names = {r["scenario_id"] for r in out["predictions"].select("scenario_id").distinct().collect()}
    assert names == {"base", "up", "what"}
    assert out["summary"].first()["status"] == "completed"
    keys = ["node_id", "measure", "scenario_id", "ds", "model_alias"]
    assert out["predictions"].groupBy(*keys).count().where("count > 1").count() == 0
    assert out["aggregates"].groupBy(*keys).count().where("count > 1").count() == 0
    assert "AutoAR_X" in {r["model_alias"] for r in out["scores"].collect()}
    assert out["nodes"].where("level = 'Total'").first()["n_entities"] == 3


def test_independent_mode_forecasts_the_level(spark):
    series = {"a1": SEASONAL, "a2": SEASONAL, "b1": SEASONAL}
    cfg = replace(LEVELS, mode="independent", forecast_level=0)
    out = forecast_run.run_forecast(observations(spark, series), tree(spark), STUDY, ZERO, CONFIG, cfg, fitted=False)
    naive = out["predictions"].where("model_alias = 'Naive'").select("yhat").distinct().collect()
    assert sorted(r["yhat"] for r in naive) == pytest.approx([SEASONAL[-1], 2 * SEASONAL[-1]])


def test_gap_policy_uses_windows_from_the_data(spark):
    series = {"s": SEASONAL[:20] + [None] + SEASONAL[21:]}
    out = forecast_run.run_forecast(
        observations(spark, series), tree(spark), STUDY, TreatmentPolicy(missing="keep_gaps"), CONFIG, fitted=False
    )
    assert out["cv"].where("evaluated").count() > 0


def test_messy_long_rows(spark):
    rows = [
        (1, "A", "Mol", "0123", "2026-07", "100", "1500,00"),
        (2, "", "", "", "2026-07", "1", "1"),
        (3, "A", "Mol", "0123", "2026-13", "1", "1"),
        (4, "A", "Other", "0123", "2026-08", "1,5", "R$ 1.234,56"),
        (5, "A", "Mol", "0123", "2026-09", "n/a", "-"),
    ]
    df = spark.createDataFrame(rows, "n long, classe string, molecula string, ean string, periodo string, un string, val string")
    mapping = MappingConfig(
        ("classe", "ean"), {"classe": "classe", "molecula": "molecula", "ean": "ean"}, {"unidades": "un", "valor": "val"}, "periodo"
    )
    out = normalize.normalize_long(df, STUDY, mapping, F.concat(F.lit("r"), F.col("n")), F.col("n"))
    found = sorted((r["code"], r["source_row_id"]) for r in out.issues.collect())
    assert found == [
        ("E_DATE_AMBIGUOUS", "r3"), ("E_KEY_EMPTY", "r2"), ("E_ROW_INVALID", "r5"), ("E_ROW_INVALID", "r5"), ("E_UNITS_FRACTION", "r4"),
    ]
    values = sorted((r["source_row_id"], r["measure"], float(r["y_raw"])) for r in out.observations.collect())
    assert values == [("r1", "unidades", 100.0), ("r1", "valor", 1500.0), ("r4", "valor", 1234.56)]
    entity = out.entities.collect()
    assert len(entity) == 1 and '"molecula":"Mol"' in entity[0]["dimensions_json"]
    assert out.source_rows.count() == 5
    keyed = df.where("ean <> ''").withColumn("eid", ids.entity_id([("classe", F.col("classe")), ("ean", F.col("ean"))]))
    clash = normalize.dimension_conflicts(keyed, ["molecula"], "eid", "n").collect()
    assert [(r["first_value"], r["conflict_rows"]) for r in clash] == [("Mol", 1)]


def test_scratch_tables_hold_no_hex_ids(spark):
    df = spark.createDataFrame([(1, "0123", "2026-07", "100"), (2, "0456", "2026-08", "7")], "n long, ean string, periodo string, un string")
    mapping = MappingConfig(("ean",), {"ean": "ean"}, {"unidades": "un"}, "periodo")
    out = normalize.normalize(df, STUDY, mapping, F.concat(F.lit("r"), F.col("n")), F.col("n"))
    stored = spark.read.parquet(*out.observations.inputFiles())
    assert dict(stored.dtypes)["entity_id"] == "binary" and "series_id" not in stored.columns
    entity = {r["key_json"]: r["entity_id"] for r in out.entities.collect()}
    plain = df.select(ids.entity_id([("ean", F.col("ean"))]).alias("e")).select("e", ids.series_id(F.col("e"), F.lit("unidades")).alias("s"))
    made = {r["e"]: r["s"] for r in plain.collect()}
    assert sorted(entity) == ['{"ean":"0123"}', '{"ean":"0456"}'] and set(entity.values()) == set(made)
    found = [(r["source_row_id"], r["series_id"], float(r["y_raw"])) for r in out.observations.orderBy("_order").collect()]
    assert found == [("r1", made[entity['{"ean":"0123"}']], 100.0), ("r2", made[entity['{"ean":"0456"}']], 7.0)]


def test_entities_keep_any_id(spark):
    rows = [("abcd", 2, "x"), ("abcd", 1, "y"), ("not hex", 3, "z"), (None, 4, "w")]
    df = spark.createDataFrame(rows, "entity_id string, _order long, v string").select(
        "entity_id", F.lit("{}").alias("key_json"), F.create_map(F.lit("v"), F.col("v")).alias("dims"), F.create_map(F.lit("a"), F.lit("b")).alias("attrs"), "_order"
    )
    found = normalize.build_entities(df)
    assert {(r["entity_id"], r["dimensions_json"]) for r in found.collect()} == {("abcd", '{"v":"y"}'), ("not hex", '{"v":"z"}'), (None, '{"v":"w"}')}
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()


def test_digest_ignores_order_and_sees_values(spark):
    obs = observations(spark, {"s": SEASONAL, "t": SPARSE})
    a = normalize.content_digest(obs).first()
    assert a == normalize.content_digest(obs.orderBy(F.desc("ds")).repartition(5)).first()
    assert a != normalize.content_digest(obs.withColumn("y_raw", (F.col("y_raw") + 1).cast("decimal(20,2)"))).first()


def test_autodetect_needs_twelve_periods(spark):
    names = ["classe", "produto"] + [f"2025{m:02d}" for m in range(1, 13)]
    wide = spark.createDataFrame([tuple("1" for _ in names)], names)
    study, mapping = scan.autodetect_wide(wide)
    assert study.dimensions == ("classe", "produto") and study.history_end == date(2025, 12, 1)
    assert scan.autodetect_wide(wide.drop("202501")) is None


def test_skewed_source_with_one_hot_series(spark):
    """A third of the rows belong to one series and period; results stay whole."""
    n = 90_000
    hot = F.col("id") % 3 == 0
    df = spark.range(n).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("series_id"),
        F.lit("unidades").alias("measure"),
        F.when(hot, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 500).cast("string"))).alias("entity_id"),
        F.when(hot, F.lit(END)).otherwise(F.add_months(F.lit(END), -(F.col("id") % 24).cast("int"))).alias("ds"),
        F.lit(1).cast("decimal(20,2)").alias("y_raw"),
        F.col("id").alias("_order"),
    )
    values = quality.prepare(df, STUDY, ZERO).values
    assert values.agg(F.sum("y")).first()[0] == n
    assert values.where("series_id = 'hot'").first()["y"] == n / 3


def test_wide_export_and_formula_guard(spark):
    values = quality.prepare(observations(spark, {"a1": SEASONAL}), STUDY, ZERO).values
    history = views.leaf_history(values)
    predictions = backtest.final_forecast(frame(spark, {"a1": SEASONAL}, fitted=False))
    tags = {"run_id": "=r", "preparation_id": "p", "dataset_id": "d"}
    long = exports.export_long(history, predictions, tree(spark), ["grupo"], tags)
    wide = exports.to_wide(long, ["grupo"], MONTHS, [shift_date(END, k) for k in range(1, 7)], "Naive")
    row = wide.first()
    assert row["historico_2025-12-01"] == row["previsao_2026-01-01"] == SEASONAL[-1]
    safe, counted = exports.protect_table(long)
    assert counted.first()["n_protected"] == long.count()
    assert safe.first()["run_id"] == "'=r"


def test_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [("0012", 'say "x"; y', ""), ("0013", "a,b", "-5")]
    df = spark.createDataFrame(rows, "ean string, name string, v string")
    path = str(tmp_path / "out")
    exports.write_csv(df, path)
    back = {tuple(r) for r in scan.scan_text_table(spark, path).collect()}
    assert back == {("0012", 'say "x"; y', ""), ("0013", "a,b", "'-5")}
    assert scan.sniff_delimiter(spark, path).first()["delimiter"] == ";"


# Limits of fitted methods: simulate the recursion with random errors and compare the spread of its paths.


def _ets_paths(rng, n, h, season, trend, seasonal, alpha, beta, phi, gamma, sigma, level, slope, wave):
    """Values of ``n`` futures of one exponential-smoothing state, written step by step."""
    out = np.empty((n, h))
    lev, tre = np.full(n, level), np.full(n, slope)
    cycle = [np.full(n, w) for w in wave]
    for t in range(h):
        ahead, now = lev + phi * tre, cycle[t % season]
        e = rng.normal(0, sigma, n)
        out[:, t] = (ahead + now if seasonal == "A" else ahead * now) + e
        move = e if seasonal == "A" else e / now
        cycle[t % season] = now + gamma * (e if seasonal == "A" else e / ahead)
        lev, tre = ahead + alpha * move, phi * tre + beta * move
    return out


@pytest.mark.parametrize(("trend", "seasonal"), [("N", "N"), ("A", "N"), ("Ad", "N"), ("A", "A"), ("Ad", "M")])
def test_smoothing_deviations_against_simulated_paths(monkeypatch, trend, seasonal):
    season, n, h = 4, 60, 9
    grid = np.array([[0.3], [0.06 if trend != "N" else 0.0], [0.9 if trend == "Ad" else 1.0], [0.1 if seasonal != "N" else 0.0]])
    monkeypatch.setattr(fitters, "_grid", lambda *_: grid)
    rng = np.random.default_rng(3)
    t = np.arange(n)
    y = 200 + 0.5 * t + (rng.normal(0, 4, n)) + (10 * np.sin(2 * np.pi * t / season) if seasonal != "N" else 0)
    _, out, deviation = fitters.smooth(y[None, :], h, season, trend, seasonal)
    sigma = deviation[0, 0]
    # The state at the end, from the values ahead without errors: the recursion is run once more.
    alpha, beta, phi, gamma = grid[:, 0]
    wave = np.zeros(season) if seasonal != "M" else np.ones(season)
    if seasonal == "N":
        slope = out[0, 1] - out[0, 0] if trend != "N" else 0.0
        slope = slope / phi**2 if trend != "N" else 0.0
        level = out[0, 0] - phi * slope
        paths = _ets_paths(rng, 60_000, h, 1, trend, "A", alpha, beta, phi, 0.0, sigma, level, slope, [0.0])
    else:
        wave = out[0, :season] / out[0, :season].mean() if seasonal == "M" else out[0, :season] - out[0, :season].mean()
        level = out[0, :season].mean()
        paths = _ets_paths(rng, 60_000, h, season, trend, seasonal, alpha, beta, phi, gamma, sigma, level, 0.0, wave)
    spread = paths.std(axis=0)
    assert deviation[0] == pytest.approx(spread, rel=0.03)


def test_autoregressive_deviations_against_simulated_paths():
    rng = np.random.default_rng(4)
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    lags, h = (1, 2), 8
    coef, sse = fitters._regress(y[None, :], lags, 4, None)
    psi = fitters._responses(lags, coef, h)
    e = rng.normal(size=(80_000, h))
    paths = np.zeros((80_000, h + 2))
    for t in range(h):
        paths[:, t + 2] = coef[0, 1] * paths[:, t + 1] + coef[0, 2] * paths[:, t] + e[:, t]
    assert np.sqrt(np.cumsum(psi[0] ** 2)) == pytest.approx(paths[:, 2:].std(axis=0), rel=0.02)
    values, deviation = fitters.auto_ar(np.cumsum(y)[None, :], h, 1)
    assert (np.diff(deviation[0]) > 0).all() and deviation.shape == values.shape == (1, h)


def test_theta_deviations_grow_by_the_weight():
    rng = np.random.default_rng(5)
    y = 50 + np.cumsum(rng.normal(0, 1, (3, 80)), axis=1)
    _, deviation = fitters.auto_theta(y, 6, 1)
    ratio = (deviation / deviation[:, [0]]) ** 2 - 1
    assert ratio / np.arange(6).clip(1) == pytest.approx(np.repeat(ratio[:, [1]], 6, axis=1) * (np.arange(6) > 0))


def test_fitted_methods_have_their_own_limits(spark):
    rows = backtest.final_forecast(frame(spark, {"s": SEASONAL})).where("model_alias IN ('AutoETS', 'AutoTheta', 'AutoAR', 'Holt')").collect()
    assert {r["interval_method"] for r in rows} == {"native"}
    assert all(r["lo80"] <= r["yhat"] <= r["hi80"] for r in rows)


def test_a_regressor_told_twice_keeps_its_history(spark):
    rows = [("r", END, 5.0, True), ("r", END, 3.0, False), ("r", END, 4.0, False), ("r", MONTHS[0], None, False), ("r", MONTHS[0], 9.0, True)]
    values = spark.createDataFrame(rows, "regressor_id string, ds date, value double, is_future boolean")
    for k in (1, 4):
        found = {r["ds"]: r["r"] for r in regressors.by_date(values.repartition(k), (RegressorSpec("r", "r"),)).collect()}
        assert found == {END: 3.0, MONTHS[0]: 9.0}


def test_the_regressor_calendar_is_bounded_by_the_settings(spark):
    old = [("r", date(1900 + k, 1, 1), float(k), False) for k in range(100)]
    inside = [("r", d, 1.0, False) for d in MONTHS] + [("r", date(2090, 1, 1), 7.0, False)]
    values = spark.createDataFrame(old + inside, "regressor_id string, ds date, value double, is_future boolean")
    found = regressors._calendar(values, STUDY, CONFIG).collect()
    assert len(found) == 61 and max(r["value"] for r in found if r["ds"] < MONTHS[0]) == 99.0


def test_short_seasons_and_missing_values_keep_their_rows_in_the_global_model(spark):
    values = quality.prepare(observations(spark, {f"s{k}": [10.0 + (i * k) % 7 for i in range(40)] for k in range(25)}), STUDY, ZERO).values
    trained = global_trees.train_global_model(values, "unidades", 1, iterations=2)
    rows = panel.train_panel(values, STUDY, CONFIG, []).where("series_id IN ('s1', 's2', 's3')")
    bad = rows.withColumn("ys", F.when(F.col("series_id") == "s2", F.transform("ys", lambda y, i: F.when(i < 38, y))).otherwise(F.col("ys")))
    bad = bad.withColumn("n", F.when(F.col("series_id") == "s3", 2).otherwise(F.col("n")))
    found = {r["series_id"]: (r["failure_reason"], r["raw"] and len(r["raw"])) for r in global_trees.forecast_global(bad, trained, 1, 6).collect()}
    assert found == {"s1": ("", 6), "s2": ("missing_values", None), "s3": ("insufficient_history", None)}
