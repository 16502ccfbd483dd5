"""The whole run as one composition of lazy frames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.config import ForecastConfig, HierarchyConfig, RegressorSpec, Scenario, StudyConfig, TreatmentPolicy
from seriesmill.functions.periods import shift_date
from seriesmill.operators import backtest as FC
from seriesmill.operators import global_trees as G
from seriesmill.operators import hierarchy as H
from seriesmill.operators import outcome as O
from seriesmill.operators import panel as P
from seriesmill.operators import quality as Q
from seriesmill.operators import regressors as R
from seriesmill.operators import scenarios as SC
from seriesmill.session import cut_lineage
from seriesmill.sources import store

FILLED = ("zero", "ffill")


def run_forecast(
    observations: DataFrame,
    entities: DataFrame,
    study: StudyConfig,
    policy: TreatmentPolicy,
    config: ForecastConfig,
    hierarchy: HierarchyConfig | None = None,
    scenarios: tuple[Scenario, ...] = (),
    regressors: tuple[RegressorSpec, ...] = (),
    regressor_values: DataFrame | None = None,
    fitted: bool = True,
    global_iterations: int = 0,
    keep_frame: bool = False,
) -> dict[str, DataFrame]:
    """prepare → panel → methods → backtest → selection → final → scenarios → roll-up.

    ``keep_frame`` writes the method frame to the shared checkpoint folder, so its readers
    (backtest, final, scenarios) share one computation and lost executors do not repeat it.
    ``entities`` carry the hierarchy dimensions and a ``dims`` map. Settings that can't be used raise an
    error before anything is read; what the data say against a run comes back in ``issues``. Rules of a run at an
    upper level still speak of leaves, and must reach all leaves of a node alike.
    """
    check_settings(study, config, hierarchy, scenarios, regressors)
    values = Q.prepare(observations, study, policy).values
    bridge = H.node_bridge(entities, hierarchy, keep=("dims",)) if hierarchy else None
    modelled, owners, members = values, entities, None
    if hierarchy and hierarchy.mode == "independent":
        level = hierarchy.forecast_level or 0
        modelled = H.aggregate_history(values, bridge, level)
        owners = _level_owners(entities, bridge, hierarchy, level)
        members = bridge.where(F.col("level") == level)
    if policy.missing in FILLED:
        folds = P.calendar_folds(study, config)
    else:
        folds = P.collect_folds(P.cv_windows(modelled, study, config))
    panel = P.train_panel(modelled, study, config, folds)
    frame = FC.forecast_frame(panel, study, config, fitted)
    season = config.season_length or study.season
    horizon = [shift_date(study.history_end, k * study.step) for k in range(1, config.horizon + 1)]
    if regressors:
        frame = frame.unionByName(_exogenous(modelled, owners, regressor_values, regressors, study, config, folds, horizon, None).select(*frame.columns))
    if global_iterations:
        frame = frame.unionByName(_global(modelled, panel, study, config, folds, season, global_iterations).select(*frame.columns))
    if keep_frame:
        frame = cut_lineage(frame)
    cv = FC.cv_predictions(frame)
    scores = FC.select_model(FC.score_models(cv), config)
    refits = [s for s in scenarios if s.overrides and regressors]
    shared = tuple(s for s in scenarios if s not in refits)
    names = {s.regressor_id: s.name for s in regressors}
    again = {
        s.scenario_id: _exogenous(modelled, owners, regressor_values, regressors, study, config, folds, horizon, s.overrides)
        for s in refits
    }

    def finished(finals: Callable[[DataFrame], DataFrame], source: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Final rows of the base and of all scenarios, and the issues of those that are blocked."""
        base = finals(source)
        rows, issues = O.with_scenarios(base, entities, shared, horizon, names, members)
        for s in refits:
            own = refitted(base, finals(again[s.scenario_id]))
            extra, more = O.with_scenarios(own, entities, (s,), horizon, names, members, with_base=False)
            rows, issues = rows.unionByName(extra), issues.unionByName(more)
        return rows, issues

    rows, issues = finished(lambda f: O.final_panel(f, config.interval_level, config.cv_windows), frame)
    out = {"values": modelled, "cv": cv, "scores": scores, "predictions": O.exploded(rows)}
    out["issues"] = run_issues(issues, entities, hierarchy, regressors, regressor_values, horizon)
    if hierarchy and hierarchy.mode != "independent":
        # Sums have no limits, so a run of array methods alone doesn't work them out here.
        plain = rows
        if not (fitted or regressors or global_iterations):
            plain = finished(O.final_values, frame if keep_frame else FC.forecast_frame(panel, study, config, False, limits=False))[0]
        out["aggregates"] = O.roll_up(plain, entities, hierarchy, config.horizon, study.step)
        out["nodes"] = H.run_nodes(values, entities, bridge)
    base = O.final_panel(frame, config.interval_level, config.cv_windows)
    out["selection"] = O.selection(scores, base, config.resolved_cv_horizon(study))
    out["summary"] = O.summary(modelled, base)
    return out


def stored_run(
    root: str,
    run_id: str,
    observations: DataFrame,
    entities: DataFrame,
    study: StudyConfig,
    policy: TreatmentPolicy,
    config: ForecastConfig,
    hierarchy: HierarchyConfig | None = None,
    dataset_id: str = "",
    **options,
) -> str:
    """A whole run, kept: every table of its result appears with one commit; returns the status.

    Its state is noted before and after, so a run that stops in between is found by ``mark_interrupted_runs`` and
    none of its tables is ever read. ``options`` are those of ``run_forecast``.
    """
    spark = observations.sparkSession
    settings = {"dataset_id": dataset_id, "config_json": config.to_json()}
    check_settings(study, config, hierarchy, options.get("scenarios", ()), options.get("regressors", ()))
    store.record_run(spark, root, run_id, "running", **settings)
    try:
        out = run_forecast(observations, entities, study, policy, config, hierarchy, **{"keep_frame": True, **options})
        store.persist_run({name: rows for name, rows in out.items() if name in store.RUN_TABLES}, root, run_id)
        status = store.load_run(spark, root, run_id, "summary").first()["status"]
    except Exception:
        store.record_run(spark, root, run_id, "failed")
        raise
    store.record_run(spark, root, run_id, status)
    return status


def check_settings(
    study: StudyConfig,
    config: ForecastConfig,
    hierarchy: HierarchyConfig | None = None,
    scenarios: tuple[Scenario, ...] = (),
    regressors: tuple[RegressorSpec, ...] = (),
) -> None:
    """All settings of a run before anything is read; what is wrong is told at once."""
    problems = [*study.validate(), *config.validate()]
    problems += H.level_issues(hierarchy) if hierarchy else []
    for s in scenarios:
        problems += [(r.rule_id, text) for r in s.rules for _, text in r.validate()]
        problems += [(s.scenario_id, f"no regressor {r}") for r in s.overrides if regressors and r not in {x.regressor_id for x in regressors}]
    problems += [(x, "two regressors have this id") for x, n in Counter(r.regressor_id for r in regressors).items() if n > 1]
    if problems:
        raise ValueError("; ".join(f"{name}: {text}" for name, text in problems))


ISSUES = "stage string, code string, severity string, subject string, n_cells long"


def run_issues(
    scenario_issues: DataFrame,
    entities: DataFrame,
    hierarchy: HierarchyConfig | None,
    regressors: tuple[RegressorSpec, ...],
    regressor_values: DataFrame | None,
    horizon: list[date],
) -> DataFrame:
    """What the data of a run say against it: blocked scenarios, ambiguous leaves, unusable regressors."""
    out = scenario_issues.select(
        F.lit("scenario").alias("stage"), "code", F.lit("error").alias("severity"), F.col("scenario_id").alias("subject"), "n_cells"
    )
    if hierarchy:
        leaves = H.ambiguous_leaves(entities, hierarchy)
        name = F.concat_ws(" > ", *hierarchy.levels[-1])
        out = out.unionByName(leaves.select(F.lit("hierarchy").alias("stage"), "code", F.lit("error").alias("severity"), name.alias("subject"), F.col("n_entities").alias("n_cells")))
    if regressors and regressor_values is not None:
        found = R.regressor_validate(regressor_values, regressors, horizon)
        subject = F.concat_ws(" / ", "regressor_id", "other_id").alias("subject")
        out = out.unionByName(found.select(F.lit("regressor").alias("stage"), "code", "severity", subject, F.lit(1).cast("long").alias("n_cells")))
    return out


def _level_owners(entities: DataFrame, bridge: DataFrame, hierarchy: HierarchyConfig, level: int) -> DataFrame:
    """Nodes of one level as entities, with that level's dimensions."""
    dims = hierarchy.levels[level]
    nodes = bridge.where(F.col("level") == level).select("entity_id", "node_id")
    flat = entities.join(nodes, "entity_id").select(F.col("node_id").alias("entity_id"), *dims).distinct()
    return flat.withColumn("dims", F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))]))


def _exogenous(modelled, owners, values, specs, study, config, folds, horizon, overrides) -> DataFrame:
    future = R.regressor_future(values, specs, horizon, study.history_end, overrides)
    panel = R.exogenous_panel(modelled, owners, values, future, specs, study, config, folds)
    return R.ar_exog(panel, config.season_length or study.season, config.interval_level)


def refitted(base: DataFrame, again: DataFrame) -> DataFrame:
    """Base rows with those of the exogenous method replaced where it could be forecast again.

    Rows that could not be forecast again stay as they are in the base.
    """
    exogenous = F.col("model_alias") == "AutoAR_X"
    kept = base.where(exogenous).join(again.select(*O.KEYS), O.KEYS, "left_anti")
    return base.where(~exogenous).unionByName(kept.select(*base.columns)).unionByName(again.select(*base.columns))


def scenario_refit(base, modelled, owners, values, specs, study, config, folds, horizon, scenario) -> DataFrame:
    """The same for predictions with one row per date."""
    again = FC.final_forecast(_exogenous(modelled, owners, values, specs, study, config, folds, horizon, scenario.overrides))
    rows = ["node_id", "measure", "model_alias", "ds"]
    kept = base.where(F.col("model_alias") == "AutoAR_X").join(again.select(*rows), rows, "left_anti")
    others = base.where(F.col("model_alias") != "AutoAR_X")
    return others.unionByName(kept.select(*base.columns)).unionByName(again.select(*base.columns))


def _global(modelled, panel, study, config, folds, season, iterations) -> DataFrame:
    """Backtest and final rows of the global method: one training per (measure, cutoff)."""
    parts = []
    for measure in study.measures:
        for fold in [*folds, None]:
            known = modelled if fold is None else modelled.where(F.col("ds") <= F.lit(fold.cutoff))
            trained = G.train_global_model(known, measure, season, iterations, seed=config.seed)
            number = P.FINAL_FOLD if fold is None else fold.number
            steps = config.horizon if fold is None else config.resolved_cv_horizon(study)
            parts.append(G.forecast_global(panel.where(F.col("fold") == number), trained, season, steps))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
