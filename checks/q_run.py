"""Regressors, global model, the composed run."""

from __future__ import annotations

from dataclasses import asdict
from datetime import date

from pyspark.sql import functions as F

from checks import sql as S
from checks.q_forecast import CONFIG, SCORES, SELECT, ZERO, cv_sql, panel, rounded, scores, values
from checks.q_hierarchy import ENT, GROWTH, PERIODS, RECON, WITH_TOTAL
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.config import ForecastConfig, RegressorSpec, Scenario
from seriesmill.operators import backtest as FC
from seriesmill.operators import global_trees as G
from seriesmill.operators import panel as P
from seriesmill.operators import regressors as R
from seriesmill.plans import exports as X
from seriesmill.plans import forecast_run as RUN

SPECS = (
    RegressorSpec("AFRICA", "demand in AFRICA", {"tipo": ("ECONOMY", "SMALL")}),
    RegressorSpec("ASIA", "demand in ASIA", {}, False, "explicit_hold"),
    RegressorSpec("EUROPE", "demand in EUROPE", {"marca": ("Brand#2",)}, False, "none"),
    RegressorSpec("AMERICA", "demand in AMERICA", {}, True, "none"),
)
OVERRIDES = {"ASIA": {date(2001, 10, 1): 1000.0}, "AFRICA": {date(2001, 9, 1): 500.0}}


def regressor_values(spark, sf):
    """Monthly order value per region; AFRICA also gets a future: its own values two years on."""
    orders = T.table(spark, sf, "orders").select(
        "o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("ds"), T.cents(F.col("o_totalprice")).alias("c")
    )
    per = orders.groupBy("o_custkey", "ds").agg(F.sum("c").alias("c"))
    cust = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = T.table(spark, sf, "region")
    joined = (
        per.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    past = joined.groupBy(F.col("r_name").alias("regressor_id"), "ds").agg((F.sum("c") / 100).alias("value"))
    past = past.where(F.col("ds") <= F.lit(T.HISTORY_END)).withColumn("is_future", F.lit(False))
    ahead = past.where("regressor_id = 'AFRICA'").select(
        "regressor_id", F.add_months("ds", 24).alias("ds"), "value", F.lit(True).alias("is_future")
    )
    return past.unionByName(ahead.where(F.col("ds") > F.lit(T.HISTORY_END)))


REG = """
past AS (SELECT r_name AS regressor_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
                CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         WHERE o_orderdate < DATE '2001-09-01' GROUP BY ALL),
ahead AS (SELECT regressor_id, CAST(ds + INTERVAL 24 MONTH AS DATE) AS ds, value FROM past
          WHERE regressor_id = 'AFRICA' AND ds + INTERVAL 24 MONTH > DATE '2001-08-01'),
hor AS (SELECT CAST(g AS DATE) AS ds FROM generate_series(TIMESTAMP '2001-09-01', TIMESTAMP '2002-08-01', INTERVAL 1 MONTH) t(g)),
spec(regressor_id, known, fill) AS (VALUES ('AFRICA', TRUE, 'none'), ('ASIA', FALSE, 'explicit_hold'), ('EUROPE', FALSE, 'none'), ('AMERICA', TRUE, 'none'))"""


@query("regressor_history", S.q(REG, "SELECT regressor_id, ds, round(value, 2) AS value FROM past"))
def _(spark, sf):
    out = regressor_values(spark, sf).where("NOT is_future").drop("is_future")
    return rounded(out, "value", digits=2)


@query("pearson_pairs", S.q(REG, """SELECT a.regressor_id AS left_id, b.regressor_id AS right_id, count(*) AS n_pairs, round(corr(a.value, b.value), 6) AS r,
 abs(corr(a.value, b.value)) > 0.999 AS collinear FROM past a JOIN past b ON a.ds = b.ds AND a.regressor_id < b.regressor_id
 WHERE a.regressor_id IN (SELECT regressor_id FROM spec) AND b.regressor_id IN (SELECT regressor_id FROM spec) GROUP BY ALL"""))
def _(spark, sf):
    return rounded(R.pearson_pairs(regressor_values(spark, sf), SPECS), "r", digits=6)


@query("missing_future_periods", S.q(REG, "SELECT regressor_id, ds FROM spec, hor EXCEPT SELECT regressor_id, ds FROM ahead"))
def _(spark, sf):
    return R.missing_future_periods(regressor_values(spark, sf), SPECS, PERIODS)


@query("regressor_validate", S.q(REG, """SELECT 'E_REGRESSOR_INCOMPLETE_FUTURE' AS code, 'error' AS severity, regressor_id, NULL AS other_id FROM spec
 WHERE known AND fill = 'none' AND regressor_id NOT IN (SELECT regressor_id FROM ahead)
 UNION ALL SELECT 'E_REGRESSOR_UNAVAILABLE_AT_CUTOFF', 'error', regressor_id, NULL FROM spec WHERE NOT known AND fill = 'none'
 UNION ALL SELECT 'E_REGRESSOR_FLAT', 'warning', s.regressor_id, NULL FROM spec s JOIN past USING (regressor_id) WHERE value <> 0 GROUP BY s.regressor_id HAVING count(DISTINCT value) < 2
 UNION ALL SELECT 'E_REGRESSOR_COLLINEAR', 'error', a.regressor_id, b.regressor_id FROM past a JOIN past b ON a.ds = b.ds AND a.regressor_id < b.regressor_id
  WHERE a.regressor_id IN (SELECT regressor_id FROM spec) AND b.regressor_id IN (SELECT regressor_id FROM spec)
  GROUP BY ALL HAVING abs(corr(a.value, b.value)) > 0.999"""))
def _(spark, sf):
    return R.regressor_validate(regressor_values(spark, sf), SPECS, PERIODS)


@query("regressor_scope", S.q(ENT, """SELECT entity_id, 'ASIA' AS regressor_id FROM entities UNION ALL SELECT entity_id, 'AMERICA' FROM entities
 UNION ALL SELECT entity_id, 'AFRICA' FROM entities WHERE tipo IN ('ECONOMY', 'SMALL') UNION ALL SELECT entity_id, 'EUROPE' FROM entities WHERE marca = 'Brand#2'"""))
def _(spark, sf):
    return R.regressor_scope(T.entities(spark, sf), SPECS)


@query("regressor_asof", S.q(REG, "SELECT regressor_id, max(ds) AS hold_ds, round(arg_max(value, ds), 2) AS hold_value FROM past WHERE ds <= DATE '2001-03-15' GROUP BY 1"))
def _(spark, sf):
    return rounded(R.regressor_asof(regressor_values(spark, sf), date(2001, 3, 15)), "hold_value", digits=2)


@query("regressor_repeat_last", S.q(REG, "SELECT p.regressor_id, hor.ds, round(p.value, 2) AS value FROM (SELECT regressor_id, arg_max(value, ds) AS value FROM past GROUP BY 1) p, hor"))
def _(spark, sf):
    return rounded(R.regressor_repeat_last(regressor_values(spark, sf), PERIODS, T.HISTORY_END), "value", digits=2)


@query("regressor_future", S.q(REG, """SELECT s.regressor_id, hor.ds, round(CASE WHEN NOT known AND fill = 'none' THEN NULL
   WHEN s.regressor_id = 'ASIA' AND hor.ds = DATE '2001-10-01' THEN 1000.0 WHEN s.regressor_id = 'AFRICA' AND hor.ds = DATE '2001-09-01' THEN 500.0
   WHEN known THEN a.value ELSE h.value END, 2) AS value
 FROM spec s CROSS JOIN hor LEFT JOIN ahead a ON a.regressor_id = s.regressor_id AND a.ds = hor.ds
 LEFT JOIN (SELECT regressor_id, arg_max(value, ds) AS value FROM past GROUP BY 1) h ON h.regressor_id = s.regressor_id"""))
def _(spark, sf):
    out = R.regressor_future(regressor_values(spark, sf), SPECS, PERIODS, T.HISTORY_END, OVERRIDES)
    return rounded(out, "value", digits=2)


@query("regressor_history_join", f"WITH {S.prep('marca').strip()},{REG} SELECT measure, prep.ds, count(*) AS n_rows, round(max(past.value), 2) AS value FROM prep LEFT JOIN past ON past.ds = prep.ds AND regressor_id = 'ASIA' GROUP BY ALL")
def _(spark, sf):
    wide = R.by_date(regressor_values(spark, sf), SPECS)
    joined = values(spark, sf, "marca").join(wide.select("ds", "ASIA"), "ds", "left")
    return joined.groupBy("measure", "ds").agg(F.count("*").alias("n_rows"), F.round(F.max("ASIA"), 2).alias("value"))


def exogenous(spark, sf, grain="marca", specs=SPECS[:2], overrides=None, folds=True):
    reg = regressor_values(spark, sf)
    future = R.regressor_future(reg, specs, PERIODS, T.HISTORY_END, overrides)
    cuts = P.calendar_folds(T.STUDY, CONFIG) if folds else []
    return R.exogenous_panel(
        values(spark, sf, grain), T.entities(spark, sf, grain), reg, future, specs, T.STUDY, CONFIG, cuts
    )


@query("regressor_matrix", f"""WITH {S.prep("marca").strip()}, dims AS (SELECT DISTINCT entity_id, tipo FROM obs),
 t AS (SELECT series_id, entity_id, count(*) AS n FROM prep GROUP BY ALL)
 SELECT series_id, n, CASE WHEN tipo IN ('ECONOMY', 'SMALL') THEN 2 ELSE 1 END AS n_regressors, CAST(12 AS BIGINT) AS n_next FROM t JOIN dims USING (entity_id)""")
def _(spark, sf):
    out = exogenous(spark, sf, folds=False)
    return out.select("series_id", F.size("xs").cast("long").alias("n"), "n_regressors", F.size("x_next").cast("long").alias("n_next"))


@query("ar_exog")
def _(spark, sf):
    out = R.ar_exog(exogenous(spark, sf), T.STUDY.season)
    return out.select("series_id", "measure", "fold", "failure_reason", F.transform("raw", lambda v: F.round(v, 3)).alias("yhat"))


@query("ar_exog_status", f"""WITH {S.prep("marca").strip()},{REG}, dims AS (SELECT DISTINCT entity_id, tipo, marca FROM obs),
 sc AS (SELECT entity_id, 'AFRICA' AS regressor_id FROM dims WHERE tipo IN ('ECONOMY', 'SMALL')
        UNION ALL SELECT entity_id, 'EUROPE' FROM dims WHERE marca = 'Brand#2'),
 hist AS (SELECT p.series_id, bool_or(past.value IS NULL) AS holes FROM prep p JOIN sc USING (entity_id)
          LEFT JOIN past ON past.regressor_id = sc.regressor_id AND past.ds = p.ds GROUP BY p.series_id),
 fut AS (SELECT entity_id, bool_or(ahead.value IS NULL) AS holes FROM sc CROSS JOIN hor
         LEFT JOIN ahead ON ahead.regressor_id = sc.regressor_id AND ahead.ds = hor.ds GROUP BY entity_id),
 t AS (SELECT series_id, entity_id, count(*) AS n FROM prep GROUP BY ALL)
 SELECT CASE WHEN hist.holes IS NULL OR hist.holes THEN 'regressor_unavailable' WHEN fut.holes THEN 'regressor_future_unavailable'
             WHEN n < 8 THEN 'insufficient_history' ELSE '' END AS failure_reason, count(*) AS n_series
 FROM t LEFT JOIN hist USING (series_id) LEFT JOIN fut USING (entity_id) GROUP BY ALL""")
def _(spark, sf):
    out = R.ar_exog(exogenous(spark, sf, specs=(SPECS[0], SPECS[2]), folds=False), T.STUDY.season)
    return out.groupBy("failure_reason").agg(F.count("*").alias("n_series"))


@query("scenario_refit")
def _(spark, sf):
    reg, specs = regressor_values(spark, sf), SPECS[:2]
    ents, vals = T.entities(spark, sf, "marca"), values(spark, sf, "marca")
    cuts = P.calendar_folds(T.STUDY, CONFIG)
    frame = FC.forecast_frame(panel(spark, sf, "marca"), T.STUDY, CONFIG, False, False)
    base = FC.final_forecast(frame, native_only=True)
    out = RUN.scenario_refit(base, vals, ents, reg, specs, T.STUDY, CONFIG, cuts, PERIODS, Scenario("what-if", (), OVERRIDES))
    return out.groupBy("measure", "model_alias", "ds").agg(F.count("*").alias("n_rows"), F.round(F.sum("yhat"), 2).alias("total"))


@query("regressor_family_clash", S.q(ENT, "SELECT 'clash' AS scenario_id, 'price' AS family, count(*) AS n_entities FROM entities"))
def _(spark, sf):
    from checks.q_hierarchy import SCENARIOS
    from seriesmill.operators.scenarios import family_clashes

    found = family_clashes(SCENARIOS, {"r-price": "price"})
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("scenario_id"), F.lit(f).alias("family")) for s, f in found]))
    return T.entities(spark, sf).select(pairs.alias("c")).groupBy("c.scenario_id", "c.family").agg(F.count("*").alias("n_entities"))


@query("lag_features", S.q(S.prep("marca"), """SELECT series_id, measure, ds, y, lag(y, 1) OVER w AS lag1, lag(y, 2) OVER w AS lag2, lag(y, 3) OVER w AS lag3,
 lag(y, 12) OVER w AS lag_season, round(CASE WHEN row_number() OVER w > 3 THEN (lag(y, 1) OVER w + lag(y, 2) OVER w + lag(y, 3) OVER w) / 3 END, 4) AS mean3,
 month(ds) AS month, quarter(ds) AS quarter, year(ds) AS year FROM prep WINDOW w AS (PARTITION BY series_id ORDER BY ds)"""))
def _(spark, sf):
    return rounded(G.lag_features(values(spark, sf, "marca"), 12), "mean3")


@query("global_gbt")
def _(spark, sf):
    vals = values(spark, sf, "marca")
    rows = panel(spark, sf, "marca").where(F.col("fold") == P.FINAL_FOLD)
    out = None
    for measure in T.STUDY.measures:
        trained = G.train_global_model(vals, measure, 12, iterations=5)
        part = G.forecast_global(rows, trained, 12, 3)
        out = part if out is None else out.unionByName(part)
    return out.select("series_id", "measure", "model_alias", "failure_reason", F.transform("raw", lambda v: F.round(v, 3)).alias("yhat"))


RUN_CONFIG = ForecastConfig(horizon=12, cv_windows=2)


def whole_run(spark, sf, fitted=False):
    return RUN.run_forecast(
        T.observations(spark, sf), T.entities(spark, sf), T.STUDY, ZERO, RUN_CONFIG, WITH_TOTAL, (GROWTH,), fitted=fitted
    )


@query("run_forecast", f"""WITH {RECON.strip()} SELECT level, measure, model_alias, ds, round(yhat, 4) AS yhat, status FROM rec""")
def _(spark, sf):
    out = whole_run(spark, sf)["aggregates"].where("scenario_id = 'base'").select("level", "measure", "model_alias", "ds", "yhat", "status")
    return rounded(out, "yhat")


@query("run_forecast_fitted")
def _(spark, sf):
    """Every method, including the fitted ones, on part-level series."""
    out = whole_run(spark, sf, fitted=True)
    return out["scores"].groupBy("measure", "model_alias").agg(
        F.count("*").alias("n_series"), F.round(F.avg("mae"), 4).alias("mae_mean"), F.count_if("selected").alias("n_selected")
    )


@query("assumptions_frame", f"""WITH {ENT} SELECT 'rule' AS kind, id, count(*) AS n_entities FROM entities,
 (VALUES ('g1', NULL, NULL), ('g2', ['ECONOMY', 'SMALL'], NULL), ('g3', ['ECONOMY'], NULL), ('g4', NULL, ['Brand#2', 'Brand#17'])) r(id, ts, ms)
 WHERE (ts IS NULL OR list_contains(ts, tipo)) AND (ms IS NULL OR list_contains(ms, marca)) GROUP BY ALL
 UNION ALL SELECT 'regressor', id, count(*) FROM entities, (VALUES ('AFRICA', ['ECONOMY', 'SMALL']), ('ASIA', NULL)) r(id, ts)
 WHERE ts IS NULL OR list_contains(ts, tipo) GROUP BY ALL""")
def _(spark, sf):
    """Rules and regressors of a run as rows, with the entities each one reaches."""
    from seriesmill.operators.scenarios import in_scope

    settings = X.assumptions_frame(spark, GROWTH.rules, SPECS[:2])
    scopes = {r.rule_id: r.filters for r in GROWTH.rules} | {s.regressor_id: s.scope for s in SPECS[:2]}
    hits = F.filter(F.array(*[F.when(in_scope(f, F.col("dims")), F.lit(i)) for i, f in scopes.items()]), lambda h: h.isNotNull())
    reached = T.entities(spark, sf).select(F.explode(hits).alias("id")).groupBy("id").agg(F.count("*").alias("n_entities"))
    return settings.select("kind", "id").join(reached, "id")


def _text(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


SETTINGS = [("study", T.STUDY), ("forecast", CONFIG)]
SETTING_ROWS = " UNION ALL ".join(f"SELECT '{section}', '{k}', {_text(v)}" for section, c in SETTINGS for k, v in asdict(c).items())


@query("export_manifest", S.q(cv_sql("marca"), f"""{SCORES}{SELECT} SELECT 'selection' AS section, measure || ' / ' || model_alias || ' / ' || selection_reason AS key, CAST(count(*) AS VARCHAR) AS value
 FROM sel WHERE selected GROUP BY measure, model_alias, selection_reason
 UNION ALL SELECT 'run', 'run_id', 'r1' UNION ALL {SETTING_ROWS}""").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    return X.export_manifest(spark, {"run_id": "r1"}, T.STUDY, CONFIG, scores(spark, sf, "marca"))
