"""Windows, panel, methods, scores, selection, final forecasts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.config import ForecastConfig, TreatmentPolicy
from seriesmill.functions import text
from seriesmill.operators import fitters, models
from seriesmill.operators import backtest as FC
from seriesmill.operators import panel as P
from seriesmill.operators import quality as Q

ZERO = TreatmentPolicy(duplicates="sum", missing="zero")
CONFIG = ForecastConfig(horizon=12, cv_windows=2)


def values(spark, sf, grain="ean"):
    return Q.prepare(T.observations(spark, sf, grain), T.STUDY, ZERO).values


def panel(spark, sf, grain="ean", config=CONFIG, final=True):
    return P.train_panel(values(spark, sf, grain), T.STUDY, config, P.calendar_folds(T.STUDY, config), final)


def frame(spark, sf, grain="ean", config=CONFIG, fitted=False, limits=False, final=True):
    return FC.forecast_frame(panel(spark, sf, grain, config, final), T.STUDY, config, fitted, limits)


def cv_rows(spark, sf, grain="ean"):
    return FC.cv_predictions(frame(spark, sf, grain, final=False))


def scores(spark, sf, grain="ean"):
    return FC.select_model(FC.score_models(cv_rows(spark, sf, grain)), CONFIG)


def predictions(spark, sf, grain="marca", limits=False):
    return FC.final_forecast(frame(spark, sf, grain, limits=limits), native_only=True)


def rounded(df, *cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def metric_digits(df):
    """Digits at which sums run in another order agree and no value sits on a rounding edge."""
    digits = {"mae": 7, "rmse": 4, "wape": 9, "bias": 7}
    names = {c: digits[c.removesuffix("_mean")] for c in df.columns if c.removesuffix("_mean") in digits}
    return df.withColumns({c: F.round(c, d) for c, d in names.items()})


def models_sql(src: str, h: int) -> str:
    """Every native method over rows (ys, n, n_total, n_pos, n_neg, n_zero) of CTE ``src``."""

    def mean(width):
        return f"list_sum(ys[-{width}:]) / {width}"

    def const(value):
        return f"list_transform(range(1, {h + 1}), lambda k: {value})"

    ses = "list_reduce({x}, lambda a, b: a * (1 - {w}) + b * {w})"
    sizes = "list_filter(ys, lambda y: y > 0)"
    marks = "list_filter(list_transform(ys, lambda y, i: CASE WHEN y > 0 THEN i END), lambda i: i IS NOT NULL)"
    gaps = f"list_transform({marks}, lambda p, j: CAST(CASE WHEN j = 1 THEN p ELSE p - ({marks})[j - 1] END AS DOUBLE))"
    some = f"len({sizes}) > 0"
    size_ses = ses.format(x=sizes, w="CAST(0.1 AS DOUBLE)")
    gap_ses = ses.format(x=gaps, w="CAST(0.1 AS DOUBLE)")
    croston = f"CASE WHEN {some} THEN {size_ses} / {gap_ses} * 0.95 ELSE 0.0 END"
    prob = ses.format(x="list_transform(ys, lambda y: CAST(CASE WHEN y > 0 THEN 1 ELSE 0 END AS DOUBLE))", w="CAST(0.2 AS DOUBLE)")
    size2 = ses.format(x=sizes, w="CAST(0.2 AS DOUBLE)")
    tsb = f"CASE WHEN {some} THEN {prob} * {size2} ELSE 0.0 END"
    live = "n_zero < n_total AND n_total >= 4"
    sparse = live + " AND n_neg = 0 AND n_pos >= 2"
    slope = "(ys[-1] - ys[1]) / (n - 1)"
    rows = [
        ("ZeroBaseline", "n_zero = n_total AND n_total >= 4", "TRUE", const("0.0")),
        ("Naive", live, "TRUE", const("ys[-1]")),
        ("MediaMovel3", live, "n >= 3", const(mean(3))),
        ("MediaMovel6", live, "n >= 6", const(mean(6))),
        ("MediaMovel12", live, "n >= 12", const(mean(12))),
        ("HistoricAverage", live, "TRUE", const("list_sum(ys) / n")),
        ("SeasonalNaive", live, "n >= 12", const("ys[n - 12 + 1 + (k - 1) % 12]")),
        ("RegLinearDrift", live, "n >= 2", const(f"ys[n] + k * {slope}")),
        ("CrostonSBA", sparse, "TRUE", const(croston)),
        ("TSB", sparse, "TRUE", const(tsb)),
        ("Naive", "n_total < 4", "FALSE", const("ys[-1]")),
    ]
    parts = [
        f"SELECT * EXCLUDE (ys), '{a}' AS model_alias, CASE WHEN {ok} THEN {expr} END AS raw FROM {src} WHERE {cond}"
        for a, cond, ok, expr in rows
    ]
    return " UNION ALL\n".join(parts)


def cv_sql(grain: str) -> str:
    """CTEs up to cv: backtest rows of the native methods over two folds."""
    return (
        S.prep(grain)
        + f""",
prof AS (SELECT series_id, count(*) AS n_total, count_if(y > 0) AS n_pos, count_if(y < 0) AS n_neg, count_if(y = 0) AS n_zero
         FROM prep GROUP BY 1),
wins AS (SELECT * FROM (VALUES (0, DATE '2001-02-01'), (1, DATE '2001-05-01')) t(fold, cutoff)),
tr AS (SELECT series_id, measure, entity_id, fold, cutoff, list(y ORDER BY ds) AS ys, count(*) AS n
       FROM prep JOIN wins ON ds <= cutoff GROUP BY ALL HAVING count(*) >= 4),
trp AS (SELECT tr.*, n_total, n_pos, n_neg, n_zero FROM tr JOIN prof USING (series_id)),
mdl AS ({models_sql("trp", 3)}),
cv0 AS (SELECT series_id AS node_id, measure, entity_id, model_alias, fold, cutoff,
               CAST(cutoff + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, CASE WHEN raw IS NOT NULL THEN greatest(raw[k], 0.0) END AS yhat,
               n_zero = n_total AS all_zero,
               n_zero < n_total AND n_neg = 0 AND (n_total - n_pos) / n_total >= 0.6 AS mostly_zero
        FROM mdl, range(1, 4) t(k)),
cv AS (SELECT cv0.*, p.y AS y_actual, p.y IS NOT NULL AND yhat IS NOT NULL AS evaluated,
              CASE WHEN yhat IS NULL THEN 'insufficient_history' WHEN p.y IS NULL THEN 'no_observed_test' ELSE '' END AS failure_reason
       FROM cv0 LEFT JOIN prep p ON p.series_id = node_id AND p.ds = cv0.ds)"""
    )


SCORES = """,
sc AS (
  SELECT node_id, measure, model_alias, avg(abs(yhat - y_actual)) FILTER (evaluated) AS mae,
         sqrt(avg((yhat - y_actual) * (yhat - y_actual)) FILTER (evaluated)) AS rmse,
         CASE WHEN sum(abs(y_actual)) FILTER (evaluated) > 0
              THEN sum(abs(yhat - y_actual)) FILTER (evaluated) / sum(abs(y_actual)) FILTER (evaluated) END AS wape,
         avg(yhat - y_actual) FILTER (evaluated) AS bias, count_if(evaluated) AS n_eval,
         count(DISTINCT CASE WHEN evaluated THEN fold END) AS n_folds,
         bool_or(all_zero) AS all_zero, bool_or(mostly_zero) AS mostly_zero
  FROM cv GROUP BY ALL)"""

RANK = """list_position(['ZeroBaseline','Naive','MediaMovel3','MediaMovel6','MediaMovel12','HistoricAverage','SeasonalNaive',
 'RegLinearDrift','Holt','HoltDamped','AutoETS','ETS_Damped','AutoAR','AutoAR_X','AutoTheta','CrostonSBA','TSB','GlobalGBT'], model_alias)"""

SELECT = f""",
sel0 AS (SELECT *, n_eval > 0 AS eligible, mostly_zero AND model_alias IN ('CrostonSBA', 'TSB') AS imt,
         n_eval > 0 AND (model_alias IN ('Naive','SeasonalNaive','AutoETS','AutoTheta','CrostonSBA','TSB')
                         OR (all_zero AND model_alias = 'ZeroBaseline')) AS core FROM sc),
sel1 AS (SELECT *, CASE WHEN core THEN row_number() OVER (PARTITION BY node_id, measure ORDER BY CASE WHEN core THEN 0 ELSE 1 END,
           round(coalesce(wape, 1e300), 9), CASE WHEN imt THEN 0 ELSE 1 END, round(coalesce(mae, 1e300), 9), {RANK}) END AS place FROM sel0),
sel AS (SELECT *, coalesce(place = 1, FALSE) AS selected,
        CASE WHEN place = 1 THEN CASE WHEN all_zero THEN 'perfil_zero_total' WHEN imt THEN 'perfil_intermitente' ELSE 'auto_wape_1fold' END
             WHEN place > 1 THEN 'alternativa_rank_' || (place - 1)
             WHEN eligible THEN 'nao_avaliado_no_core' ELSE 'usuario' END AS selection_reason FROM sel1)"""


def fin_sql(grain: str, h: int = 12, base: str | None = None) -> str:
    """CTEs up to fin: future values of every native method with an evaluable fold."""
    return (
        (base or cv_sql(grain))
        + f""",
ful AS (SELECT series_id, measure, entity_id, list(y ORDER BY ds) AS ys, count(*) AS n, max(ds) AS last_ds FROM prep GROUP BY ALL),
fulp AS (SELECT ful.*, n_total, n_pos, n_neg, n_zero FROM ful JOIN prof USING (series_id)),
fmd AS ({models_sql("fulp", h)}),
okm AS (SELECT DISTINCT node_id, model_alias FROM cv WHERE evaluated),
fin AS (SELECT f.series_id AS node_id, f.entity_id, f.measure, f.model_alias,
               CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds, CASE WHEN raw IS NOT NULL THEN greatest(raw[k], 0.0) END AS yhat, n
        FROM fmd f JOIN okm o ON o.node_id = f.series_id AND o.model_alias = f.model_alias, range(1, {h + 1}) t(k)
        WHERE raw IS NOT NULL)"""
    )


@query(
    "cv_windows",
    S.q(
        S.prep("marca"),
        """, d AS (SELECT DISTINCT ds FROM prep),
r AS (SELECT ds, row_number() OVER (ORDER BY ds) AS rn, count(*) OVER () AS n, min(ds) OVER () AS train_start FROM d)
SELECT CAST(4 - (n - rn) / 3 AS INTEGER) AS fold, ds AS cutoff, train_start, ds AS train_end,
       CAST(ds + INTERVAL 1 MONTH AS DATE) AS test_start, CAST(ds + INTERVAL 3 MONTH AS DATE) AS test_end
FROM r WHERE (n - rn) % 3 = 0 AND (n - rn) / 3 BETWEEN 1 AND 4""",
    ).replace(")\n, d AS", "),\nd AS"),
)
def _(spark, sf):
    return P.cv_windows(values(spark, sf, "marca"), T.STUDY, replace(CONFIG, cv_windows=4))


@query(
    "train_panel",
    S.q(cv_sql("ean"), """SELECT series_id, measure, fold, cutoff, n, round(list_sum(ys), 2) AS total, ys[-1] AS last_y,
        n_total, n_pos AS n_positive FROM trp"""),
)
def _(spark, sf):
    total = F.aggregate("ys", F.lit(0.0), lambda a, y: a + y)
    return panel(spark, sf, final=False).select(
        "series_id", "measure", "fold", "cutoff", "n", F.round(total, 2).alias("total"),
        F.element_at("ys", -1).alias("last_y"), "n_total", "n_positive",
    )


@query(
    "model_eligibility",
    S.q(cv_sql("ean"), "SELECT measure, model_alias, fold, count(*) AS n_series, count_if(raw IS NULL) AS n_short FROM mdl GROUP BY ALL"),
)
def _(spark, sf):
    return frame(spark, sf, final=False).groupBy("measure", "model_alias", "fold").agg(
        F.count("*").alias("n_series"), F.count_if(F.col("raw").isNull()).alias("n_short")
    )


CV_COLS = "node_id, measure, model_alias, cutoff, ds, round(y_actual, 4) AS y_actual, round(yhat, 4) AS yhat, evaluated, failure_reason"


@query("pred_vs_actual", S.q(cv_sql("marca"), f"SELECT {CV_COLS} FROM cv"))
def _(spark, sf):
    rows = cv_rows(spark, sf, "marca").select(
        "node_id", "measure", "model_alias", "cutoff", "ds", "y_actual", "yhat", "evaluated", "failure_reason"
    )
    return rounded(rows, "y_actual", "yhat")


def _one_model(alias: str, key: str):
    sql = S.q(
        cv_sql("ean"),
        f"""SELECT measure, fold, ds, count(*) AS n, count_if(yhat IS NULL) AS n_null, round(sum(yhat), 4) AS total
            FROM cv WHERE model_alias = '{alias}' GROUP BY ALL""",
    )

    @query(key, sql)
    def _(spark, sf):
        rows = cv_rows(spark, sf).where(F.col("model_alias") == alias)
        return rows.groupBy("measure", "fold", "ds").agg(
            F.count("*").alias("n"),
            F.count_if(F.col("yhat").isNull()).alias("n_null"),
            F.round(F.sum("yhat"), 4).alias("total"),
        )


for _alias, _key in (
    ("Naive", "naive"),
    ("HistoricAverage", "historic_average"),
    ("MediaMovel3", "moving_average_3"),
    ("MediaMovel6", "moving_average_6"),
    ("MediaMovel12", "moving_average_12"),
    ("SeasonalNaive", "seasonal_naive"),
    ("RegLinearDrift", "drift"),
    ("CrostonSBA", "croston_sba"),
    ("TSB", "tsb"),
):
    _one_model(_alias, _key)

def zeroed(spark, sf):
    """Units of the parts whose number ends in 3 are zero throughout."""
    idle = (F.col("measure") == "unidades") & F.col("ean").endswith("3")
    owners = T.entities(spark, sf).select("entity_id", "ean")
    rows = values(spark, sf).join(owners, "entity_id").withColumn("y", F.when(idle, 0.0).otherwise(F.col("y"))).drop("ean")
    return P.train_panel(rows, T.STUDY, CONFIG, P.calendar_folds(T.STUDY, CONFIG))


ZERO_SQL = cv_sql("ean").replace(
    "prep AS (SELECT * FROM prep0 WHERE y IS NOT NULL)",
    """idle AS (SELECT DISTINCT entity_id FROM obs WHERE ean LIKE '%3'),
prep AS (SELECT * REPLACE (CASE WHEN measure = 'unidades' AND entity_id IN (SELECT entity_id FROM idle) THEN 0.0 ELSE y END AS y) FROM prep0 WHERE y IS NOT NULL)""",
)


@query("zero_baseline", S.q(ZERO_SQL, """SELECT measure, fold, ds, model_alias, count(*) AS n, count_if(evaluated) AS n_evaluated, round(sum(yhat), 4) AS total, round(sum(y_actual), 4) AS actual
 FROM cv WHERE all_zero GROUP BY ALL"""))
def _(spark, sf):
    """Series that are zero throughout keep the zero baseline alone."""
    rows = FC.cv_predictions(FC.forecast_frame(zeroed(spark, sf), T.STUDY, CONFIG, False, False)).where("all_zero")
    return rows.groupBy("measure", "fold", "ds", "model_alias").agg(
        F.count("*").alias("n"), F.count_if("evaluated").alias("n_evaluated"), F.round(F.sum("yhat"), 4).alias("total"), F.round(F.sum("y_actual"), 4).alias("actual")
    )


SCORE_COLS = "round(mae, 7) AS mae, round(rmse, 4) AS rmse, round(wape, 9) AS wape, round(bias, 7) AS bias, n_eval, n_folds"


@query("score_models", S.q(cv_sql("ean"), f"{SCORES} SELECT node_id, measure, model_alias, {SCORE_COLS} FROM sc").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    out = FC.score_models(cv_rows(spark, sf)).select(
        "node_id", "measure", "model_alias", "mae", "rmse", "wape", "bias", "n_eval", "n_folds"
    )
    return metric_digits(out)


@query(
    "backtest_metrics",
    S.q(cv_sql("ean"), """SELECT measure, model_alias, round(avg(abs(yhat - y_actual)) FILTER (evaluated), 7) AS mae,
  round(sqrt(avg((yhat - y_actual) * (yhat - y_actual)) FILTER (evaluated)), 4) AS rmse,
  round(CASE WHEN sum(abs(y_actual)) FILTER (evaluated) > 0 THEN
    sum(abs(yhat - y_actual)) FILTER (evaluated) / sum(abs(y_actual)) FILTER (evaluated) END, 9) AS wape,
  round(avg(yhat - y_actual) FILTER (evaluated), 7) AS bias, count_if(evaluated) AS n_eval FROM cv GROUP BY ALL"""),
)
def _(spark, sf):
    out = FC.error_metrics(["measure", "model_alias"], cv_rows(spark, sf))
    return metric_digits(out)


SEL_COLS = "node_id, measure, model_alias, round(wape, 9) AS wape, eligible, selected, selection_reason"


@query("select_model", S.q(cv_sql("ean"), f"{SCORES}{SELECT} SELECT {SEL_COLS} FROM sel").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    out = scores(spark, sf).select(
        "node_id", "measure", "model_alias", "wape", "eligible", "selected", "selection_reason"
    )
    return metric_digits(out)


@query("rank_alternatives", S.q(cv_sql("ean"), f"{SCORES}{SELECT} SELECT measure, model_alias, selection_reason, count(*) AS n FROM sel GROUP BY ALL").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    return scores(spark, sf).groupBy("measure", "model_alias", "selection_reason").agg(F.count("*").alias("n"))


@query("leaderboard", S.q(cv_sql("ean"), f"""{SCORES} SELECT measure, model_alias, round(avg(mae), 7) AS mae_mean,
 round(avg(rmse), 4) AS rmse_mean, round(avg(wape), 9) AS wape_mean, round(avg(bias), 7) AS bias_mean, count(DISTINCT node_id) AS n_series
 FROM sc WHERE n_eval > 0 GROUP BY ALL""").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    out = FC.leaderboard(FC.score_models(cv_rows(spark, sf)))
    return metric_digits(out)


@query("top3_alternatives", S.q(cv_sql("marca"), f"""{SCORES}, lb AS (SELECT measure, model_alias, avg(wape) AS wape_mean, count(*) AS n_series
 FROM sc WHERE n_eval > 0 GROUP BY ALL)
 SELECT measure, model_alias, round(wape_mean, 9) AS wape_mean, n_series,
 row_number() OVER (PARTITION BY measure ORDER BY wape_mean, {RANK}) AS place FROM lb
 QUALIFY place <= 3""").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    return metric_digits(FC.top_alternatives(FC.score_models(cv_rows(spark, sf, "marca"))))


@query("best_model_per_node", S.q(cv_sql("ean"), f"{SCORES}{SELECT} SELECT node_id, measure, model_alias, round(mae, 7) AS mae FROM sel WHERE selected").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    out = FC.best_model_per_node(scores(spark, sf)).select("node_id", "measure", "model_alias", "mae")
    return metric_digits(out)


FIN_COLS = "node_id, entity_id, measure, model_alias, ds, round(yhat, 4) AS yhat"


@query("final_forecast", S.q(fin_sql("marca"), f"SELECT {FIN_COLS} FROM fin"))
def _(spark, sf):
    out = predictions(spark, sf).select("node_id", "entity_id", "measure", "model_alias", "ds", "yhat")
    return rounded(out, "yhat")


@query("final_forecast_parts", S.q(fin_sql("ean"), "SELECT measure, model_alias, ds, count(*) AS n_rows, round(sum(yhat), 4) AS total FROM fin GROUP BY ALL"))
def _(spark, sf):
    return predictions(spark, sf, "ean").groupBy("measure", "model_alias", "ds").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("yhat"), 4).alias("total")
    )


@query("floor_zero", S.q(fin_sql("ean"), """SELECT f.measure, f.model_alias, count(*) AS n_rows, count_if(raw[k] < 0) AS n_clipped,
  min(greatest(raw[k], 0.0)) AS low FROM fmd f JOIN okm o ON o.node_id = f.series_id AND o.model_alias = f.model_alias, range(1, 13) t(k)
  WHERE raw IS NOT NULL AND f.model_alias IN ('RegLinearDrift', 'Naive') GROUP BY ALL"""))
def _(spark, sf):
    rows = predictions(spark, sf, "ean").where(F.col("model_alias").isin("RegLinearDrift", "Naive"))
    return rows.groupBy("measure", "model_alias").agg(
        F.count("*").alias("n_rows"), F.count_if("clipped").alias("n_clipped"), F.min("yhat").alias("low")
    )


INTERVALS = S.q(
    fin_sql("marca"),
    """, z AS (SELECT 1.2815515655446004 AS z),
d AS (SELECT series_id, n, ys, list_transform(range(2, n + 1), lambda i: ys[i] - ys[i - 1]) AS e1,
             list_transform(range(13, n + 1), lambda i: ys[i] - ys[i - 12]) AS e12,
             list_sum(ys) / n AS m, (ys[n] - ys[1]) / (n - 1) AS b FROM fulp),
s AS (SELECT series_id, n,
             sqrt(list_sum(list_transform(e1, lambda e: e * e)) / (n - 1)) AS s_naive,
             sqrt(list_sum(list_transform(ys, lambda y: (y - m) * (y - m))) / (n - 1)) AS s_mean,
             sqrt(list_sum(list_transform(e12, lambda e: e * e)) / (n - 12)) AS s_snaive,
             sqrt(list_sum(list_transform(e1, lambda e: (e - b) * (e - b))) / (n - 2)) AS s_drift FROM d),
w AS (SELECT f.*, raw[k] AS r, k, CAST(last_ds + to_months(CAST(k AS INTEGER)) AS DATE) AS ds,
             CASE f.model_alias WHEN 'Naive' THEN s_naive * sqrt(k) WHEN 'HistoricAverage' THEN s_mean * sqrt(1 + 1 / f.n)
               WHEN 'SeasonalNaive' THEN s_snaive * sqrt(floor((k - 1) / 12) + 1)
               WHEN 'RegLinearDrift' THEN s_drift * sqrt(k * (1 + k / (f.n - 1))) END * z AS hw
      FROM fmd f JOIN s ON s.series_id = f.series_id JOIN okm o ON o.node_id = f.series_id AND o.model_alias = f.model_alias, z, range(1, 13) t(k)
      WHERE f.model_alias IN ('Naive', 'HistoricAverage', 'SeasonalNaive', 'RegLinearDrift') AND f.n >= 32)
SELECT series_id AS node_id, measure, model_alias, ds, round(greatest(r - hw, 0.0), 3) AS lo80, round(greatest(r + hw, 0.0), 3) AS hi80, 'native' AS interval_method FROM w""",
).replace(")\n, z AS", "),\nz AS")


@query("intervals_native", INTERVALS)
def _(spark, sf):
    rows = predictions(spark, sf, "marca", limits=True).where("interval_method = 'native'")
    out = rows.select("node_id", "measure", "model_alias", "ds", "lo80", "hi80", "interval_method")
    return rounded(out, "lo80", "hi80", digits=3)


@query("intervals_conformal", S.q(fin_sql("marca"), """, er AS (SELECT node_id, model_alias, date_diff('month', cutoff, ds) AS step, abs(yhat - y_actual) AS a FROM cv WHERE evaluated),
rad AS (SELECT node_id, model_alias, step, quantile_cont(a, 0.8) AS r FROM er GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY node_id, model_alias ORDER BY ds) AS k FROM fin)
SELECT p.node_id, p.measure, p.model_alias, p.ds, round(greatest(yhat - r, 0.0), 7) AS lo80, round(yhat + r, 7) AS hi80
FROM p JOIN rad ON rad.node_id = p.node_id AND rad.model_alias = p.model_alias AND rad.step = least(k, 3)""").replace(")\n, er AS", "),\ner AS"))
def _(spark, sf):
    fr = frame(spark, sf, "marca")
    out = FC.conformal_intervals(FC.final_forecast(fr, native_only=True), FC.cv_predictions(fr), 80)
    out = out.where("interval_method = 'conformal'").select("node_id", "measure", "model_alias", "ds", "lo80", "hi80")
    return rounded(out, "lo80", "hi80", digits=7)


@query("fallback_chain", S.q(fin_sql("ean"), f"""SELECT series_id AS node_id, measure, model_alias, model_alias <> 'SeasonalNaive' AS fallback_used,
  round(CASE WHEN raw IS NOT NULL THEN greatest(raw[1], 0.0) END, 4) AS first_yhat FROM fmd WHERE raw IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY CASE model_alias WHEN 'SeasonalNaive' THEN 0 WHEN 'Naive' THEN 2 ELSE 1 END, {RANK}) = 1"""))
def _(spark, sf):
    out = FC.fallback_chain(frame(spark, sf), "SeasonalNaive")
    return out.select("node_id", "measure", "model_alias", "fallback_used", F.round(F.element_at("yhat", 1), 4).alias("first_yhat"))


@query("candidate_on_demand", S.q(fin_sql("ean"), """SELECT series_id AS node_id, measure, model_alias,
  CASE WHEN raw IS NULL THEN 'insufficient_history' ELSE 'ok' END AS status, round(CASE WHEN raw IS NOT NULL THEN greatest(raw[1], 0.0) END, 4) AS first_yhat
  FROM fmd WHERE model_alias = 'SeasonalNaive' AND measure = 'valor'"""))
def _(spark, sf):
    out = FC.candidate_on_demand(frame(spark, sf), F.col("measure") == "valor", "SeasonalNaive")
    return out.select("node_id", "measure", "model_alias", "status", F.round(F.try_element_at("yhat", F.lit(1)), 4).alias("first_yhat"))


@query("run_summary", S.q(fin_sql("ean"), """SELECT count(DISTINCT p.series_id) AS n_series, (SELECT count(*) FROM fin) AS n_predictions,
  count(DISTINCT p.series_id) - (SELECT count(DISTINCT node_id) FROM fin) AS n_failed,
  CASE WHEN (SELECT count(*) FROM fin) = 0 THEN 'failed' WHEN count(DISTINCT p.series_id) > (SELECT count(DISTINCT node_id) FROM fin) THEN 'partial' ELSE 'completed' END AS status
  FROM prep p"""))
def _(spark, sf):
    return FC.run_summary(values(spark, sf), predictions(spark, sf, "ean"))


POOLED = """, pairs AS (SELECT DISTINCT node_id, model_alias FROM fin),
ev AS (SELECT cv.*, yhat - y_actual AS e FROM cv SEMI JOIN pairs USING (node_id, model_alias) WHERE evaluated),
per AS (SELECT node_id, measure, model_alias, cutoff, count(*) AS c FROM ev GROUP BY ALL),
shape AS (SELECT measure, model_alias, count(*) AS n_folds, max(c) AS cv_horizon FROM per GROUP BY ALL)"""


@query("backtest_by_model", S.q(fin_sql("ean"), POOLED + """
SELECT ev.measure, ev.model_alias, round(avg(abs(e)), 7) AS mae, round(sqrt(avg(e * e)), 4) AS rmse,
  round(sum(abs(e)) / nullif(sum(abs(y_actual)), 0), 9) AS wape, round(avg(e), 7) AS bias, count(*) AS n_eval,
  any_value(n_folds) AS n_folds, any_value(cv_horizon) AS cv_horizon
FROM ev JOIN shape ON shape.measure = ev.measure AND shape.model_alias = ev.model_alias GROUP BY ev.measure, ev.model_alias""").replace(")\n, pairs", "),\npairs"))
def _(spark, sf):
    fr = frame(spark, sf)
    out = FC.backtest_by_model(FC.cv_predictions(fr), FC.final_forecast(fr, native_only=True))
    return metric_digits(out)


@query("eval_x_models", S.q(fin_sql("ean"), POOLED + "\nSELECT measure, model_alias, fold, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes FROM ev GROUP BY ALL").replace(")\n, pairs", "),\npairs"))
def _(spark, sf):
    fr = frame(spark, sf)
    pairs = FC.final_forecast(fr, native_only=True).select("node_id", "measure", "model_alias").distinct()
    rows = FC.of_pairs(FC.cv_predictions(fr).where("evaluated"), pairs)
    return rows.groupBy("measure", "model_alias", "fold").agg(
        F.count("*").alias("n_rows"), F.count_distinct("node_id").alias("n_nodes")
    )


@query("selected_backtest", S.q(cv_sql("ean"), f"""{SCORES}{SELECT} SELECT cv.measure, round(avg(abs(yhat - y_actual)), 7) AS mae,
  round(sum(abs(yhat - y_actual)) / sum(abs(y_actual)), 9) AS wape, round(avg(yhat - y_actual), 7) AS bias, count(*) AS n_eval
  FROM cv JOIN sel ON sel.node_id = cv.node_id AND sel.model_alias = cv.model_alias AND selected WHERE evaluated GROUP BY cv.measure""").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    cv = cv_rows(spark, sf)
    out = FC.selected_backtest(cv, FC.select_model(FC.score_models(cv), CONFIG)).drop("rmse")
    return metric_digits(out)


@query("pred_x_selected", S.q(fin_sql("marca"), f"""{SCORES}{SELECT} SELECT fin.measure, fin.ds, count(*) AS n_nodes, round(sum(fin.yhat), 4) AS total
  FROM fin JOIN sel ON sel.node_id = fin.node_id AND sel.model_alias = fin.model_alias AND selected GROUP BY ALL""").replace(")\n,\nsc", "),\nsc"))
def _(spark, sf):
    fr = frame(spark, sf, "marca")
    best = FC.best_model_per_node(FC.select_model(FC.score_models(FC.cv_predictions(fr)), CONFIG))
    rows = FC.final_forecast(fr, native_only=True).join(best.select("node_id", "measure", "model_alias"), ["node_id", "measure", "model_alias"])
    return rows.groupBy("measure", "ds").agg(F.count("*").alias("n_nodes"), F.round(F.sum("yhat"), 4).alias("total"))


def _fitted(alias: str, key: str):
    @query(key)
    def _(spark, sf):
        fr = fitters.fit_panel(panel(spark, sf, "marca"), {alias: fitters.FITTERS[alias]}, T.STUDY.season)
        rows = fr.where(F.col(f"fits.{alias}").isNotNull()).select(
            "series_id", "measure", "fold", "cutoff", F.posexplode(F.arrays_zip("eval_dates", F.col(f"fits.{alias}").alias("yhat"))).alias("step", "c")
        )
        return rows.select(
            "series_id", "measure", "fold", "cutoff", F.col("c.eval_dates").alias("ds"),
            F.round(models.floor_zero(F.col("c.yhat")), 4).alias("yhat"),
        )


for _alias, _key in (
    ("Holt", "holt"),
    ("HoltDamped", "holt_damped"),
    ("AutoETS", "auto_ets"),
    ("ETS_Damped", "ets_damped"),
    ("AutoTheta", "auto_theta"),
    ("AutoAR", "auto_ar"),
):
    _fitted(_alias, _key)


def median_of_last(y, h, season):
    """A user-supplied fitter: the median of the last cycle."""
    import numpy as np

    return np.repeat(np.median(y[:, -season:], axis=1)[:, None], h, axis=1)


@query("fit_panel", S.q(cv_sql("ean"), """SELECT series_id, measure, fold, round(list_median(ys[-12:]), 4) AS yhat FROM trp WHERE n >= 1"""))
def _(spark, sf):
    fr = fitters.fit_panel(panel(spark, sf, final=False), {"Median": median_of_last}, T.STUDY.season)
    return fr.where(F.col("fits.Median").isNotNull()).select(
        "series_id", "measure", "fold", F.round(F.element_at("fits.Median", 1), 4).alias("yhat")
    )


@query("model_label", S.q(cv_sql("marca"), """SELECT CASE model_alias WHEN 'Naive' THEN 'Último valor (Naive)' WHEN 'MediaMovel3' THEN 'Média móvel 3M'
 WHEN 'MediaMovel6' THEN 'Média móvel 6M' WHEN 'MediaMovel12' THEN 'Média móvel 12M' WHEN 'HistoricAverage' THEN 'Média histórica'
 WHEN 'SeasonalNaive' THEN 'Sazonal Naive (mesmo mês ano anterior)' WHEN 'RegLinearDrift' THEN 'Regressão / tendência linear (Drift)'
 WHEN 'CrostonSBA' THEN 'Demanda intermitente (Croston-SBA)' WHEN 'TSB' THEN 'Demanda intermitente (TSB)' ELSE model_alias END AS label,
 count(*) AS n_rows FROM cv GROUP BY ALL"""))
def _(spark, sf):
    rows = cv_rows(spark, sf, "marca").select(text.model_label(F.col("model_alias")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"))
