"""MAT, cards, KPIs, curves, exceptions, filters, exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks import sql as S
from checks.q_forecast import CONFIG, RANK, SCORES, SELECT, ZERO, cv_sql, fin_sql, frame, metric_digits, panel, predictions, rounded, values
from checks.q_hierarchy import BRIDGE, ENT, PERIODS, SCENARIOS, UNTIED, WITH_TOTAL, bridge
from checks.q_ingest import canonical
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.config import HierarchyConfig
from seriesmill.functions.periods import shift_date
from seriesmill.functions.text import chip_label
from seriesmill.operators import backtest as FC
from seriesmill.operators import hierarchy as H
from seriesmill.operators import mat as M
from seriesmill.operators import outcome as O
from seriesmill.operators import scenarios as SC
from seriesmill.plans import candidates
from seriesmill.plans import exports as X
from seriesmill.plans import forecast_run as RUN
from seriesmill.plans import views as V
from seriesmill.session import scratch_dir
from seriesmill.sources import store

GRID = [shift_date(T.HISTORY_END, k) for k in range(-59, 1)]
DIMS = ["tipo", "marca", "ean"]


def history(spark, sf, grain="marca"):
    return V.leaf_history(values(spark, sf, grain))


def fix(sql):
    return sql.replace(")\n,\nsc", "),\nsc")


MAT_SQL = """, mh0 AS (
  SELECT series_id AS node_id, measure, ds, sum(greatest(y, 0)) OVER w AS mat, count(*) OVER w AS c, min(ds) OVER w AS lo
  FROM prep WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
mh AS (SELECT node_id, measure, ds, mat FROM mh0 WHERE c = 12 AND lo = ds - INTERVAL 11 MONTH)"""

MATF_SQL = MAT_SQL + """,
cur AS (SELECT DISTINCT node_id, measure, model_alias FROM fin),
mix AS (SELECT c.node_id, c.measure, c.model_alias, p.ds, p.y AS v, FALSE AS f FROM cur c JOIN prep p ON p.series_id = c.node_id
        UNION ALL SELECT node_id, measure, model_alias, ds, yhat, TRUE FROM fin),
mf0 AS (SELECT *, sum(greatest(v, 0)) OVER w AS mat, count(*) OVER w AS c, min(ds) OVER w AS lo
        FROM mix WINDOW w AS (PARTITION BY node_id, model_alias ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
mf AS (SELECT node_id, measure, model_alias, ds, mat FROM mf0 WHERE f AND c = 12 AND lo = ds - INTERVAL 11 MONTH)"""


@query("rolling_mat_history", S.q(S.prep("ean"), MAT_SQL + " SELECT node_id, measure, ds, round(mat, 2) AS mat FROM mh").replace(")\n, mh0", "),\nmh0"))
def _(spark, sf):
    out = M.mat_history(history(spark, sf, "ean").select("node_id", "measure", "ds", "y"))
    return rounded(out, "mat", digits=2)


@query("rolling_mat_forecast", S.q(fin_sql("marca"), MATF_SQL + " SELECT node_id, measure, model_alias, ds, round(mat, 4) AS mat FROM mf").replace(")\n, mh0", "),\nmh0"))
def _(spark, sf):
    out = M.mat_forecast(history(spark, sf).select("node_id", "measure", "ds", "y"), predictions(spark, sf))
    return rounded(out.drop("scenario_id"), "mat")


@query("mat_direct", S.q(fin_sql("marca"), "SELECT node_id, measure, model_alias, ds, round(yhat, 4) AS mat FROM fin"))
def _(spark, sf):
    return rounded(M.mat_direct(predictions(spark, sf)).drop("scenario_id"), "mat")


@query("mat_cards", S.q(fin_sql("marca"), MATF_SQL + """,
 lf AS (SELECT node_id, measure, model_alias, arg_max(mat, ds) AS a FROM mf GROUP BY ALL),
 lh AS (SELECT node_id, arg_max(mat, ds) AS b FROM mh GROUP BY ALL)
 SELECT measure, model_alias, count(*) AS n_nodes, round(sum(a), 4) AS mat_final, round(sum(b), 4) AS mat_history,
        round((sum(a) - sum(b)) / sum(b), 8) AS mat_variation FROM lf LEFT JOIN lh USING (node_id) GROUP BY ALL""").replace(")\n, mh0", "),\nmh0"))
def _(spark, sf):
    out = M.mat_cards(history(spark, sf).select("node_id", "measure", "ds", "y"), predictions(spark, sf)).drop("scenario_id")
    return rounded(rounded(out, "mat_final", "mat_history"), "mat_variation", digits=8)


@query("mat_join", S.q(fin_sql("marca"), MATF_SQL + """
 SELECT 'historico' AS tipo, measure, ds, count(*) AS n_rows, round(sum(mat), 4) AS total FROM mh GROUP BY ALL
 UNION ALL SELECT 'previsao', measure, ds, count(*), round(sum(mat), 4) FROM mf GROUP BY ALL""").replace(")\n, mh0", "),\nmh0"))
def _(spark, sf):
    out = _mat_long(spark, sf)
    return out.groupBy("tipo", "measure", "ds").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("valor"), 4).alias("total")
    )


def _mat_long(spark, sf):
    ents = T.entities(spark, sf, "marca").withColumnRenamed("tipo", "linha")
    return X.export_long(
        history(spark, sf), predictions(spark, sf), ents, ["linha", "marca"],
        {"run_id": "r", "preparation_id": "p", "dataset_id": "d"}, mat=True,
    )


@query("node_history", f"WITH {S.prep('ean').strip()},{BRIDGE} SELECT node_id, measure, ds, round(sum(y), 2) AS y, bool_and(observed) AS observed, bool_or(was_adjusted) AS was_adjusted FROM prep JOIN bridge USING (entity_id) WHERE level < 2 GROUP BY ALL")
def _(spark, sf):
    return rounded(V.node_history(values(spark, sf), H.ancestors(T.entities(spark, sf), WITH_TOTAL)), "y", digits=2)


CHOSEN = f"""WITH {S.prep('ean').strip()},{BRIDGE},
 own AS (SELECT DISTINCT series_id FROM prep JOIN entities USING (entity_id) WHERE ean LIKE '%77'),
 top AS (SELECT DISTINCT node_id FROM bridge WHERE level = 0 AND level_name IN ('ECONOMY', 'SMALL'))"""


@query("chosen_history", CHOSEN + """ SELECT node_id, measure, ds, round(sum(y), 2) AS y, bool_and(observed) AS observed, bool_or(was_adjusted) AS was_adjusted
 FROM prep JOIN bridge USING (entity_id) WHERE node_id IN (SELECT node_id FROM top) GROUP BY ALL
 UNION ALL SELECT series_id, measure, ds, round(y, 2), observed, was_adjusted FROM prep WHERE series_id IN (SELECT series_id FROM own)""")
def _(spark, sf):
    """Two nodes of the hierarchy and some ids of series, asked for together."""
    vals, ents = values(spark, sf), T.entities(spark, sf)
    tops = H.node_bridge(ents, T.HIERARCHY).where("level = 0 AND level_name IN ('ECONOMY', 'SMALL')").select("node_id").distinct()
    few = vals.join(ents.where(F.col("ean").endswith("77")).select("entity_id"), "entity_id").select("series_id").distinct()
    asked = tops.unionAll(few.withColumnRenamed("series_id", "node_id"))
    return rounded(V.chosen_history(vals, H.ancestors(ents, T.HIERARCHY), asked), "y", digits=2)


@query("selection_table", fix(S.q(fin_sql("ean"), f"""{SCORES}{SELECT},
 clip AS (SELECT series_id AS node_id, model_alias, len(list_filter(raw, lambda v: v < 0)) AS n FROM fmd)
 SELECT sel.node_id, sel.measure, sel.model_alias, selection_reason, CAST(3 AS INTEGER) AS cv_horizon, n_folds, FALSE AS fallback_used, coalesce(n, 0) AS clipped_count
 FROM sel LEFT JOIN clip ON clip.node_id = sel.node_id AND clip.model_alias = sel.model_alias WHERE selected""")))
def _(spark, sf):
    fr = frame(spark, sf)
    picked = FC.select_model(FC.score_models(FC.cv_predictions(fr)), CONFIG)
    return O.selection(picked, O.final_values(fr), CONFIG.resolved_cv_horizon(T.STUDY))


@query("view_cards", S.q(fin_sql("ean"), """
, a AS (SELECT measure, model_alias, count(DISTINCT node_id) AS n_nodes, count(*) AS forecast_rows, sum(yhat) AS tf, min(ds) AS first, count(DISTINCT ds) AS span FROM fin GROUP BY ALL),
h AS (SELECT measure, ds, sum(y) AS y FROM prep GROUP BY ALL)
SELECT a.measure, model_alias, n_nodes, forecast_rows, round(tf, 4) AS total_forecast, round(sum(y), 4) AS total_history,
  round((tf - sum(y)) / sum(y), 8) AS variation
FROM a LEFT JOIN h ON h.measure = a.measure AND h.ds < first AND h.ds >= first - to_months(CAST(span AS INTEGER))
GROUP BY a.measure, model_alias, n_nodes, forecast_rows, tf""").replace(")\n, a AS", "),\na AS"))
def _(spark, sf):
    out = V.view_cards(predictions(spark, sf, "ean"), history(spark, sf, "ean")).drop("scenario_id")
    return rounded(rounded(out, "total_forecast", "total_history"), "variation", digits=8)


@query("equivalent_history_variation", S.q(fin_sql("ean"), """
, h AS (SELECT measure, sum(y) AS y FROM (SELECT * FROM (SELECT measure, ds, sum(y) AS y FROM prep GROUP BY measure, ds)
        QUALIFY row_number() OVER (PARTITION BY measure ORDER BY ds DESC) <= 12) GROUP BY measure)
SELECT measure, model_alias, round(sum(yhat), 4) AS total_forecast, round(any_value(y), 4) AS equivalent_history,
  round(sum(yhat) / any_value(y) - 1, 8) AS variation FROM fin JOIN h USING (measure) GROUP BY ALL""").replace(")\n, h AS", "),\nh AS"))
def _(spark, sf):
    out = V.equivalent_history_variation(predictions(spark, sf, "ean"), history(spark, sf, "ean"), 12)
    return rounded(rounded(out, "total_forecast", "equivalent_history"), "variation", digits=8)


def kpi_sql(src: str, key: str) -> str:
    return f"""
k0 AS (SELECT {key} AS item, measure, ds, sum(y) AS y FROM {src} GROUP BY ALL),
k1 AS (SELECT *, row_number() OVER (PARTITION BY item, measure ORDER BY ds DESC) AS r, count(*) OVER (PARTITION BY item, measure) AS n FROM k0),
k2 AS (SELECT item, measure, count(*) AS n, date_diff('month', min(ds), max(ds)) + 1 = count(*) AS dense,
         sum(CASE WHEN r <= 12 THEN y END) AS m, sum(CASE WHEN r > 12 AND r <= 24 THEN y END) AS p,
         sum(CASE WHEN r > 12 * (n // 12 - 1) AND r <= 12 * (n // 12) THEN y END) AS f,
         max(y) AS mx, arg_max(ds, (y, -epoch(ds))) AS mxd, min(y) AS mn, arg_min(ds, (y, epoch(ds))) AS mnd, stddev_samp(y) AS sd
       FROM k1 GROUP BY item, measure),
kpi AS (SELECT item, measure, n AS hist_months, CASE WHEN dense AND n >= 12 THEN m END AS mat,
         CASE WHEN dense AND n >= 24 THEN (m - p) / nullif(p, 0) END AS yoy,
         CASE WHEN dense AND n >= 36 AND f > 0 AND m >= 0 THEN pow(m / f, 1.0 / (n // 12 - 1)) - 1 END AS cagr,
         CASE WHEN dense AND n >= 36 AND f > 0 AND m >= 0 THEN n // 12 - 1 END AS cagr_years,
         mx AS max, mxd AS max_ds, mn AS min, mnd AS min_ds, sd AS std, sd / sqrt(n) AS sem FROM k2)"""


KPI_COLS = """item, measure, hist_months, round(mat, 2) AS mat, round(yoy, 8) AS yoy, round(cagr, 8) AS cagr, cagr_years,
 round(max, 2) AS max, max_ds, round(min, 2) AS min, min_ds, round(std, 4) AS std, round(sem, 4) AS sem"""


def kpi_round(df):
    return rounded(rounded(rounded(df, "mat", "max", "min", digits=2), "yoy", "cagr", digits=8), "std", "sem")


@query("history_kpis", f"WITH {S.prep('ean').strip()},{kpi_sql('prep', 'series_id')} SELECT {KPI_COLS} FROM kpi")
def _(spark, sf):
    rows = history(spark, sf, "ean").select(F.col("node_id").alias("item"), "measure", "ds", "y")
    return kpi_round(V.history_kpis(rows, ["item", "measure"]))


VOL = """, vol AS (SELECT series_id AS node_id, sum(y) AS volume_12m, count(*) AS n, count_if(y = 0) AS n_zeros FROM
 (SELECT * FROM prep QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 12) GROUP BY ALL)"""


@query("volume_12m", S.q(S.prep("ean"), VOL + " SELECT node_id, round(volume_12m, 2) AS volume_12m, n, n_zeros FROM vol").replace(")\n, vol", "),\nvol"))
def _(spark, sf):
    return rounded(V.volume_12m(history(spark, sf, "ean")).drop("measure"), "volume_12m", digits=2)


@query("exceptions_topk", fix(S.q(cv_sql("ean"), f"""{SCORES}{SELECT}{VOL}
SELECT sel.node_id, measure, model_alias, round(wape, 9) AS wape, round(volume_12m, 2) AS volume_12m, round(volume_12m * wape, 4) AS score,
  CASE WHEN wape >= 0.3 THEN 'erro alto no backtest (WAPE ' || CAST(round_even(wape * 100, 0) AS INTEGER) || '%)' ||
            CASE WHEN n_zeros / n >= 0.6 THEN '; muitos zeros no histórico' ELSE '' END
       WHEN n_zeros / n >= 0.6 THEN 'muitos zeros no histórico' ELSE 'maior impacto (volume × erro) da rodada' END AS reason
FROM sel JOIN vol USING (node_id) WHERE selected ORDER BY volume_12m * wape DESC, node_id LIMIT 20""")))
def _(spark, sf):
    fr = frame(spark, sf, final=False)
    scores = FC.select_model(FC.score_models(FC.cv_predictions(fr)), CONFIG)
    out = V.exceptions_topk(scores, history(spark, sf, "ean"), 20)
    return rounded(rounded(rounded(out, "wape", digits=9), "volume_12m", digits=2), "score")


def view(spark, sf, dimension="tipo", **kw):
    fr = frame(spark, sf, limits=True)
    cv = FC.cv_predictions(fr)
    scores = FC.select_model(FC.score_models(cv), CONFIG)
    return V.series_view(values(spark, sf), FC.final_forecast(fr, native_only=True), cv, scores, T.entities(spark, sf), dimension, **kw)


VIEW = f"WITH {fin_sql('ean').strip()}{SCORES}{SELECT},{ENT}"
VIEW = fix(VIEW)


@query("series_view", VIEW + """ SELECT tipo AS item, f.measure, f.ds, round(sum(yhat), 4) AS yhat, count(*) AS n_series
 FROM fin f JOIN sel s ON s.node_id = f.node_id AND s.model_alias = f.model_alias AND selected JOIN entities e ON e.entity_id = f.entity_id GROUP BY ALL""")
def _(spark, sf):
    out = view(spark, sf)["forecast"].drop("lo80", "hi80")
    return rounded(out, "yhat")


@query("series_view_kpis", VIEW + f""", hx AS (SELECT prep.*, tipo FROM prep JOIN entities USING (entity_id)),{kpi_sql('hx', 'tipo')},
 er AS (SELECT tipo AS item, cv.measure, sum(abs(yhat - y_actual)) / sum(abs(y_actual)) AS wape_pooled, avg(yhat - y_actual) AS bias, count(*) AS n_eval
        FROM cv JOIN sel s ON s.node_id = cv.node_id AND s.model_alias = cv.model_alias AND selected JOIN entities e ON e.entity_id = cv.entity_id WHERE evaluated GROUP BY ALL),
 tt AS (SELECT tipo AS item, f.measure, sum(yhat) AS horizon_total, count(DISTINCT f.node_id) AS n_series FROM fin f
        JOIN sel s ON s.node_id = f.node_id AND s.model_alias = f.model_alias AND selected JOIN entities e ON e.entity_id = f.entity_id GROUP BY ALL)
 SELECT {KPI_COLS}, round(horizon_total, 4) AS horizon_total, n_series, round(wape_pooled, 9) AS wape_pooled, round(bias, 7) AS bias, n_eval
 FROM kpi JOIN tt USING (item, measure) JOIN er USING (item, measure)""")
def _(spark, sf):
    out = kpi_round(view(spark, sf)["kpis"])
    return rounded(rounded(rounded(out, "horizon_total"), "wape_pooled", digits=9), "bias", digits=7)


@query("series_view_alternatives", VIEW + f""", mm AS (SELECT tipo AS item, s.measure, s.model_alias, avg(wape) AS wape_mean, count(*) AS n_series
  FROM sel s JOIN (SELECT DISTINCT series_id, entity_id FROM prep) p ON p.series_id = s.node_id JOIN entities e ON e.entity_id = p.entity_id
  WHERE eligible GROUP BY ALL)
 SELECT item, measure, model_alias, round(wape_mean, 9) AS wape_mean, n_series,
  row_number() OVER (PARTITION BY item, measure ORDER BY wape_mean, {RANK}) AS place FROM mm QUALIFY place <= 3""")
def _(spark, sf):
    return metric_digits(view(spark, sf)["alternatives"])


@query("compare_items", VIEW + """ SELECT marca AS item, f.measure, f.ds, round(sum(yhat), 4) AS yhat, count(*) AS n_series
 FROM fin f JOIN entities e ON e.entity_id = f.entity_id WHERE f.model_alias = 'HistoricAverage' GROUP BY ALL""")
def _(spark, sf):
    out = view(spark, sf, "marca", model="HistoricAverage")["forecast"].drop("lo80", "hi80")
    return rounded(out, "yhat")


@query("series_by_model", VIEW + """, er AS (SELECT tipo AS item, cv.measure, model_alias, sum(abs(yhat - y_actual)) / sum(abs(y_actual)) AS w
   FROM cv JOIN entities USING (entity_id) WHERE evaluated GROUP BY ALL)
 SELECT tipo AS item, f.measure, f.model_alias, f.ds, round(sum(yhat), 4) AS yhat, count(*) AS n_series, round(any_value(w), 9) AS wape_pooled
 FROM fin f JOIN entities e ON e.entity_id = f.entity_id LEFT JOIN er ON er.item = tipo AND er.measure = f.measure AND er.model_alias = f.model_alias
 GROUP BY tipo, f.measure, f.model_alias, f.ds""")
def _(spark, sf):
    out = V.series_by_model_panel(frame(spark, sf), T.entities(spark, sf), "tipo", len(PERIODS))
    return rounded(rounded(out, "yhat"), "wape_pooled", digits=9)


@query("series_by_model_stored", VIEW + " SELECT tipo AS item, f.measure, f.model_alias, count(*) AS n_rows, round(sum(yhat), 4) AS yhat FROM fin f JOIN entities e ON e.entity_id = f.entity_id GROUP BY ALL")
def _(spark, sf):
    """The same from stored predictions and backtest rows."""
    fr = frame(spark, sf)
    out = V.series_by_model(FC.final_forecast(fr, native_only=True), FC.cv_predictions(fr), T.entities(spark, sf), "tipo")
    return out.groupBy("item", "measure", "model_alias").agg(F.sum("n_series").alias("n_rows"), F.round(F.sum("yhat"), 4).alias("yhat"))


PIVOT = ", ".join(f"""round(sum(CASE WHEN ds = DATE '{p.isoformat()}' THEN yhat END), 4) AS "{p.strftime('%Y-%m')}" """ for p in PERIODS)


@query("executive_table", VIEW + f" SELECT marca AS item, measure, {PIVOT} FROM fin JOIN entities USING (entity_id) WHERE model_alias = 'Naive' GROUP BY ALL")
def _(spark, sf):
    out = V.executive_table(predictions(spark, sf, "ean"), T.entities(spark, sf), "marca", "Naive", PERIODS)
    return rounded(out, *[p.strftime("%Y-%m") for p in PERIODS])


@query("filter_by_dimensions", S.q(BRIDGE, "SELECT DISTINCT node_id FROM bridge SEMI JOIN (SELECT entity_id FROM entities WHERE lower(tipo) IN ('economy', 'small') AND lower(marca) = 'brand#2') USING (entity_id)"))
def _(spark, sf):
    return V.filter_by_dimensions(T.entities(spark, sf), bridge(spark, sf), {"tipo": ("Economy", "SMALL"), "marca": ("brand#2",)})


@query("coverage_intersection", S.q(BRIDGE, "SELECT level, count(DISTINCT node_id) AS n FROM bridge SEMI JOIN (SELECT entity_id FROM entities WHERE lower(tipo) = 'economy') USING (entity_id) GROUP BY level"))
def _(spark, sf):
    b = bridge(spark, sf)
    nodes = V.filter_by_dimensions(T.entities(spark, sf), b, {"tipo": ("economy",)})
    return b.select("node_id", "level").distinct().join(nodes, "node_id", "left_semi").groupBy("level").agg(F.count("*").alias("n"))


@query("query_predictions", S.q(fin_sql("marca"), """SELECT node_id, measure, model_alias, ds, round(yhat, 4) AS yhat FROM fin
 WHERE measure = 'valor' AND model_alias = 'SeasonalNaive' AND ds BETWEEN DATE '2001-10-01' AND DATE '2002-03-01' AND contains(node_id, 'a1')"""))
def _(spark, sf):
    flt = V.ResultFilter(measure="valor", model_alias="SeasonalNaive", start=date(2001, 10, 1), end=date(2002, 3, 1), node_contains="A1")
    out = V.query_predictions(predictions(spark, sf), flt).select("node_id", "measure", "model_alias", "ds", "yhat")
    return rounded(out, "yhat")


def run_tables(spark, sf):
    fr = frame(spark, sf, "marca")
    cv = FC.cv_predictions(fr)
    return {
        "values": values(spark, sf, "marca"),
        "cv": cv,
        "scores": FC.select_model(FC.score_models(cv), CONFIG),
        "predictions": FC.final_forecast(fr, native_only=True),
    }


@query("dashboard_query", fix(S.q(cv_sql("marca"), """SELECT model_alias, round(avg(abs(yhat - y_actual)), 7) AS mae,
 round(sum(abs(yhat - y_actual)) / sum(abs(y_actual)), 9) AS wape, round(avg(yhat - y_actual), 7) AS bias, count(*) AS n_eval,
 2 * count(DISTINCT node_id) AS n_folds, CAST(3 AS BIGINT) AS cv_horizon
 FROM cv WHERE evaluated AND measure = 'valor' GROUP BY ALL""")))
def _(spark, sf):
    flt = V.ResultFilter(measure="valor", level="folha")
    ents = T.entities(spark, sf, "marca")
    out = V.dashboard_query(run_tables(spark, sf), ents, None, flt)["metrics"]
    return metric_digits(out.drop("measure", "rmse"))


@query("dashboard_cards", S.q(fin_sql("marca"), """
SELECT model_alias, count(DISTINCT node_id) AS n_nodes, count(*) AS forecast_rows, round(sum(yhat), 4) AS total_forecast,
 round((SELECT sum(y) FROM prep WHERE measure = 'valor' AND ds > DATE '2000-08-01'), 4) AS total_history FROM fin WHERE measure = 'valor' GROUP BY ALL"""))
def _(spark, sf):
    flt = V.ResultFilter(measure="valor")
    out = V.dashboard_query(run_tables(spark, sf), T.entities(spark, sf, "marca"), None, flt)["cards"]
    return rounded(out.drop("measure", "scenario_id", "variation"), "total_forecast", "total_history")


@query("pred_nodes", S.q(fin_sql("marca"), "SELECT measure, 'folha' AS node_level, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM fin GROUP BY ALL"))
def _(spark, sf):
    nodes = values(spark, sf, "marca").select(
        F.col("series_id").alias("node_id"), F.lit("folha").alias("level"), "entity_id"
    ).distinct()
    out = V.pred_nodes(predictions(spark, sf), nodes)
    return out.groupBy("measure", "node_level").agg(
        F.count("*").alias("n_rows"), F.count_distinct("node_entity").alias("n_entities")
    )


@query("node_dims", f"WITH {fin_sql('ean').strip()},{ENT} SELECT tipo, marca, measure, count(*) AS n_rows FROM fin LEFT JOIN entities USING (entity_id) GROUP BY ALL")
def _(spark, sf):
    out = V.node_dims(predictions(spark, sf, "ean"), T.entities(spark, sf), ["tipo", "marca"])
    return out.groupBy("tipo", "marca", "measure").agg(F.count("*").alias("n_rows"))


@query("dimension_values", S.q(ENT, "SELECT 'tipo' AS dimension, tipo AS value FROM entities UNION SELECT 'marca', marca FROM entities UNION SELECT 'ean', ean FROM entities"))
def _(spark, sf):
    return V.dimension_values(T.entities(spark, sf))


@query("search_items", S.q(ENT, "SELECT DISTINCT marca AS value FROM entities WHERE contains(lower(marca), 'd#1')"))
def _(spark, sf):
    return V.search_items(T.entities(spark, sf), "marca", "D#1")


@query("cascade_items", S.q(ENT, "SELECT DISTINCT marca AS value FROM entities WHERE tipo IN ('ECONOMY', 'PROMO')"))
def _(spark, sf):
    return V.cascade_items(T.entities(spark, sf), "tipo", ("ECONOMY", "PROMO"), "marca")


@query("distinct_scenarios", UNTIED + " SELECT DISTINCT scenario_id FROM app UNION SELECT 'base' FROM fin")
def _(spark, sf):
    base = predictions(spark, sf)
    more, _, _ = SC.generate_scenarios(base, T.entities(spark, sf, "marca"), SCENARIOS, PERIODS, {"r-price": "price"})
    return V.distinct_scenarios(base.unionByName(more.drop("factor")))


@query("distinct_measures", S.q(S.prep("marca"), "SELECT DISTINCT measure FROM prep"))
def _(spark, sf):
    return V.distinct_measures(values(spark, sf, "marca"))


IDS = {"run_id": "r1", "preparation_id": "p1", "dataset_id": "d1"}
MENT = f"""ments AS (SELECT tipo AS linha, marca, {S.entity_id(["tipo", "marca"])} AS entity_id FROM (SELECT DISTINCT tipo, marca FROM m_marca))"""
LONG = f"""WITH {fin_sql("marca").strip()},{MENT},
lng AS (
  SELECT series_id AS node_id, entity_id, measure, NULL AS scenario_id, ds, 'historico' AS tipo, y AS valor, observed AS observado, was_adjusted AS ajustado, NULL AS model_alias FROM prep
  UNION ALL SELECT node_id, entity_id, measure, 'base', ds, 'previsao', yhat, NULL, NULL, model_alias FROM fin)"""


def long_table(spark, sf):
    ents = T.entities(spark, sf, "marca").withColumnRenamed("tipo", "linha")
    return X.export_long(history(spark, sf), predictions(spark, sf), ents, ["linha", "marca"], IDS)


@query("export_long", LONG + """ SELECT linha, marca, node_id, 'folha' AS level, entity_id, measure, scenario_id, ds, tipo, round(valor, 4) AS valor,
 observado, ajustado, model_alias, 'r1' AS run_id FROM lng LEFT JOIN ments USING (entity_id)""")
def _(spark, sf):
    out = long_table(spark, sf).select(
        "linha", "marca", "node_id", "level", "entity_id", "measure", "scenario_id", "ds", "tipo", "valor",
        "observado", "ajustado", "model_alias", "run_id",
    )
    return rounded(out, "valor")


@query("union_history_forecast", LONG + " SELECT tipo, measure, ds, count(*) AS n_rows, round(sum(valor), 4) AS total FROM lng GROUP BY ALL")
def _(spark, sf):
    return long_table(spark, sf).groupBy("tipo", "measure", "ds").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("valor"), 4).alias("total")
    )


@query("sorted_export", LONG + " SELECT node_id, measure, ds, tipo, model_alias FROM lng ORDER BY 1, 2, 3, 4, 5")
def _(spark, sf):
    return X.sorted_export(long_table(spark, sf)).select("node_id", "measure", "ds", "tipo", "model_alias")


WIDE_H = ", ".join(f"""max(CASE WHEN tipo = 'historico' AND ds = DATE '{d}' THEN round(valor, 4) END) AS "historico_{d}" """ for d in GRID)
WIDE_P = ", ".join(f"""max(CASE WHEN tipo = 'previsao' AND ds = DATE '{d}' THEN round(valor, 4) END) AS "previsao_{d}" """ for d in PERIODS)


@query("to_wide", LONG + f""" SELECT linha, marca, node_id, 'folha' AS level, entity_id, measure, {WIDE_H}, {WIDE_P}, max(model_alias) AS model_alias, 'ok' AS status
 FROM lng LEFT JOIN ments USING (entity_id) WHERE tipo = 'historico' OR model_alias = 'SeasonalNaive' GROUP BY linha, marca, node_id, entity_id, measure""")
def _(spark, sf):
    out = X.to_wide(long_table(spark, sf), ["linha", "marca"], GRID, PERIODS, "SeasonalNaive")
    cells = [c for c in out.columns if c.startswith(("historico_", "previsao_"))]
    return rounded(out, *cells)


BYNODE = ", ".join(f"""round(sum(CASE WHEN ds = DATE '{d}' THEN yhat END), 4) AS "{d.strftime('%Y%m')}" """ for d in PERIODS)


@query("wide_by_node", S.q(fin_sql("marca"), f"SELECT node_id, measure, model_alias, {BYNODE} FROM fin GROUP BY ALL"))
def _(spark, sf):
    out = X.wide_by_node(predictions(spark, sf), ["node_id", "measure", "model_alias"], "yhat", PERIODS)
    return rounded(out, *[p.strftime("%Y%m") for p in PERIODS])


@query("scores_frame", fix(f"""WITH {cv_sql("ean").strip()}{SCORES}{SELECT},{ENT},
 ow AS (SELECT DISTINCT series_id, entity_id FROM prep)
 SELECT tipo, marca, ean, node_id, measure, model_alias, round(mae, 7) AS mae, n_eval, n_folds, selected, selection_reason
 FROM sel JOIN ow ON series_id = node_id JOIN entities USING (entity_id)"""))
def _(spark, sf):
    fr = frame(spark, sf, final=False)
    cv = FC.cv_predictions(fr)
    scores = FC.select_model(FC.score_models(cv), CONFIG)
    out = X.scores_frame(scores, cv, T.entities(spark, sf), DIMS).drop("rmse", "wape", "bias")
    return metric_digits(out)


@query("quality_frame", S.q(S.canon_long(), "SELECT code, severity, row_key AS source_row_id FROM issues"))
def _(spark, sf):
    return X.quality_frame(canonical(spark, sf).issues).select("code", "severity", "source_row_id")


@query("template_rows", f"""WITH {ENT} SELECT tipo, marca, ean, strftime(DATE '2001-08-01' + to_months(CAST(i + 1 AS INTEGER)), '%Y-%m') AS periodo,
 10 * (i + 1) + 1 AS unidades, (10 * (i + 1) + 1) * 1.5 AS valor FROM entities, range(0, 12) t(i)""")
def _(spark, sf):
    ents = T.entities(spark, sf).select(*DIMS)
    return X.template_rows(ents, PERIODS)


@query("template_wide", f"""WITH {ENT} SELECT tipo, marca, ean, m AS medida, {", ".join(f"CASE WHEN m = 'unidades' THEN {10 + j} ELSE {(10 + j) * 1.5} END AS \"{p.strftime('%Y-%m')}\"" for j, p in enumerate(PERIODS))}
 FROM entities, (VALUES ('unidades'), ('valor')) t(m)""")
def _(spark, sf):
    return X.template_wide(T.entities(spark, sf).select(*DIMS), PERIODS, ("unidades", "valor"))


@query("sink_long_csv", LONG + " SELECT tipo, count(*) AS n_rows, round(sum(round(valor, 4)), 2) AS total FROM lng GROUP BY ALL")
def _(spark, sf):
    path = scratch_dir(spark, "long_csv")
    X.write_csv(rounded(long_table(spark, sf), "valor"), path)
    back = spark.read.csv(path, sep=";", header=True)
    return back.groupBy("tipo").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.col("valor").cast("double")), 2).alias("total"))


@query("sink_wide_by_model", S.q(fin_sql("marca"), "SELECT model_alias, count(DISTINCT (node_id, measure)) AS n_rows, round(sum(yhat) FILTER (ds = DATE '2001-12-01'), 4) AS december FROM fin GROUP BY ALL"))
def _(spark, sf):
    path = scratch_dir(spark, "by_model")
    X.write_by_model(X.wide_by_node(predictions(spark, sf), ["node_id", "measure", "model_alias"], "yhat", PERIODS), path)
    back = spark.read.parquet(path).groupBy("model_alias")
    return back.agg(F.count("*").alias("n_rows"), F.round(F.sum("200112"), 4).alias("december"))


@query("sink_metrics", fix(S.q(cv_sql("marca"), f"{SCORES} SELECT model_alias, count(*) AS n_rows, round(sum(round(mae, 4)), 2) AS total FROM sc GROUP BY ALL")))
def _(spark, sf):
    path = scratch_dir(spark, "metrics_csv")
    scores = FC.score_models(FC.cv_predictions(frame(spark, sf, "marca", final=False)))
    X.write_csv(rounded(scores, "mae"), path)
    back = spark.read.csv(path, sep=";", header=True)
    return back.groupBy("model_alias").agg(F.count("*").alias("n_rows"), F.round(F.sum(F.col("mae").cast("double")), 2).alias("total"))


@query("sink_quality", S.q(S.canon_long(), "SELECT code, severity, row_key AS source_row_id FROM issues"))
def _(spark, sf):
    path = scratch_dir(spark, "quality_csv")
    X.write_csv(X.quality_frame(canonical(spark, sf).issues), path)
    return spark.read.csv(path, sep=";", header=True).select("code", "severity", "source_row_id")


@query("chip_label", S.q(ENT, "SELECT entity_id, tipo || ' / ' || marca || ' / ' || ean AS label FROM entities"))
def _(spark, sf):
    return T.entities(spark, sf).select("entity_id", chip_label([F.col(d) for d in DIMS]).alias("label"))


RECON_MARCA = f"""{fin_sql("marca")}, tm AS (SELECT DISTINCT p_type AS tipo, p_brand AS marca FROM part SEMI JOIN lineitem ON l_partkey = p_partkey),
 ent2 AS (SELECT *, {S.entity_id(["tipo", "marca"])} AS entity_id FROM tm),
 agg AS (SELECT tipo, measure, ds, model_alias, sum(yhat) AS yhat FROM fin JOIN ent2 USING (entity_id) GROUP BY GROUPING SETS ((measure, ds, model_alias), (tipo, measure, ds, model_alias))),
 rec AS (SELECT coalesce(tipo, 'Total') AS node_id, * EXCLUDE (tipo) FROM agg),
 nn AS (SELECT count(*) + count(DISTINCT tipo) + 1 AS n FROM tm)"""


@query("persist_run", S.q(fin_sql("marca"), "SELECT node_id, measure, model_alias, ds, round(yhat, 6) AS yhat FROM fin"))
def _(spark, sf):
    """Half of a run first, then all of it: the stored run is the whole one, each key once."""
    root = scratch_dir(spark, "runs")
    rows = predictions(spark, sf)
    store.persist_run({"predictions": rows.where("measure = 'valor'").withColumn("yhat", F.lit(-1.0))}, root, "r1")
    store.persist_run({"predictions": rows}, root, "r1")
    store.persist_run({"predictions": rows.limit(5)}, root, "r2")
    back = store.load_run(spark, root, "r1", "predictions")
    return rounded(back.select("node_id", "measure", "model_alias", "ds", "yhat"), "yhat", digits=6)


@query("save_preparation", S.q(S.prep("marca"), "SELECT adjustment_reason, count(*) AS n_rows, round(sum(y), 2) AS total FROM prep GROUP BY ALL"))
def _(spark, sf):
    """Saved twice under one content key; the second time nothing is written."""
    root = scratch_dir(spark, "preparations")
    vals = values(spark, sf, "marca")
    assert store.save_preparation(vals, root, "p1")
    assert not store.save_preparation(vals.where(F.lit(False)), root, "p1")
    back = store.load_preparation(spark, root, "p1")
    return back.groupBy("adjustment_reason").agg(F.count("*").alias("n_rows"), F.round(F.sum("y"), 2).alias("total"))


@query("stored_run", f"""WITH {RECON_MARCA}
SELECT 'predictions' AS name, count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes, round(sum(yhat), 2) AS total, 'completed' AS status, 12 AS horizon FROM fin
UNION ALL SELECT 'aggregates', count(*), count(DISTINCT node_id), round(sum(yhat), 2), 'completed', 12 FROM rec
UNION ALL SELECT 'cv', count(*), count(DISTINCT node_id), round(sum(yhat), 2), 'completed', 12 FROM cv
UNION ALL SELECT 'scores', count(*), count(DISTINCT node_id), NULL, 'completed', 12 FROM (SELECT DISTINCT node_id, measure, model_alias FROM cv)
UNION ALL SELECT 'selection', count(*), count(DISTINCT node_id), NULL, 'completed', 12 FROM (SELECT DISTINCT node_id, measure FROM cv)
UNION ALL SELECT 'nodes', (SELECT count(DISTINCT series_id) FROM prep) + n, (SELECT count(DISTINCT series_id) FROM prep) + n, NULL, 'completed', 12 FROM nn
UNION ALL SELECT 'summary', 1, NULL, NULL, 'completed', 12
UNION ALL SELECT 'issues', 0, NULL, NULL, 'completed', 12""")
def _(spark, sf):
    """A whole run kept; what another, unfinished write of it left is not seen."""
    root = scratch_dir(spark, "stored")
    ents, obs = T.entities(spark, sf, "marca"), T.observations(spark, sf, "marca")
    levels = HierarchyConfig((("tipo",), ("tipo", "marca")), include_total=True)
    RUN.stored_run(root, "r1", obs, ents, T.STUDY, ZERO, CONFIG, levels, "d1", fitted=False)
    store.load_run(spark, root, "r1", "cv").withColumn("yhat", F.lit(0.0)).write.parquet(f"{root}/cv/r1/unfinished")
    datasets = spark.range(1).select(F.lit("d1").alias("dataset_id"), F.lit("lineitem").alias("filename"))
    catalog = store.stored_catalog(spark, root, datasets).select("run_id", "status", "horizon")
    out = None
    for name in store.RUN_TABLES:
        rows = store.load_run(spark, root, "r1", name)
        nodes = F.count_distinct("node_id") if "node_id" in rows.columns else F.lit(None).cast("long")
        total = F.round(F.sum("yhat"), 2) if "yhat" in rows.columns else F.lit(None).cast("double")
        own = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), nodes.alias("n_nodes"), total.alias("total")).withColumn("run_id", F.lit("r1"))
        out = own if out is None else out.unionByName(own)
    return out.join(catalog, "run_id").drop("run_id")


@query("candidate_cached", S.q(fin_sql("tipo"), """SELECT series_id AS node_id, measure, 'SeasonalNaive' AS model_alias,
  CASE WHEN raw IS NULL THEN 'insufficient_history' ELSE 'ok' END AS status, round(CASE WHEN raw IS NOT NULL THEN greatest(raw[1], 0.0) END, 4) AS first_yhat
  FROM fmd WHERE model_alias = 'SeasonalNaive'"""))
def _(spark, sf):
    """Half of the series first, then all: the second question computes the rest only."""
    root = scratch_dir(spark, "candidates")
    rows = panel(spark, sf, "tipo")
    candidates.store_panel(rows, f"{root}/panel")
    names = tuple(sorted(r["series_id"] for r in rows.select("series_id").distinct().collect()))
    for asked in (names[::2], names):
        out = candidates.candidate(spark, f"{root}/panel", f"{root}/cache", asked, "SeasonalNaive", T.STUDY, CONFIG)
    return out.select("node_id", "measure", "model_alias", "status", F.round(F.try_element_at("yhat", F.lit(1)), 4).alias("first_yhat"))


@query("dashboard_mat", S.q(fin_sql("marca"), """
, both_ AS (SELECT series_id AS node_id, ds, y, NULL AS model_alias FROM prep WHERE measure = 'valor'),
al AS (SELECT DISTINCT node_id, model_alias FROM fin WHERE measure = 'valor'),
pts AS (SELECT al.node_id, al.model_alias, b.ds, b.y, FALSE AS ahead FROM al JOIN both_ b USING (node_id)
        UNION ALL SELECT node_id, model_alias, ds, yhat, TRUE FROM fin WHERE measure = 'valor'),
m AS (SELECT *, sum(greatest(y, 0)) OVER w AS mat, count(*) OVER w AS n FROM pts
      WINDOW w AS (PARTITION BY node_id, model_alias ORDER BY ds RANGE BETWEEN INTERVAL 11 MONTH PRECEDING AND CURRENT ROW))
SELECT model_alias, ds, count(*) AS n_nodes, round(sum(mat), 3) AS mat FROM m WHERE ahead AND n = 12 GROUP BY ALL""").replace(")\n, both_", "),\nboth_"))
def _(spark, sf):
    out = V.dashboard_query(run_tables(spark, sf), T.entities(spark, sf, "marca"), None, V.ResultFilter(measure="valor"))["mat"]
    return out.groupBy("model_alias", "ds").agg(F.count("*").alias("n_nodes"), F.round(F.sum("mat"), 3).alias("mat"))
