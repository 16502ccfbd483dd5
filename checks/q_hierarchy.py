"""Nodes, bridge, roll-ups, reconciliation, scenarios."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from checks import sql as S
from checks.q_forecast import CONFIG, cv_sql, fin_sql, frame, predictions, rounded, values
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.config import AssumptionRule, Scenario
from seriesmill.functions.periods import shift_date
from seriesmill.operators import backtest as FC
from seriesmill.operators import hierarchy as H
from seriesmill.operators import outcome as O
from seriesmill.operators import panel as P
from seriesmill.operators import scenarios as SC
from seriesmill.plans import views as V

WITH_TOTAL = replace(T.HIERARCHY, include_total=True)
PERIODS = [shift_date(T.HISTORY_END, k) for k in range(1, 13)]

ENT = f"""
ent AS (SELECT DISTINCT p_type AS tipo, p_brand AS marca, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean
        FROM part SEMI JOIN lineitem ON l_partkey = p_partkey),
entities AS (SELECT *, {S.entity_id(["tipo", "marca", "ean"])} AS entity_id FROM ent)"""

BRIDGE = f"""{ENT},
bridge AS (
  SELECT entity_id, -1 AS level, 'Total' AS level_name, sha256('["h","total"]') AS node_id, NULL AS parent_node_id FROM entities
  UNION ALL SELECT entity_id, 0, tipo, {S.node_id(0, ["tipo"])}, sha256('["h","total"]') FROM entities
  UNION ALL SELECT entity_id, 1, tipo || ' > ' || marca, {S.node_id(1, ["tipo", "marca"])}, {S.node_id(0, ["tipo"])} FROM entities
  UNION ALL SELECT entity_id, 2, tipo || ' > ' || marca || ' > ' || ean, {S.node_id(2, ["tipo", "marca", "ean"])}, {S.node_id(1, ["tipo", "marca"])} FROM entities)"""


def bridge(spark, sf):
    return H.node_bridge(T.entities(spark, sf), WITH_TOTAL)


@query("node_entity_bridge", S.q(BRIDGE, "SELECT * FROM bridge"))
def _(spark, sf):
    return bridge(spark, sf)


@query("build_nodes", S.q(BRIDGE, "SELECT node_id, level, level_name, parent_node_id, count(*) AS n_entities FROM bridge GROUP BY ALL"))
def _(spark, sf):
    return H.build_nodes(bridge(spark, sf))


@query("entity_of_node", S.q(BRIDGE, "SELECT entity_id, node_id FROM bridge WHERE level = 1"))
def _(spark, sf):
    return bridge(spark, sf).where("level = 1").select("entity_id", "node_id")


DIMS_JSON = """'{"tipo":"' || tipo || '","marca":"' || marca || '","ean":"' || ean || '"}'"""


@query(
    "run_nodes",
    f"""WITH {S.prep("ean").strip()},{BRIDGE},
    sr AS (SELECT DISTINCT series_id, entity_id FROM prep),
    up AS (SELECT node_id, level_name, parent_node_id, count(*) AS n, min(entity_id) AS one FROM bridge GROUP BY ALL)
    SELECT series_id AS node_id, 'folha' AS level, NULL AS parent_node_id, entity_id, {DIMS_JSON} AS dimensions_json, 1 AS n_entities
    FROM sr JOIN entities USING (entity_id)
    UNION ALL
    SELECT node_id, level_name, parent_node_id, CASE WHEN n = 1 THEN one END,
           CASE WHEN n = 1 THEN {DIMS_JSON} ELSE '{{}}' END, n FROM up LEFT JOIN entities ON entity_id = one""",
)
def _(spark, sf):
    return H.run_nodes(values(spark, sf), T.entities(spark, sf), bridge(spark, sf))


@query("run_nodes_ordered", S.q(BRIDGE, "SELECT level, node_id, count(*) AS n_entities FROM bridge GROUP BY ALL ORDER BY level, node_id"))
def _(spark, sf):
    return H.build_nodes(bridge(spark, sf)).select("level", "node_id", "n_entities").orderBy("level", "node_id")


@query(
    "validate_hierarchy",
    """WITH e AS (SELECT DISTINCT l_partkey, l_suppkey, p_type AS tipo, p_brand AS marca FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT tipo, marca, count(DISTINCT l_partkey) AS n_entities, 'E_HIERARCHY_INVALID' AS code FROM e GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1""",
)
def _(spark, sf):
    shallow = replace(T.HIERARCHY, levels=(("tipo",), ("tipo", "marca")))
    assert not H.level_issues(shallow)
    return H.ambiguous_leaves(T.entities(spark, sf), shallow)


@query(
    "run_tree",
    S.q(
        S.prep("ean"),
        """, sr AS (SELECT DISTINCT p.series_id AS node_id, tipo, marca, ean FROM prep p JOIN obs o ON o.series_id = p.series_id AND o.entity_id = p.entity_id)
        SELECT tipo, marca, ean, count(DISTINCT node_id) AS n_series, grouping(tipo, marca, ean) AS gid
        FROM sr GROUP BY ROLLUP (tipo, marca, ean)""",
    ).replace(")\n, sr", "),\nsr"),
)
def _(spark, sf):
    series = values(spark, sf).select(F.col("series_id").alias("node_id"), "entity_id").distinct()
    rows = series.join(T.entities(spark, sf), "entity_id")
    return H.run_tree(rows, ["tipo", "marca", "ean"])


@query(
    "aggregate_history_level",
    S.q(
        S.prep("ean") + "," + ENT,
        f"""SELECT {S.node_id(0, ["tipo"])} AS entity_id, measure, ds, round(sum(y), 2) AS y, bool_and(observed) AS observed
        FROM prep JOIN entities USING (entity_id) GROUP BY ALL""",
    ),
)
def _(spark, sf):
    out = H.aggregate_history(values(spark, sf), bridge(spark, sf), 0)
    return rounded(out.select("entity_id", "measure", "ds", "y", "observed"), "y", digits=2)


@query(
    "independent_level",
    fin_sql(
        "ean",
        base=cv_sql("ean").replace(
            "prof AS (",
            ENT.strip()
            + f""",
leafp AS (SELECT * FROM prep),
agg0 AS (SELECT {S.node_id(0, ["tipo"])} AS entity_id, measure, ds, sum(y) AS y FROM leafp JOIN entities USING (entity_id) GROUP BY ALL),
aggp AS (SELECT {S.SERIES_ID} AS series_id, * FROM agg0),
prof AS (""",
            1,
        ).replace("FROM prep\n         GROUP", "FROM aggp\n         GROUP").replace(
            "FROM prep GROUP BY 1),\nwins", "FROM aggp GROUP BY 1),\nwins"
        ).replace("FROM prep JOIN wins", "FROM aggp JOIN wins").replace("LEFT JOIN prep p", "LEFT JOIN aggp p"),
    )
    .replace("FROM prep GROUP BY ALL),\nfulp", "FROM aggp GROUP BY ALL),\nfulp")
    .join(["WITH ", "\nSELECT node_id, measure, model_alias, ds, round(yhat, 4) AS yhat FROM fin"]),
)
def _(spark, sf):
    level = H.aggregate_history(values(spark, sf), bridge(spark, sf), 0)
    panel = P.train_panel(level, T.STUDY, CONFIG, P.calendar_folds(T.STUDY, CONFIG))
    out = FC.final_forecast(FC.forecast_frame(panel, T.STUDY, CONFIG, fitted=False, limits=False), native_only=True)
    return rounded(out.select("node_id", "measure", "model_alias", "ds", "yhat"), "yhat")


RECON = f"""{fin_sql("ean")},{ENT},
exp AS (SELECT tipo, marca, count(*) AS n FROM entities GROUP BY ROLLUP (tipo, marca)),
agg AS (
  SELECT tipo, marca, measure, ds, model_alias, sum(yhat) AS yhat, count(yhat) AS n_leaves
  FROM fin JOIN entities USING (entity_id)
  GROUP BY GROUPING SETS ((measure, ds, model_alias), (tipo, measure, ds, model_alias), (tipo, marca, measure, ds, model_alias))),
rec AS (
  SELECT CASE WHEN agg.tipo IS NULL THEN sha256('["h","total"]')
              WHEN agg.marca IS NULL THEN sha256('["h",0,"' || agg.tipo || '"]')
              ELSE sha256('["h",1,"' || agg.tipo || '","' || agg.marca || '"]') END AS node_id,
         CASE WHEN agg.tipo IS NULL THEN 'Total' WHEN agg.marca IS NULL THEN agg.tipo ELSE agg.tipo || ' > ' || agg.marca END AS level,
         measure, ds, model_alias, yhat, n_leaves, CASE WHEN n_leaves = n THEN 'ok' ELSE 'partial_coverage' END AS status
  FROM agg JOIN exp ON exp.tipo IS NOT DISTINCT FROM agg.tipo AND exp.marca IS NOT DISTINCT FROM agg.marca)"""


def final_rows(spark, sf, grain="ean"):
    return O.final_values(frame(spark, sf, grain))


def reconciled(spark, sf, hierarchy=WITH_TOTAL, **options):
    return O.roll_up(final_rows(spark, sf), T.entities(spark, sf), hierarchy, len(PERIODS), **options)


@query("reconcile_bottom_up", f"WITH {RECON.strip()} SELECT node_id, level, measure, ds, model_alias, round(yhat, 4) AS yhat, n_leaves, status FROM rec")
def _(spark, sf):
    out = reconciled(spark, sf).select("node_id", "level", "measure", "ds", "model_alias", "yhat", "n_leaves", "status")
    return rounded(out, "yhat")


@query("reconcile_stored", f"WITH {RECON.strip()} SELECT level, model_alias, status, count(*) AS n, round(sum(yhat), 4) AS yhat FROM rec GROUP BY ALL")
def _(spark, sf):
    """The same from stored predictions, one row per date."""
    out = H.reconcile_bottom_up(predictions(spark, sf, "ean"), bridge(spark, sf), WITH_TOTAL)
    return out.groupBy("level", "model_alias", "status").agg(F.count("*").alias("n"), F.round(F.sum("yhat"), 4).alias("yhat"))


@query("reconcile_label", f"WITH {RECON.strip()} SELECT level, model_alias, CASE WHEN status = 'ok' THEN 'MinT' ELSE 'BottomUp' END AS reconciliation, count(*) AS n FROM rec GROUP BY ALL")
def _(spark, sf):
    out = reconciled(spark, sf, replace(WITH_TOTAL, mode="mintrace"))
    return out.groupBy("level", "model_alias", "reconciliation").agg(F.count("*").alias("n"))


@query(
    "round_and_recompose",
    f"""WITH {RECON.strip()},
    lf AS (SELECT fin.*, tipo, marca, round_even(yhat, 0) AS r FROM fin JOIN entities USING (entity_id) WHERE measure = 'unidades'),
    ws AS (SELECT tipo, marca, measure, ds, model_alias, sum(r) AS w FROM lf
           GROUP BY GROUPING SETS ((measure, ds, model_alias), (tipo, measure, ds, model_alias), (tipo, marca, measure, ds, model_alias))),
    wn AS (SELECT *, CASE WHEN tipo IS NULL THEN 'Total' WHEN marca IS NULL THEN tipo ELSE tipo || ' > ' || marca END AS level FROM ws)
    SELECT rec.level, rec.measure, rec.ds, rec.model_alias, round(CASE WHEN status = 'ok' AND w IS NOT NULL THEN w ELSE yhat END, 4) AS yhat, status
    FROM rec LEFT JOIN wn USING (level, measure, ds, model_alias)""",
)
def _(spark, sf):
    out = reconciled(spark, sf, whole_units=True)
    return rounded(out.select("level", "measure", "ds", "model_alias", "yhat", "status"), "yhat")


@query("grain_rollup", f"WITH {fin_sql('ean').strip()},{ENT} SELECT tipo AS grain, measure, ds, model_alias, round(sum(yhat), 4) AS yhat FROM fin JOIN entities USING (entity_id) GROUP BY ALL")
def _(spark, sf):
    out = H.grain_rollup(predictions(spark, sf, "ean"), T.entities(spark, sf), "tipo", ["measure", "ds", "model_alias"], "yhat")
    return rounded(out, "yhat")


@query("nodes_without_entities", f"""WITH {S.prep("ean").strip()},{BRIDGE},
 big AS (SELECT entity_id FROM bridge WHERE level = 1 QUALIFY count(*) OVER (PARTITION BY node_id) >= 14)
 SELECT p.series_id AS node_id, p.measure, round(sum(p.y), 2) AS y FROM prep p WHERE NOT EXISTS (SELECT 1 FROM big b WHERE b.entity_id = p.entity_id) GROUP BY ALL""")
def _(spark, sf):
    level = bridge(spark, sf).where("level = 1")
    wide = H.build_nodes(level).where("n_entities >= 14").select("node_id")
    return rounded(V.uncovered_history(values(spark, sf), level.join(wide, "node_id", "left_semi")), "y", digits=2)


def rule(rule_id, scenario, family, measure, effect, rate, start, end=None, priority=0, excluded=(), **filters):
    scope = {k: tuple(v) for k, v in filters.items()}
    return AssumptionRule(rule_id, scenario, family, measure, effect, rate, start, end, scope, excluded, priority)


GROWTH = Scenario(
    "growth",
    (
        rule("g1", "growth", "price", "valor", "annual_step", 0.05, date(2001, 11, 1)),
        rule("g2", "growth", "promo", "unidades", "pulse", 0.25, date(2001, 12, 1), date(2002, 2, 1), 1, tipo=("ECONOMY", "SMALL")),
        rule("g3", "growth", "promo", "unidades", "step", -0.1, date(2002, 1, 1), date(2002, 1, 1), 0, tipo=("ECONOMY",)),
        rule("g4", "growth", "mix", "unidades", "step", 0.02, date(2001, 10, 1), None, 0, marca=("Brand#2", "Brand#17")),
    ),
)
COPY = Scenario("copy")
TIED = Scenario(
    "tied",
    (
        rule("t1", "tied", "promo", "valor", "step", 0.1, date(2002, 1, 1), None, 3, tipo=("ECONOMY",)),
        rule("t2", "tied", "promo", "valor", "step", 0.2, date(2002, 6, 1), None, 3, marca=("Brand#2",)),
    ),
)
CLASH = Scenario("clash", (rule("c1", "clash", "price", "valor", "step", 0.1, date(2002, 1, 1)),), {"r-price": {date(2001, 9, 1): 1.0}})
SCENARIOS = (COPY, GROWTH, TIED, CLASH)

RULES_SQL = f"""
rules(scenario_id, rule_id, family, measure, effect, rate, s, e, prio, tipos, marcas) AS (VALUES
 ('growth','g1','price','valor','annual_step', CAST(0.05 AS DOUBLE), DATE '2001-11-01', NULL::DATE, 0, NULL::VARCHAR[], NULL::VARCHAR[]),
 ('growth','g2','promo','unidades','pulse', 0.25, DATE '2001-12-01', DATE '2002-02-01', 1, ['ECONOMY','SMALL'], NULL),
 ('growth','g3','promo','unidades','step', -0.1, DATE '2002-01-01', DATE '2002-01-01', 0, ['ECONOMY'], NULL),
 ('growth','g4','mix','unidades','step', 0.02, DATE '2001-10-01', NULL, 0, NULL, ['Brand#2','Brand#17']),
 ('tied','t1','promo','valor','step', 0.1, DATE '2002-01-01', NULL, 3, ['ECONOMY'], NULL),
 ('tied','t2','promo','valor','step', 0.2, DATE '2002-06-01', NULL, 3, NULL, ['Brand#2'])),
pers AS (SELECT CAST(g AS DATE) AS period FROM generate_series(TIMESTAMP '2001-09-01', TIMESTAMP '2002-08-01', INTERVAL 1 MONTH) t(g)),
ex AS (
  SELECT scenario_id, entity_id, period, family, measure, rule_id, prio AS priority,
         CASE WHEN effect = 'annual_step'
              THEN pow(1 + rate, year(period) - year(s) + CASE WHEN month(period) * 100 + day(period) >= month(s) * 100 + day(s) THEN 1 ELSE 0 END)
              ELSE 1 + rate END AS factor
  FROM ents, pers, rules
  WHERE period >= s AND (effect = 'step' OR e IS NULL OR period <= e)
    AND (tipos IS NULL OR list_contains(tipos, tipo)) AND (marcas IS NULL OR list_contains(marcas, marca))),
cmp AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY scenario_id, entity_id, period, family, measure ORDER BY priority DESC, rule_id) = 1),
ties AS (SELECT scenario_id, entity_id, period, family, measure, priority, count(*) AS n_rules FROM
          (SELECT * FROM ex QUALIFY rank() OVER (PARTITION BY scenario_id, entity_id, period, family, measure ORDER BY priority DESC) = 1)
         GROUP BY ALL HAVING count(*) > 1),
fac AS (SELECT scenario_id, entity_id, period AS ds, measure, product(factor) AS factor FROM cmp GROUP BY ALL)"""

EAN_RULES = f"WITH {ENT.strip()}, ents AS (SELECT * FROM entities),{RULES_SQL}"
MARCA_ENTS = f"""ents AS (SELECT *, {S.entity_id(["tipo", "marca"])} AS entity_id FROM (SELECT DISTINCT tipo, marca FROM m_marca))"""
RULES = tuple(r for s in (GROWTH, TIED) for r in s.rules)


@query("rule_expand", EAN_RULES + " SELECT scenario_id, period, family, measure, rule_id, count(*) AS n_entities, round(max(factor), 9) AS factor FROM ex GROUP BY ALL")
def _(spark, sf):
    rows = SC.rule_expand(T.entities(spark, sf), PERIODS, RULES)
    return rows.groupBy("scenario_id", "period", "family", "measure", "rule_id").agg(
        F.count("*").alias("n_entities"), F.round(F.max("factor"), 9).alias("factor")
    )


COMPILED = "scenario_id, entity_id, period, family, measure, rule_id, priority, round(factor, 9) AS factor"


@query("compile_assumptions", EAN_RULES + f" SELECT {COMPILED} FROM cmp")
def _(spark, sf):
    return rounded(SC.compile_assumptions(T.entities(spark, sf), PERIODS, RULES), "factor", digits=9)


@query("rule_priority", EAN_RULES + " SELECT scenario_id, family, rule_id, count(*) AS n_cells FROM cmp GROUP BY ALL")
def _(spark, sf):
    out = SC.compile_assumptions(T.entities(spark, sf), PERIODS, RULES)
    return out.groupBy("scenario_id", "family", "rule_id").agg(F.count("*").alias("n_cells"))


@query("rule_effects", EAN_RULES + " SELECT rule_id, period, round(min(factor), 9) AS low, round(max(factor), 9) AS high FROM ex GROUP BY ALL")
def _(spark, sf):
    rows = SC.rule_expand(T.entities(spark, sf), PERIODS, RULES)
    return rows.groupBy("rule_id", "period").agg(
        F.round(F.min("factor"), 9).alias("low"), F.round(F.max("factor"), 9).alias("high")
    )


@query("priority_ties", EAN_RULES + " SELECT *, 'E_SCENARIO_PRIORITY_TIE' AS code FROM ties")
def _(spark, sf):
    return SC.priority_ties(T.entities(spark, sf), PERIODS, RULES)


@query("factor_product", EAN_RULES + " SELECT scenario_id, entity_id, ds, measure, round(factor, 9) AS factor FROM fac")
def _(spark, sf):
    out = SC.factor_product(SC.compile_assumptions(T.entities(spark, sf), PERIODS, RULES))
    return rounded(out, "factor", digits=9)


@query("assumption_preview", EAN_RULES + " SELECT scenario_id, measure, family, count(DISTINCT entity_id) AS n_entities, count(DISTINCT period) AS n_periods FROM cmp GROUP BY ALL")
def _(spark, sf):
    return SC.assumption_preview(SC.compile_assumptions(T.entities(spark, sf), PERIODS, RULES))


@query("entity_matches", f"WITH {ENT.strip()} SELECT entity_id, tipo IN ('ECONOMY', 'SMALL') AND marca = 'Brand#2' AS both_match, TRUE AS empty_match FROM entities")
def _(spark, sf):
    filters = F.create_map(
        F.lit("tipo"), F.array(F.lit("ECONOMY"), F.lit("SMALL")), F.lit("marca"), F.array(F.lit("Brand#2"))
    )
    none = F.create_map().cast("map<string,array<string>>")
    return T.entities(spark, sf).select(
        "entity_id",
        SC.entity_matches(filters, F.col("dims")).alias("both_match"),
        SC.entity_matches(none, F.col("dims")).alias("empty_match"),
    )


FACTORED = f"""WITH {fin_sql("marca").strip()}, {MARCA_ENTS},{RULES_SQL},
scn AS (SELECT * FROM (VALUES ('copy'), ('growth')) t(scenario_id)),
app AS (SELECT scn.scenario_id, fin.node_id, fin.entity_id, fin.measure, fin.model_alias, fin.ds, yhat AS yhat_base,
               coalesce(factor, 1.0) AS factor, greatest(yhat * coalesce(factor, 1.0), 0.0) AS yhat
        FROM fin CROSS JOIN scn LEFT JOIN fac ON fac.scenario_id = scn.scenario_id AND fac.entity_id = fin.entity_id
             AND fac.ds = fin.ds AND fac.measure = fin.measure)"""


UNTIED = FACTORED.replace(
    "(VALUES ('copy'), ('growth')) t(scenario_id))",
    "(VALUES ('copy'), ('growth'), ('tied')) t(scenario_id) WHERE scenario_id NOT IN (SELECT scenario_id FROM ties))",
)


@query("apply_scenario", FACTORED + " SELECT scenario_id, node_id, measure, model_alias, ds, round(yhat, 6) AS yhat, round(factor, 9) AS factor FROM app")
def _(spark, sf):
    out = SC.apply_scenario(predictions(spark, sf), T.entities(spark, sf, "marca"), (COPY, GROWTH))
    out = out.select("scenario_id", "node_id", "measure", "model_alias", "ds", "yhat", "factor")
    return rounded(rounded(out, "yhat", digits=6), "factor", digits=9)


MANY = Scenario(
    "growth",
    GROWTH.rules
    + tuple(AssumptionRule(f"none-{k}", "growth", f"none-{k}", "unidades", "step", 0.0, PERIODS[0]) for k in range(100)),
)


@query("apply_factors", FACTORED + " SELECT scenario_id, measure, ds, count(*) AS n_rows, count_if(factor <> 1) AS n_touched FROM app GROUP BY ALL")
def _(spark, sf):
    """The same with a hundred rules more that change nothing."""
    out = SC.apply_scenario(predictions(spark, sf), T.entities(spark, sf, "marca"), (COPY, MANY))
    return out.groupBy("scenario_id", "measure", "ds").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("factor") != 1).alias("n_touched")
    )


@query("generate_scenarios", UNTIED + " SELECT scenario_id, measure, model_alias, ds, count(*) AS n_rows, round(sum(yhat), 4) AS total FROM app GROUP BY ALL")
def _(spark, sf):
    out, _, _ = SC.generate_scenarios(
        predictions(spark, sf), T.entities(spark, sf, "marca"), SCENARIOS, PERIODS, {"r-price": "price"}
    )
    return out.groupBy("scenario_id", "measure", "model_alias", "ds").agg(
        F.count("*").alias("n_rows"), F.round(F.sum("yhat"), 4).alias("total")
    )


@query("scenario_issues", f"""WITH {S.months("marca").strip()}, {MARCA_ENTS},{RULES_SQL}
 SELECT scenario_id, 'E_SCENARIO_PRIORITY_TIE' AS code, count(*) AS n_cells FROM ties GROUP BY ALL
 UNION ALL SELECT 'clash', 'E_SCENARIO_REG_FAMILY_DUP', 1""")
def _(spark, sf):
    _, issues, _ = SC.generate_scenarios(
        predictions(spark, sf), T.entities(spark, sf, "marca"), SCENARIOS, PERIODS, {"r-price": "price"}
    )
    return issues


@query("union_scenarios", FACTORED + """ SELECT scenario_id, measure, count(*) AS n_rows FROM app GROUP BY ALL
 UNION ALL SELECT 'base', measure, count(*) FROM fin GROUP BY measure""")
def _(spark, sf):
    base = predictions(spark, sf)
    out = SC.apply_scenario(base, T.entities(spark, sf, "marca"), (COPY, GROWTH))
    both = base.unionByName(out.drop("factor"))
    return both.groupBy("scenario_id", "measure").agg(F.count("*").alias("n_rows"))


@query("scenario_vs_base", FACTORED + """ SELECT scenario_id, node_id, measure, model_alias, ds, round(yhat, 6) AS yhat, round(yhat_base, 6) AS yhat_base,
 round((yhat - yhat_base) / nullif(yhat_base, 0), 6) AS variation FROM app WHERE scenario_id = 'growth'""")
def _(spark, sf):
    base = predictions(spark, sf)
    grown = SC.apply_scenario(base, T.entities(spark, sf, "marca"), (GROWTH,))
    out = SC.scenario_vs_base(grown, base).select(
        "scenario_id", "node_id", "measure", "model_alias", "ds", "yhat", "yhat_base", "variation"
    )
    return rounded(rounded(out, "yhat", "yhat_base", digits=6), "variation", digits=6)


def members(spark, sf, level):
    return H.node_bridge(T.entities(spark, sf), T.HIERARCHY, keep=("dims",)).where(level)


@query(
    "apply_scenario_nodes",
    f"""WITH {ENT.strip()}, ents AS (SELECT * FROM entities),{RULES_SQL},
    meas AS (SELECT * FROM (VALUES ('unidades'), ('valor')) t(measure)),
    lf AS (SELECT e.entity_id, e.tipo, e.marca, p.period AS ds, m.measure, coalesce(f.factor, 1.0) AS factor, f.factor IS NOT NULL AS hit
           FROM ents e, pers p, meas m LEFT JOIN fac f ON f.scenario_id = 'growth' AND f.entity_id = e.entity_id AND f.ds = p.period AND f.measure = m.measure)
    SELECT {S.node_id(1, ["tipo", "marca"])} AS node_id, ds, measure, round(min(factor), 9) AS factor,
           round(min(factor), 12) = round(max(factor), 12) AND bool_and(hit) = bool_or(hit) AS uniform, count_if(hit) AS n_touched, count(*) AS n_leaves
    FROM lf GROUP BY tipo, marca, ds, measure
    UNION ALL
    SELECT {S.node_id(0, ["tipo"])}, ds, measure, round(min(factor), 9), round(min(factor), 12) = round(max(factor), 12) AND bool_and(hit) = bool_or(hit),
           count_if(hit), count(*) FROM lf GROUP BY tipo, ds, measure""",
)
def _(spark, sf):
    out = SC.node_factors(members(spark, sf, "level < 2"), PERIODS, ("unidades", "valor"), (GROWTH,))
    return rounded(out.drop("scenario_id"), "factor", digits=9)


# Rules of whole types suit the nodes of level 0; a rule of brands covers them in part.
WHOLE = Scenario(
    "whole",
    (
        rule("w1", "whole", "price", "valor", "annual_step", 0.05, date(2001, 11, 1)),
        rule("w2", "whole", "promo", "unidades", "pulse", 0.25, date(2001, 12, 1), date(2002, 2, 1), 1, tipo=("ECONOMY", "SMALL")),
        rule("w3", "whole", "promo", "unidades", "step", -0.1, date(2002, 1, 1), None, 0, tipo=("ECONOMY",)),
        rule("w4", "whole", "mix", "valor", "step", 0.02, date(2002, 3, 1), None, 0),
    ),
)
PART = Scenario("part", (rule("p1", "part", "mix", "unidades", "step", 0.02, date(2001, 10, 1), None, 0, marca=("Brand#2", "Brand#17")),))
WHOLE_FACTOR = """
    CASE WHEN measure = 'valor' THEN (CASE WHEN ds >= DATE '2001-11-01' THEN 1.05 ELSE 1.0 END) * (CASE WHEN ds >= DATE '2002-03-01' THEN 1.02 ELSE 1.0 END)
         WHEN level IN ('ECONOMY', 'SMALL') AND ds BETWEEN DATE '2001-12-01' AND DATE '2002-02-01' THEN 1.25
         WHEN level = 'ECONOMY' AND ds >= DATE '2002-01-01' THEN 0.9 ELSE 1.0 END"""


@query(
    "scenario_partial_nodes",
    f"""WITH {RECON.strip()}, top AS (SELECT * FROM rec WHERE level IN (SELECT tipo FROM entities)),
    n AS (SELECT count(*) AS n_cells FROM (SELECT DISTINCT tipo FROM entities e1
          WHERE EXISTS (SELECT 1 FROM entities e2 WHERE e2.tipo = e1.tipo AND marca IN ('Brand#2', 'Brand#17'))
            AND EXISTS (SELECT 1 FROM entities e2 WHERE e2.tipo = e1.tipo AND marca NOT IN ('Brand#2', 'Brand#17'))), range(11))
    SELECT scenario_id, level, measure, model_alias, ds, CASE WHEN yhat > 0 THEN round(f, 9) END AS ratio, NULL AS code, NULL AS n_cells FROM (
      SELECT 'whole' AS scenario_id, *, {WHOLE_FACTOR} AS f FROM top UNION ALL SELECT 'copy', *, 1.0 FROM top)
    UNION ALL SELECT 'part', NULL, NULL, NULL, NULL, NULL, 'E_SCENARIO_PARTIAL_NODE', n_cells FROM n WHERE n_cells > 0""",
)
def _(spark, sf):
    """Rows of three scenarios on level 0, and one issue row for the one that covers types in part."""
    nodes = H.reconcile_bottom_up(predictions(spark, sf, "ean"), bridge(spark, sf).where("level = 0"), WITH_TOTAL)
    all_three = (COPY, WHOLE, PART)
    factors = SC.node_factors(members(spark, sf, "level = 0"), PERIODS, ("unidades", "valor"), all_three)
    out, issues = SC.apply_scenario_nodes(nodes.withColumn("base", F.col("yhat")), factors, all_three)
    rows = out.select("scenario_id", "level", "measure", "model_alias", "ds", F.round(F.try_divide("yhat", "base"), 9).alias("ratio"))
    return rows.unionByName(issues, allowMissingColumns=True)


@query(
    "validate_rules",
    """WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS rule_id,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'base' ELSE 's' END AS scenario_id,
      CASE WHEN o_orderpriority = '1-URGENT' THEN ' ' ELSE 'promo' END AS family,
      CASE WHEN o_orderpriority = '2-HIGH' THEN 'peso' ELSE 'valor' END AS measure,
      CASE WHEN o_orderstatus = 'F' THEN 'pulse' ELSE 'step' END AS effect,
      o_totalprice / 200000 - 1.5 AS rate, CAST(o_orderdate AS DATE) AS s,
      CASE WHEN o_orderpriority <> '3-MEDIUM' THEN DATE '1998-06-01' END AS e,
      o_custkey % 5 - 1 AS priority FROM orders)
    SELECT rule_id, problem FROM (SELECT rule_id, unnest([
      CASE WHEN trim(rule_id) = '' THEN 'rule without id' END, CASE WHEN scenario_id = 'base' THEN 'base scenario takes no rules' END,
      CASE WHEN trim(family) = '' THEN 'rule without family' END, CASE WHEN measure NOT IN ('unidades', 'valor') THEN 'unknown measure' END,
      CASE WHEN rate <= -1 THEN 'rate must be above -100%' END, CASE WHEN effect = 'pulse' AND e IS NULL THEN 'pulse needs an end' END,
      CASE WHEN e < s THEN 'end before start' END, CASE WHEN priority < 0 THEN 'priority below zero' END]) AS problem FROM r)
    WHERE problem IS NOT NULL""",
)
def _(spark, sf):
    p, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    drafts = T.table(spark, sf, "orders").select(
        F.when(st == "P", "").otherwise(F.col("o_orderkey").cast("string")).alias("rule_id"),
        F.when(p == "5-LOW", "base").otherwise("s").alias("scenario_id"),
        F.when(p == "1-URGENT", " ").otherwise("promo").alias("family"),
        F.when(p == "2-HIGH", "peso").otherwise("valor").alias("measure"),
        F.when(st == "F", "pulse").otherwise("step").alias("effect"),
        (F.col("o_totalprice") / 200000 - 1.5).alias("rate"),
        F.col("o_orderdate").cast("date").alias("start"),
        F.when(p != "3-MEDIUM", F.lit(date(1998, 6, 1))).alias("end"),
        (F.col("o_custkey") % 5 - 1).alias("priority"),
    )
    return SC.validate_rules(drafts)
