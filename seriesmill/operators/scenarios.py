"""What-if rules: scope, windows, priorities and factors.

Rules are settings: they become Column expressions evaluated beside the forecast, on the dates of
its own rows. Priorities and ties are resolved inside the row as well, so nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.config import AssumptionRule, Scenario
from seriesmill.operators.models import floor_zero

BASE = "base"


def in_scope(filters: dict[str, tuple[str, ...]], dims: Column) -> Column:
    """AND across dimensions, OR inside one, case-sensitive; no filter means everything."""
    out = F.lit(True)
    for name, allowed in filters.items():
        out = out & F.coalesce(F.try_element_at(dims, F.lit(name)), F.lit("")).isin(*allowed)
    return out


def entity_matches(filters: Column, dims: Column) -> Column:
    """The same test for filters held in a ``map<string, array<string>>`` column."""
    return F.forall(
        F.map_keys(filters),
        lambda k: F.array_contains(F.element_at(filters, k), F.coalesce(F.try_element_at(dims, k), F.lit(""))),
    )


def _covers(rule: AssumptionRule, entity: Column, dims: Column) -> Column:
    out = in_scope(rule.filters, dims)
    return out & ~entity.isin(*rule.excluded) if rule.excluded else out


def _in_time(rule: AssumptionRule, period: Column) -> Column:
    out = period >= F.lit(rule.start)
    return out & (period <= F.lit(rule.end)) if rule.end is not None and rule.effect != "step" else out


def rule_applies(rule: AssumptionRule, entity: Column, dims: Column, period: Column) -> Column:
    return _covers(rule, entity, dims) & _in_time(rule, period)


def annual_occurrences(start: date, period: Column) -> Column:
    """Yearly anniversaries of the start reached by the period, the start itself included."""
    mark = start.month * 100 + start.day
    reached = (F.month(period) * 100 + F.dayofmonth(period) >= mark).cast("int")
    return F.when(period >= F.lit(start), F.year(period) - start.year + reached).otherwise(0)


def rule_factor(rule: AssumptionRule, period: Column) -> Column:
    if rule.effect == "annual_step":
        return F.pow(F.lit(1 + rule.rate), annual_occurrences(rule.start, period).cast("double"))
    return F.lit(1 + rule.rate)


def _live(rules: tuple[AssumptionRule, ...]) -> list[AssumptionRule]:
    """Enabled rules that leave something of the value; a rate of -1 or less does not."""
    return [r for r in rules if r.enabled and r.rate > -1]


def _families(rules: list[AssumptionRule]) -> dict[tuple[str, str], list[AssumptionRule]]:
    out = defaultdict(list)
    for rule in sorted(rules, key=lambda r: (-r.priority, r.rule_id)):
        out[rule.family, rule.measure].append(rule)
    return out


def factor_expression(rules: tuple[AssumptionRule, ...], entity: Column, dims: Column, period: Column, measure: Column) -> Column:
    """Product over families of the highest-priority rule that applies."""
    out = F.lit(1.0)
    for (_, target), members in _families(_live(rules)).items():
        chosen = [F.when(rule_applies(r, entity, dims, period), rule_factor(r, period)) for r in members]
        out = out * F.when(measure == target, F.coalesce(*chosen, F.lit(1.0))).otherwise(F.lit(1.0))
    return out


KIND = "array<struct<scenario_id:string,family:string,measure:string,rule_id:string,priority:int,factor:double>>"
CELL = ["scenario_id", "entity_id", "period", "family", "measure"]


def _dated(entities: DataFrame, periods: list[date]) -> DataFrame:
    return entities.select("entity_id", "dims", F.explode(F.array(*[F.lit(p) for p in periods])).alias("period"))


def _hit(rule: AssumptionRule) -> Column:
    """The rule as a struct where it applies, else null."""
    entity, dims, period = F.col("entity_id"), F.col("dims"), F.col("period")
    return F.when(
        rule_applies(rule, entity, dims, period),
        F.struct(
            F.lit(rule.scenario_id).alias("scenario_id"),
            F.lit(rule.family).alias("family"),
            F.lit(rule.measure).alias("measure"),
            F.lit(rule.rule_id).alias("rule_id"),
            F.lit(rule.priority).alias("priority"),
            rule_factor(rule, period).alias("factor"),
        ),
    )


def _unpacked(dates: DataFrame, hits: list[Column]) -> DataFrame:
    found = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast(KIND)
    return dates.select("entity_id", "period", F.explode(found).alias("r")).select("entity_id", "period", "r.*")


def _cells(rules: tuple[AssumptionRule, ...]) -> dict[tuple[str, str, str], list[AssumptionRule]]:
    """Live rules by scenario, family and measure, the one that wins first."""
    out = defaultdict(list)
    for rule in sorted(_live(rules), key=lambda r: (-r.priority, r.rule_id)):
        out[rule.scenario_id, rule.family, rule.measure].append(rule)
    return out


def rule_expand(entities: DataFrame, periods: list[date], rules: tuple[AssumptionRule, ...]) -> DataFrame:
    """(scenario, entity, period, family, measure, rule) wherever a rule applies.

    Rules and periods are settings, so each entity row expands in place in a single pass.
    """
    return _unpacked(_dated(entities, periods), [_hit(r) for r in _live(rules)])


def compile_assumptions(entities: DataFrame, periods: list[date], rules: tuple[AssumptionRule, ...]) -> DataFrame:
    """One factor per (scenario, entity, period, family, measure): the highest priority wins.

    The rules of a cell are settings in order of priority, so the winner is the first that applies.
    """
    winners = [F.coalesce(*[_hit(r) for r in members]) for members in _cells(rules).values()]
    return _unpacked(_dated(entities, periods), winners)


def priority_ties(
    entities: DataFrame, periods: list[date], rules: tuple[AssumptionRule, ...], cells: DataFrame | None = None
) -> DataFrame:
    """Cells whose top priority is shared; their scenario must not be applied.

    Only cells in which two rules have the same priority are looked at. ``cells`` (entity_id,
    period) names the dates of each entity, instead of the same periods for all.
    """
    tied = []
    for members in _cells(rules).values():
        if len({r.priority for r in members}) == len(members):
            continue
        hits = F.filter(F.array(*[_hit(r) for r in members]), lambda h: h.isNotNull())
        top = F.filter(hits, lambda h: h["priority"] == F.get(hits, F.lit(0))["priority"])
        tied.append(F.when(F.size(top) > 1, F.struct(F.get(top, F.lit(0)).alias("r"), F.size(top).cast("long").alias("n_rules"))))
    if cells is None or not tied:
        dates = _dated(entities, periods)
    else:
        dates = cells.select("entity_id", "period").distinct().join(entities.select("entity_id", "dims"), "entity_id")
    none = F.array().cast(f"array<struct<r:{KIND[6:-1]},n_rules:bigint>>")
    found = F.filter(F.array(*tied), lambda t: t.isNotNull()) if tied else none
    rows = dates.select("entity_id", "period", F.explode(found).alias("t"))
    return rows.select(
        "t.r.scenario_id",
        "entity_id",
        "period",
        "t.r.family",
        "t.r.measure",
        "t.r.priority",
        "t.n_rules",
        F.lit("E_SCENARIO_PRIORITY_TIE").alias("code"),
    )


def factor_product(compiled: DataFrame) -> DataFrame:
    return compiled.groupBy("scenario_id", "entity_id", F.col("period").alias("ds"), "measure").agg(
        F.product("factor").alias("factor")
    )


def _scaled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: floor_zero(F.col(c) * F.col("factor")) for c in ("yhat", "lo80", "hi80")})


def apply_scenario(predictions: DataFrame, entities: DataFrame, scenarios: tuple[Scenario, ...]) -> DataFrame:
    """Base predictions repeated per scenario with yhat and limits times the factor, floored at zero.

    A scenario's rules are those it holds; the dates are those of the predictions.
    """
    names = F.array(*[F.lit(s.scenario_id) for s in scenarios])
    rows = predictions.withColumn("scenario_id", F.explode(names))
    with_dims = rows.join(entities.select("entity_id", "dims"), "entity_id", "left")
    factor = F.lit(1.0)
    for s in scenarios:
        own = factor_expression(s.rules, F.col("entity_id"), F.col("dims"), F.col("ds"), F.col("measure"))
        factor = F.when(F.col("scenario_id") == s.scenario_id, own).otherwise(factor)
    return _scaled(with_dims.withColumn("factor", factor)).drop("dims")


def _marks(rules: list[AssumptionRule], entity: Column, dims: Column) -> Column:
    """For every rule a 1 where its scope covers the entity, else a 0, as one text."""
    marks = [F.when(_covers(r, entity, dims), "1").otherwise("0") for r in rules]
    return F.concat(*marks) if marks else F.lit("")


def _marked_factor(rules: list[AssumptionRule], place: dict[int, int], marks: Column, period: Column, measure: Column) -> tuple[Column, Column]:
    """Factor of an entity with these marks, and whether any rule touches it."""
    factor, touched = F.lit(1.0), F.lit(False)
    for (_, target), members in _families(rules).items():
        own = [(F.substring(marks, place[id(r)], 1) == "1") & _in_time(r, period) & (measure == target) for r in members]
        factor = factor * F.coalesce(*[F.when(hit, rule_factor(r, period)) for r, hit in zip(members, own)], F.lit(1.0))
        for hit in own:
            touched = touched | hit
    return factor, touched


def node_factors(
    members: DataFrame, periods: list[date], measures: tuple[str, ...], scenarios: tuple[Scenario, ...]
) -> DataFrame:
    """Factor per (scenario, node, ds, measure) and whether all leaves of the node share it.

    ``members`` are (entity_id, node_id, dims). What rules do to a leaf depends on the leaf only by whether
    their scopes cover it, so leaves are first counted per node and set of rules that cover them; scenarios,
    periods and measures multiply those few rows, not the leaves. A node is uniform where no leaf is
    touched, or all are and their factors are equal.
    """
    live = {s.scenario_id: _live(s.rules) for s in scenarios}
    rules = [r for own in live.values() for r in own]
    place = {id(r): k for k, r in enumerate(rules, 1)}
    marks = _marks(rules, F.col("entity_id"), F.col("dims"))
    sets = members.groupBy("node_id", marks.alias("_marks")).agg(F.count("*").alias("_n"))
    cells = [
        F.struct(F.lit(s).alias("scenario_id"), F.lit(p).alias("ds"), F.lit(m).alias("measure"))
        for s, own in live.items()
        for p in periods
        for m in measures
        if own
    ]
    none = F.array().cast("array<struct<scenario_id:string,ds:date,measure:string>>")
    rows = sets.select("node_id", "_marks", "_n", F.explode(F.array(*cells) if cells else none).alias("c"))
    rows = rows.select("node_id", "_marks", "_n", "c.*")
    factor, touched = F.lit(1.0), F.lit(False)
    for s, own in live.items():
        here = F.col("scenario_id") == s
        f, t = _marked_factor(own, place, F.col("_marks"), F.col("ds"), F.col("measure"))
        factor, touched = F.when(here, f).otherwise(factor), F.when(here, t).otherwise(touched)
    keys = ["scenario_id", "node_id", "ds", "measure"]
    same = (F.min("factor") == F.max("factor")) & (F.bool_and("_touched") == F.bool_or("_touched"))
    return (
        rows.select(*keys, "_n", factor.alias("factor"), touched.alias("_touched"))
        .groupBy(*keys)
        .agg(
            F.min("factor").alias("factor"),
            same.alias("uniform"),
            F.sum(F.when(F.col("_touched"), F.col("_n")).otherwise(0)).alias("n_touched"),
            F.sum("_n").alias("n_leaves"),
        )
    )


def partial_nodes(factors: DataFrame, cells: DataFrame) -> DataFrame:
    """Scenarios that touch only some leaves of a node, one issue row each; none of their rows may be used.

    ``cells`` (entity_id, ds, measure) are the forecasts of nodes that there are; other cells don't count.
    """
    broken = factors.where(~F.col("uniform")).withColumnRenamed("node_id", "entity_id")
    broken = broken.join(cells, ["entity_id", "ds", "measure"], "left_semi")
    return broken.groupBy("scenario_id", F.lit("E_SCENARIO_PARTIAL_NODE").alias("code")).agg(F.count("*").alias("n_cells"))


def apply_scenario_nodes(predictions: DataFrame, factors: DataFrame, scenarios: tuple[Scenario, ...]) -> tuple[DataFrame, DataFrame]:
    """(scaled rows, issues) of upper-level forecasts, times the factor that all leaves of a node share.

    The rows carry their node as the entity. A scenario that covers a node in part gives no rows at
    all; the list of those has a row per scenario setting at most, which bounds the broadcast.
    """
    issues = partial_nodes(factors, predictions.select("entity_id", "ds", "measure"))
    names = F.array(*[F.lit(s.scenario_id) for s in scenarios])
    keys = ["scenario_id", "entity_id", "ds", "measure"]
    own = factors.withColumnRenamed("node_id", "entity_id").select(*keys, "factor")
    rows = predictions.withColumn("scenario_id", F.explode(names)).join(own, keys, "left")
    rows = rows.join(F.broadcast(issues.select("scenario_id")), "scenario_id", "left_anti")
    return _scaled(rows.withColumn("factor", F.coalesce("factor", F.lit(1.0)))), issues


def family_clashes(scenarios: tuple[Scenario, ...], regressor_names: dict[str, str]) -> list[tuple[str, str]]:
    """(scenario, family) used both as a regressor override and as a rule family."""
    found = []
    for s in scenarios:
        overridden = {regressor_names.get(r, r) for r in s.overrides}
        found += [(s.scenario_id, f) for f in sorted({r.family for r in _live(s.rules)} & overridden)]
    return found


def generate_scenarios(
    base: DataFrame,
    entities: DataFrame,
    scenarios: tuple[Scenario, ...],
    periods: list[date],
    regressor_names: dict[str, str] | None = None,
    with_base: bool = False,
    own_dates: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, issues, factor trace) of all scenarios, per method; the base stays as it is.

    Blocked scenarios are found on entities × periods, not on predictions. Their list has at
    most one row per scenario setting, which is what bounds the broadcast. ``with_base`` emits
    the base in the same pass, so the forecasts behind it are computed once. With ``own_dates``
    ties are looked for on the dates of the base's rows instead of ``periods``.
    """
    spark = base.sparkSession
    clashes = family_clashes(scenarios, regressor_names or {})
    clashing = {s for s, _ in clashes}
    open_ = tuple(s for s in scenarios if s.scenario_id != BASE and s.scenario_id not in clashing)
    issues = clash_issues(spark, clashes)
    if not open_:
        rest = base if with_base else base.where(F.lit(False))
        return rest.withColumn("factor", F.lit(1.0)), issues, compile_assumptions(entities, periods, ())
    rules = tuple(r for s in open_ for r in s.rules)
    cells = base.select("entity_id", F.col("ds").alias("period")) if own_dates else None
    ties = priority_ties(entities, periods, rules, cells)
    issues = issues.unionByName(
        ties.groupBy("scenario_id", "code").agg(F.count("*").alias("n_cells")).select("scenario_id", "code", "n_cells")
    )
    tied = F.broadcast(ties.select("scenario_id").distinct())
    wanted = (Scenario(BASE), *open_) if with_base else open_
    applied = apply_scenario(base, entities, wanted).join(tied, "scenario_id", "left_anti")
    trace = compile_assumptions(entities, periods, rules).join(tied, "scenario_id", "left_anti")
    return applied, issues, trace


def clash_issues(spark: SparkSession, clashes: list[tuple[str, str]]) -> DataFrame:
    rows = [(s, "E_SCENARIO_REG_FAMILY_DUP", 1) for s, _ in clashes]
    return spark.createDataFrame(rows, "scenario_id string, code string, n_cells long")


def assumption_preview(compiled: DataFrame) -> DataFrame:
    return compiled.groupBy("scenario_id", "measure", "family").agg(
        F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("period").alias("n_periods")
    )


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rule drafts as a table to (rule_id, problem) rows."""
    checks = {
        "rule without id": F.trim(F.coalesce("rule_id", F.lit(""))) == "",
        "base scenario takes no rules": F.col("scenario_id") == BASE,
        "rule without family": F.trim(F.coalesce("family", F.lit(""))) == "",
        "unknown measure": ~F.coalesce(F.col("measure").isin("unidades", "valor"), F.lit(False)),
        "rate must be above -100%": F.col("rate") <= -1.0,
        "pulse needs an end": (F.col("effect") == "pulse") & F.col("end").isNull(),
        "end before start": F.col("end") < F.col("start"),
        "priority below zero": F.col("priority") < 0,
    }
    found = F.array(*[F.when(condition, F.lit(text)) for text, condition in checks.items()])
    return rules.select("rule_id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def scenario_vs_base(scenario: DataFrame, base: DataFrame) -> DataFrame:
    keys = ["node_id", "measure", "ds", "model_alias"]
    return scenario.join(base.select(*keys, F.col("yhat").alias("yhat_base")), keys, "left").withColumn(
        "variation", F.try_divide(F.col("yhat") - F.col("yhat_base"), F.col("yhat_base"))
    )
