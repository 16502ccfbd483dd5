"""Kept things: runs, preparations, drafts, candidates, and what a source shows before it is read."""

import os
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from checks.q_hierarchy import rule
from seriesmill.config import MappingConfig, RegressorSpec, Scenario
from seriesmill.operators import normalize, quality
from seriesmill.plans import candidates, forecast_run, views
from seriesmill.plans.preparation import prepare_once
from seriesmill.session import scratch_dir
from seriesmill.sources import log, scan, store
from tests.test_methods import CONFIG, LEVELS, SEASONAL, SPARSE, STUDY, ZERO, observations, tree

UNITS = replace(STUDY, measures=("unidades",))
SERIES = {"a1": SEASONAL, "a2": SPARSE, "b1": [20 + (i % 7) for i in range(60)]}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


# Runs


@pytest.fixture(scope="module")
def run_root(spark):
    root = scratch_dir(spark, "run-test")
    status = forecast_run.stored_run(root, "run/1 ü", observations(spark, SERIES), tree(spark), UNITS, ZERO, CONFIG, LEVELS, "d", fitted=False)
    assert status == "completed"
    return root


def test_all_tables_of_a_run_are_kept(spark, run_root):
    tables = {name: store.load_run(spark, run_root, "run/1 ü", name).count() for name in store.RUN_TABLES}
    assert tables["issues"] == 0 and all(n > 0 for name, n in tables.items() if name != "issues")
    datasets = spark.createDataFrame([("d", "file.csv")], "dataset_id string, filename string")
    row = store.stored_catalog(spark, run_root, datasets).first()
    assert (row["run_id"], row["status"], row["n_series"], row["horizon"], row["filename"]) == ("run/1 ü", "completed", 3, 6, "file.csv")
    assert "SeasonalNaive" in row["models"].split(",")
    assert store.load_run(spark, run_root, "other", "cv") is None


def test_an_interrupted_write_stays_invisible(spark, monkeypatch):
    root = scratch_dir(spark, "interrupted")
    rows = spark.createDataFrame([("n", "m", "base", date(2026, 1, 1), "Naive", 1.0)], "node_id string, measure string, scenario_id string, ds date, model_alias string, yhat double")
    scores = spark.createDataFrame([("n", "m", "Naive", 0.5)], "node_id string, measure string, model_alias string, mae double")
    store.persist_run({"predictions": rows, "scores": scores}, root, "r")
    broken = scores.withColumn("mae", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.persist_run({"predictions": rows.withColumn("yhat", F.lit(2.0)), "scores": broken}, root, "r")
    assert store.load_run(spark, root, "r", "predictions").first()["yhat"] == 1.0
    more = rows.withColumns({"yhat": F.lit(3.0), "node_id": F.lit("other")}).unionByName(rows.withColumn("yhat", F.lit(4.0)))
    store.persist_run({"predictions": more}, root, "r")
    assert sorted(r["yhat"] for r in store.load_run(spark, root, "r", "predictions").collect()) == [3.0, 4.0]
    assert store.load_run(spark, root, "r", "scores").first()["mae"] == 0.5


def test_repeated_keys_of_a_batch_leave_the_same_row_everywhere(spark):
    rows = spark.createDataFrame([("n", float(k), str(k)) for k in range(50)], "node_id string, mae double, why string").repartition(7)
    assert {tuple(store.one_per_key(rows.repartition(k), ["node_id"]).first()) for k in (1, 3, 9)} == {("n", 49.0, "49")}


def test_runs_left_running_are_found(spark):
    root = scratch_dir(spark, "states")
    store.record_run(spark, root, "a", "running", dataset_id="d")
    store.record_run(spark, root, "b", "running", dataset_id="d")
    store.record_run(spark, root, "b", "completed")
    assert [r["run_id"] for r in store.mark_interrupted_runs(spark, root).collect()] == ["a"]
    assert store.mark_interrupted_runs(spark, root).count() == 0
    states = {r["run_id"]: (r["status"], r["dataset_id"], r["ended_at"] is not None) for r in store.stored_runs(spark, root).collect()}
    assert states == {"a": ("interrupted", "d", True), "b": ("completed", "d", True)}


def test_a_failed_run_says_so(spark):
    root = scratch_dir(spark, "failed")
    bad = observations(spark, SERIES).withColumn("y_raw", F.raise_error(F.lit("unreadable")).cast("decimal(20,2)"))
    with pytest.raises(Exception, match="unreadable"):
        forecast_run.stored_run(root, "r", bad, tree(spark), UNITS, ZERO, CONFIG, fitted=False)
    assert store.stored_runs(spark, root).first()["status"] == "failed" and store.load_run(spark, root, "r", "cv") is None
    wrong = Scenario("s", (rule("1", "s", "p", "unidades", "step", -2.0, date(2026, 1, 1)),))
    with pytest.raises(ValueError, match="-100%"):
        forecast_run.stored_run(root, "q", bad, tree(spark), UNITS, ZERO, CONFIG, scenarios=(wrong,))
    assert store.stored_runs(spark, root).count() == 1


# Preparations


def test_a_preparation_is_found_by_its_content(spark, monkeypatch):
    root = scratch_dir(spark, "preparation-test")
    obs = observations(spark, SERIES)
    first = prepare_once(obs, STUDY, ZERO, root)

    def never(*_, **__):
        raise AssertionError("prepared again")

    monkeypatch.setattr(quality, "prepare", never)
    again = prepare_once(obs.repartition(4), STUDY, ZERO, root)
    assert again.preparation_id == first.preparation_id
    assert again.values.count() == first.values.count() > 0 and again.excluded.count() == 0 and again.issues.count() == 0
    for other in (dict(policy=replace(ZERO, missing="ffill")), dict(study=replace(STUDY, history_periods=24)), dict(cutoff=date(2025, 6, 1)), dict(obs=obs.limit(5))):
        with pytest.raises(AssertionError, match="again"):
            prepare_once(other.get("obs", obs), other.get("study", STUDY), other.get("policy", ZERO), root, other.get("cutoff"))


def test_an_unfinished_preparation_is_not_used(spark):
    root = scratch_dir(spark, "unfinished")
    values = quality.prepare(observations(spark, {"a1": SEASONAL}), STUDY, ZERO).values
    with pytest.raises(Exception, match="lost"):
        store.save_preparation(values, root, "p", issues=values.select(F.raise_error(F.lit("lost")).alias("x").cast("string")))
    assert store.load_preparation(spark, root, "p") is None and store.save_preparation(values, root, "p")


# Drafts


def test_drafts_of_two_writers(spark):
    path = scratch_dir(spark, "drafts-test")
    assert store.saved_assumptions(spark, path, "d").count() == 0 and store.compact_assumptions(spark, path) == 0
    one = store.draft_rows(spark, "d", (Scenario("s1"), Scenario("s2")), (RegressorSpec("r", "old"),))
    two = store.draft_rows(spark, "d", (Scenario("s1", (rule("x", "s1", "p", "valor", "step", 0.1, date(2026, 1, 1)),)),), (RegressorSpec("r", "new"),))
    store.save_assumptions(two, path)
    store.save_assumptions(one, path)
    before = sorted(map(tuple, store.saved_assumptions(spark, path, "d").collect()))
    assert len(before) == 3 and '"rule_id":"x"' in str(before) and '"name":"new"' in str(before)
    assert store.compact_assumptions(spark, path) >= 2
    store.save_assumptions(one, path)
    assert sorted(map(tuple, store.saved_assumptions(spark, path, "d").collect())) == before
    assert store.saved_assumptions(spark, path, "other").count() == 0


def test_rows_added_during_a_compaction_stay(spark, monkeypatch):
    path = scratch_dir(spark, "compaction")
    schema = "k string, version long"
    for v in (1, 2):
        log.append(spark.createDataFrame([("a", v)], schema), path)
    append = log.append

    def late(rows, where):
        append(rows, where)
        append(spark.createDataFrame([("a", 3), ("b", 1)], schema), where)

    monkeypatch.setattr(log, "append", late)
    log.compact(spark, path, schema, ["k"])
    assert sorted(map(tuple, log.newest(log.read(spark, path, schema), ["k"]).collect())) == [("a", 3), ("b", 1)]


# Candidates


def test_candidates_read_one_part_and_compute_one_method(spark):
    root = scratch_dir(spark, "candidates-test")
    values = quality.prepare(observations(spark, SERIES | {"s": SEASONAL[-3:]}), STUDY, ZERO).values
    rows = forecast_run.P.train_panel(values, STUDY, CONFIG, forecast_run.P.calendar_folds(STUDY, CONFIG))
    candidates.store_panel(rows, f"{root}/panel")
    ask = lambda names, alias="MediaMovel3": candidates.candidate(spark, f"{root}/panel", f"{root}/cache", names, alias, STUDY, CONFIG)
    found = ask(("a1",)).first()
    assert found["status"] == "ok" and found["yhat"] == pytest.approx([sum(SEASONAL[-3:]) / 3] * 6) and len(found["dates"]) == 6
    files = sum(len(f) for _, _, f in os.walk(f"{root}/cache".removeprefix("file:")))
    ask(("a1",))
    assert files == sum(len(f) for _, _, f in os.walk(f"{root}/cache".removeprefix("file:")))
    both = {r["node_id"]: r["status"] for r in ask(("a1", "s", "unknown")).collect()}
    assert both == {"a1": "ok", "s": "insufficient_history"}
    assert {r["status"] for r in ask(("a1",), "ZeroBaseline").collect()} == {"not_eligible"}
    with pytest.raises(ValueError):
        ask(("a1",), "Unknown")
    panel = candidates._chosen(spark.read.parquet(f"{root}/panel"), [3], "series_id", ("a1",)).drop("part")
    plan = plan_of(candidates.candidate_frame(panel, "Naive", STUDY, CONFIG))
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [(part" in plan
    assert "MediaMovel" not in plan and "Croston" not in plan


# Dashboard


def test_dashboard_parts_share_one_selection(spark, run_root):
    run = {name: store.load_run(spark, run_root, "run/1 ü", name) for name in ("predictions", "cv", "scores", "issues")}
    run["values"] = quality.prepare(observations(spark, SERIES), STUDY, ZERO).values
    flt = views.ResultFilter(measure="unidades", model_alias="Naive")
    out = views.dashboard_query(run, tree(spark), None, flt)
    exchanges = 0
    for name, part in out.items():
        text = part._jdf.queryExecution().executedPlan().toString()
        own = text.count("Exchange hashpartitioning") + text.count("Exchange SinglePartition")
        assert own <= 3, (name, own)
        exchanges += own
    assert exchanges <= 8
    assert out["issues"].columns == run["issues"].columns and out["predictions"].count() == 18
    preds = views.query_predictions(run["predictions"], flt)
    history = views.leaf_history(run["values"])
    plain = views.view_cards(preds, history).first().asDict()
    found = out["cards"].first().asDict()
    assert found.keys() == plain.keys()
    assert all(found[k] == pytest.approx(plain[k]) if isinstance(plain[k], float) else found[k] == plain[k] for k in plain)
    mat = {(r["node_id"], r["ds"]): r["mat"] for r in out["mat"].collect()}
    expected = views.M.mat_forecast(history.select("node_id", "measure", "ds", "y"), preds)
    assert mat == pytest.approx({(r["node_id"], r["ds"]): r["mat"] for r in expected.collect()})
    metrics = out["metrics"].first().asDict()
    assert metrics == pytest.approx(views.FC.backtest_by_model(run["cv"], preds).first().asDict())
    nothing = views.dashboard_query(run, tree(spark), None, views.ResultFilter(scenario_id="none"))
    assert nothing["cards"].count() == nothing["mat"].count() == nothing["metrics"].count() == 0


# Sources


def write_csv(path, n):
    os.makedirs(path)
    for part in range(3):
        with open(f"{path}/part-{part}.csv", "w") as f:
            f.write("periodo;unidades;loja\n" + "".join(f"2025-01;{part * n + i};L{i % 3}\n" for i in range(n)))


def test_a_source_shows_its_first_rows_and_its_limit(spark, tmp_path):
    path = str(tmp_path / "in")
    write_csv(path, 60)
    profile, sample, issues = scan.inspect_text(spark, path, max_rows=179)
    rows = {r["column"]: (r["role"], r["inferred_type"], r["n_filled"], r["n_rows"]) for r in profile.collect()}
    assert rows == {"periodo": ("period", "text", 100, 100), "unidades": ("measure", "integer", 100, 100), "loja": ("dimension", "text", 100, 100)}
    assert [r["unidades"] for r in sample.collect()] == [str(k) for k in range(100)]
    assert [r["code"] for r in issues.collect()] == ["E_ROWS_LIMIT"]
    assert scan.inspect_text(spark, path, max_rows=180)[2].count() == 0


def test_the_limit_is_found_without_reading_everything(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(1)
            yield b

    rows = spark.range(0, 4000, 1, 40).mapInPandas(count, "id long")
    assert scan.over_limit(rows, 50)
    assert seen.value <= 2


def test_an_empty_source(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    open(tmp_path / "in" / "a.csv", "w").close()
    profile, _, issues = scan.inspect_text(spark, str(tmp_path / "in"), ";")
    assert profile.count() == 0 and [r["code"] for r in issues.collect()] == ["E_ROWS_INVALID"]


MAPPING = MappingConfig(("ean",), {"ean": "ean", "loja": "loja"}, {"unidades": "un"}, "periodo")


def long_source(spark, rows):
    return spark.createDataFrame(rows, "n long, ean string, loja string, periodo string, un string")


def test_normalize_gives_tables_issues_and_fingerprint(spark):
    rows = [(1, "1", "A", "2025-01", "10"), (2, "1", "B", "2025-02", "20"), (3, "2", "A", "2025-13", "1"), (4, "", "", "2025-01", "1"), (5, "2", "A", "2025-03", "x"), (6, "2", "A", "2025-03", "1,5")]
    df = long_source(spark, rows)
    ask = lambda d, **kw: normalize.normalize(d, STUDY, MAPPING, F.concat(F.lit("r"), F.col("n")), F.col("n"), "f", **kw)
    out = ask(df, limits=normalize.Limits(5, 1, 1))
    found = sorted((r["code"], r["source_row_id"]) if r["source_row_id"] else (r["code"], r["message"]) for r in out.issues.collect())
    assert found == [
        ("E_DATE_AMBIGUOUS", "r3"), ("E_DIMENSION_CONFLICT", "dimension changes between rows of one entity: loja in 1 rows"), ("E_ENTITY_LIMIT", "2 entities, limit 1"),
        ("E_KEY_EMPTY", "r4"), ("E_OBS_LIMIT", "2 observations, limit 1"), ("E_ROWS_LIMIT", "6 rows, limit 5"), ("E_ROW_INVALID", "r5"), ("E_UNITS_FRACTION", "r6"),
    ]
    plain = normalize.normalize_long(df, STUDY, MAPPING, F.concat(F.lit("r"), F.col("n")), F.col("n"))
    for name in ("observations", "entities", "source_rows"):
        assert sorted(map(str, getattr(out, name).collect())) == sorted(map(str, getattr(plain, name).collect()))
    assert out.fingerprint == ask(df.repartition(3)).fingerprint
    assert out.fingerprint != ask(long_source(spark, [(1, "1", "A", "2025-01", "11")])).fingerprint
    digest = normalize.content_digest(out.observations).first()
    assert digest["n_rows"] == 2


def test_normalize_without_a_column_or_rows(spark):
    df = long_source(spark, [(1, "1", "A", "2025-01", "10")])
    out = normalize.normalize(df.drop("un", "ean"), STUDY, MAPPING, F.col("n"), F.col("n"))
    assert sorted(r["code"] for r in out.issues.collect()) == ["E_KEY_MISSING", "E_MEASURE_MISSING"]
    assert out.observations.count() == 0 and out.fingerprint is None
    empty = normalize.normalize(df.limit(0), STUDY, MAPPING, F.col("n"), F.col("n"))
    assert empty.observations.count() == empty.issues.count() == 0 and len(empty.fingerprint) == 64
