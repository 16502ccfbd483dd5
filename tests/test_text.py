"""Numbers, periods, labels and ids on one literal per rule."""

import hashlib
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from seriesmill.config import ForecastConfig, HierarchyConfig, MappingConfig, StudyConfig
from seriesmill.functions import ids, periods, text
from seriesmill.operators.hierarchy import level_issues
from seriesmill.operators.models import candidate_registry
from seriesmill.operators.normalize import require_columns
from seriesmill.sources import scan


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("", None), ("-", None), ("--", None), ("n/a", None), ("N/A", None), (" 12 ", 12.0), ("1,5", 1.5),
        ("R$ 1.234,56", 1234.56), ("1 234,5", 1234.5), ("abc", None), ("1d", None), ("-3", -3.0), ("1e3", 1000.0),
    ],
)
def test_parse_number(spark, value, expected):
    assert one(spark, text.parse_number, value) == expected


def test_parse_number_point_and_thousands(spark):
    assert one(spark, lambda c: text.parse_number(c, ".", ","), "1,234.5") == 1234.5


@pytest.mark.parametrize(
    "value,expected",
    [
        ("2026-07", date(2026, 7, 1)), ("202607", date(2026, 7, 1)), ("2026-Q3", date(2026, 7, 1)),
        ("2026", date(2026, 1, 1)), ("2026-13", None), ("julho", None), ("", None),
    ],
)
def test_parse_period(spark, value, expected):
    assert one(spark, periods.parse_period, value) == expected


@pytest.mark.parametrize(
    "value,expected",
    [
        ("201606.0", date(2016, 6, 1)), ("06/2016", date(2016, 6, 1)), ("2016/06", date(2016, 6, 1)),
        ("2016-Q3", date(2016, 7, 1)), ("2016-06-01 00:00:00", date(2016, 6, 1)), ("2016", date(2016, 1, 1)),
        ("MAT-2016-07", date(2016, 7, 1)), ("Mês 1", date(2026, 8, 1)), ("Mês 13", date(2025, 8, 1)),
        ("201613", None), ("classe", None),
    ],
)
def test_parse_period_header(spark, value, expected):
    assert one(spark, lambda c: periods.parse_period_header(c, date(2026, 8, 1)), value) == expected


@pytest.mark.parametrize("value,expected", [("=SUM(A1)", "'=SUM(A1)"), ("+x", "'+x"), ("-x", "'-x"), ("@x", "'@x"), ("x=", "x=")])
def test_protect(spark, value, expected):
    assert one(spark, text.protect_formula, value) == expected


def test_labels(spark):
    assert one(spark, text.measure_of_label, " Venda ") == "valor"
    assert one(spark, text.measure_of_label, "foo") is None
    assert one(spark, text.model_label, "TSB") == "Demanda intermitente (TSB)"
    assert one(spark, text.clean_study_name, "  a \t b ") == "a b"
    assert one(spark, text.clean_study_name, "x" * 121) is None


@pytest.mark.parametrize("value", ["ação", 'say "x"', "back\\slash", "tab\there", "", "0123"])
def test_ids_match_compact_json(spark, value):
    want = hashlib.sha256(json.dumps([["ean", value]], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, lambda c: ids.entity_id([("ean", c)]), value) == want
    want = hashlib.sha256(json.dumps(["h", 1, value], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, lambda c: ids.node_id(1, [c]), value) == want


def test_period_sequence_is_empty_when_reversed(spark):
    df = spark.range(1).select(
        periods.period_sequence(F.lit(date(2020, 5, 1)), F.lit(date(2020, 1, 1)), 1).alias("s"),
        periods.period_sequence(F.lit(date(2020, 1, 1)), F.lit(date(2020, 10, 1)), 3).alias("q"),
    ).first()
    assert df["s"] == [] and len(df["q"]) == 4


def test_header_tools():
    assert scan.dedup_header(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
    assert scan.classify_columns(["classe", "Unidades", "periodo"]) == {
        "classe": "dimension", "Unidades": "measure", "periodo": "period",
    }


def test_number_rows_over_many_splits(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    out = scan.number_rows(df).collect()
    assert sorted(r["row_index"] for r in out) == list(range(1000))
    assert all(r["v"] == 3 * r["row_index"] for r in out)


def test_headers_and_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;a;a\n1;2;3\n4;5;6\n")
    (tmp_path / "b.csv").write_text("x;a;a\n" + "7;8;9\n" * 5000)
    df = scan.scan_text_table(spark, str(tmp_path / "*.csv"))
    assert df.columns == ["x", "a", "a_2"]
    rows = {r["source_row_id"]: r["raw_json"] for r in scan.assign_source_row_id(df).collect()}
    assert len(rows) == 5002 and set(rows) == {f"r{k}" for k in range(5002)}
    assert json.loads(rows["r0"]) == {"x": "1", "a": "2", "a_2": "3"} and json.loads(rows["r1"])["x"] == "4"


def test_config_checks():
    study = StudyConfig("s", ("a",), date(2026, 8, 1))
    assert study.validate() == []
    bad = StudyConfig(" ", (), None, 61, ("peso",), "monthly", "monthly", "direct", "z")
    assert {k for k, _ in bad.validate()} == {
        "name", "dimensions", "analysis_level", "measures", "history_end", "mat_mode",
    }
    assert [k for k, _ in bad.validate({"monthly": 60})].count("history_periods") == 1
    assert ForecastConfig().validate() == []
    worse = ForecastConfig(0, 0, 1, 101, ("a",) * 6, 0, 42, False)
    assert {k for k, _ in worse.validate()} == {"horizon", "season_length", "nonnegative_output", "interval_level", "cv_horizon"}
    assert len(worse.validate(most_models=5)) == 6
    assert json.loads(study.to_json())["history_end"] == "2026-08-01"


def test_require_columns():
    mapping = MappingConfig(("ean",), {"ean": "ean"}, {"valor": "valor"}, "periodo")
    assert require_columns(["ean"], mapping) == [("E_PERIOD_COLUMN_MISSING", "periodo"), ("E_MEASURE_MISSING", "valor")]
    wide = MappingConfig(("ean",), {}, {}, wide_periods={"202601": date(2026, 1, 1)}, measure_label_column="medida")
    assert [c for c, _ in require_columns([], wide)] == ["E_KEY_MISSING", "E_WIDE_PERIOD_INCOMPLETE", "E_MEASURE_MISSING"]


def test_hierarchy_levels():
    assert level_issues(HierarchyConfig((("a",), ("a", "b")))) == []
    assert len(level_issues(HierarchyConfig((("a",), ("b",)), forecast_level=5))) == 2


def test_registry_follows_frequency_and_choice():
    yearly = StudyConfig("s", ("a",), date(2026, 1, 1), 5, model_frequency="yearly", source_frequency="yearly")
    assert "SeasonalNaive" not in [s.alias for s in candidate_registry(yearly, ForecastConfig())]
    chosen = candidate_registry(StudyConfig("s", ("a",), date(2026, 1, 1)), ForecastConfig(models=("TSB", "Naive")))
    assert [s.alias for s in chosen] == ["ZeroBaseline", "Naive", "TSB"]
