"""Source rows (long or wide text tables) to canonical observations, entities and issues.

Everything hangs off one annotated projection of the source: each row carries its parsed
period, keys and an array of issues, and the four outputs are plain selections from it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import MappingConfig, StudyConfig
from seriesmill.functions import ids
from seriesmill.functions.once import once
from seriesmill.functions.periods import parse_period
from seriesmill.functions.text import measure_of_label, parse_number
from seriesmill.session import written

# Issue codes and their severities.
KEY_EMPTY = ("E_KEY_EMPTY", "error", "row without any key value")
BAD_DATE = ("E_DATE_AMBIGUOUS", "error", "period could not be read")
NOT_NUMERIC = ("E_ROW_INVALID", "warning", "value is not numeric")
FRACTION = ("E_UNITS_FRACTION", "error", "units must be whole")
BAD_LABEL = ("E_MEASURE_UNKNOWN", "error", "measure label is unknown")
CONFLICT = ("E_DIMENSION_CONFLICT", "error", "dimension changes between rows of one entity")
ROW_LIMIT, ENTITY_LIMIT, OBSERVATION_LIMIT = "E_ROWS_LIMIT", "E_ENTITY_LIMIT", "E_OBS_LIMIT"
# End of fixed values.

CELL_TYPE = "array<struct<measure:string,ds:date,raw:string>>"


ISSUE_ROW = "code string, severity string, message string, source_row_id string, entity_id string"


@dataclass(frozen=True)
class Canonical:
    observations: DataFrame
    entities: DataFrame
    source_rows: DataFrame
    issues: DataFrame
    fingerprint: str | None = None


@dataclass(frozen=True)
class Limits:
    """Product limits; one left at None is not checked."""

    rows: int | None = None
    entities: int | None = None
    observations: int | None = None


def _issue(code: str, severity: str, message: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))


def require_columns(columns: list[str], mapping: MappingConfig) -> list[tuple[str, str]]:
    """Schema check before any row is read: (code, column) of everything missing."""
    have = set(columns)
    found = [("E_KEY_MISSING", c) for c in mapping.key_columns if c not in have]
    if mapping.wide_periods:
        found += [("E_WIDE_PERIOD_INCOMPLETE", c) for c in mapping.wide_periods if c not in have]
        label = mapping.measure_label_column
        if label is not None and label not in have:
            found.append(("E_MEASURE_MISSING", label))
    else:
        if mapping.period_column not in have:
            found.append(("E_PERIOD_COLUMN_MISSING", str(mapping.period_column)))
        found += [("E_MEASURE_MISSING", c) for c in mapping.measure_columns.values() if c not in have]
    return found


def _map(columns: dict[str, str], clean: dict[str, str]) -> Column:
    flat = [x for name, col in columns.items() for x in (F.lit(name), F.col(clean[col]))]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def _annotate(df: DataFrame, mapping: MappingConfig, row_id: Column, row_order: Column, parsed: dict[str, Column]) -> DataFrame:
    used = dict.fromkeys(
        [*mapping.key_columns, *mapping.dimension_columns.values(), *mapping.attribute_columns.values()]
    )
    clean = {c: f"_c{i}" for i, c in enumerate(used)}
    rows = once(
        df,
        {
            "source_row_id": row_id.cast("string"),
            "_order": row_order.cast("long"),
            **{name: ids.clean_key(F.col(f"`{c}`")) for c, name in clean.items()},
            **parsed,
        },
    )
    keys = [(c, F.col(clean[c])) for c in mapping.key_columns]
    empty = F.lit(True)
    for _, value in keys:
        empty = empty & (value == "")
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        "source_row_id",
        "_order",
        *parsed,
        empty.alias("_no_key"),
        ids.entity_id(keys).alias("entity_id"),
        F.to_json(F.create_map(*[x for c, v in keys for x in (F.lit(c), v)])).alias("key_json"),
        _map(mapping.dimension_columns, clean).alias("dims"),
        _map(mapping.attribute_columns, clean).alias("attrs"),
    )


def _parsed(rows: DataFrame, cells: Column, mapping: MappingConfig, raw_columns: list[str]) -> DataFrame:
    """One row per source row with everything read from its text: key, dimensions, issue, and cells with values.

    ``rows`` carry ``_bad`` (a row issue or null); a bad row keeps one empty cell for the log.
    """
    hole = F.array(F.struct(F.lit(None), F.lit(None), F.lit(None))).cast(CELL_TYPE)
    found = F.when(F.col("_bad").isNull(), cells.cast(CELL_TYPE)).otherwise(hole)
    read = F.transform(
        found,
        lambda c: F.struct(
            c["measure"].alias("measure"),
            c["ds"].alias("ds"),
            parse_number(c["raw"], mapping.decimal_separator, mapping.thousands_separator).alias("y"),
        ),
    )
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw_columns]))
    return rows.select(
        "source_row_id", "_order", "entity_id", "key_json", "dims", "attrs", "_bad", read.alias("cells"), raw.alias("raw_json")
    )


def _cell_issue(bad: Column, cell: Column) -> Column:
    y = cell["y"]
    return (
        F.when(bad.isNotNull(), bad)
        .when(y.isNull(), _issue(*NOT_NUMERIC))
        .when((cell["measure"] == "unidades") & (y != F.floor(y)), _issue(*FRACTION))
    )


def _finish(rows: DataFrame, cells: Column, mapping: MappingConfig, raw_columns: list[str]) -> Canonical:
    """``rows`` carry ``_bad`` (a row issue or null); bad rows keep one empty cell for the log.

    Observations and issues are two filters over the same cells, each one pass over the source.
    """
    hole = F.array(F.struct(F.lit(None), F.lit(None), F.lit(None))).cast(CELL_TYPE)
    per_cell = rows.select(
        "source_row_id",
        "_order",
        "entity_id",
        "_bad",
        F.explode(F.when(F.col("_bad").isNull(), cells.cast(CELL_TYPE)).otherwise(hole)).alias("c"),
    )
    value = parse_number(F.col("c.raw"), mapping.decimal_separator, mapping.thousands_separator)
    per_cell = once(per_cell, {"y": value})
    per_cell = per_cell.withColumn("c", F.struct("c.measure", "c.ds", "y"))
    source_rows = rows.select(
        "source_row_id", "_order", F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw_columns])).alias("raw_json")
    )
    entities = build_entities(rows.where(F.col("_bad").isNull()))
    return Canonical(_observations(per_cell), entities, source_rows, _issues(per_cell))


def _observations(per_cell: DataFrame) -> DataFrame:
    good = per_cell.where(_cell_issue(F.col("_bad"), F.col("c")).isNull())
    return good.select(
        "source_row_id",
        "_order",
        "entity_id",
        ids.series_id(F.col("entity_id"), F.col("c.measure")).alias("series_id"),
        "c.ds",
        "c.measure",
        F.col("c.y").cast("decimal(20,2)").alias("y_raw"),
        F.lit(True).alias("observed"),
    )


def _issues(per_cell: DataFrame) -> DataFrame:
    marked = per_cell.withColumn("i", _cell_issue(F.col("_bad"), F.col("c")))
    return marked.where(F.col("i").isNotNull()).select("i.code", "i.severity", "i.message", "source_row_id", "entity_id")


def normalize_long(
    df: DataFrame, study: StudyConfig, mapping: MappingConfig, row_id: Column, row_order: Column
) -> Canonical:
    """One observation per (row, measure column)."""
    return _finish(*_long_rows(df, mapping, row_id, row_order), mapping, df.columns)


def _long_rows(df: DataFrame, mapping: MappingConfig, row_id: Column, row_order: Column) -> tuple[DataFrame, Column]:
    ds = parse_period(F.col(f"`{mapping.period_column}`"), mapping.period_format)
    rows = _annotate(df, mapping, row_id, row_order, {"_ds": ds})
    bad = F.when(F.col("_no_key"), _issue(*KEY_EMPTY)).when(F.col("_ds").isNull(), _issue(*BAD_DATE))
    cells = F.array(
        *[
            F.struct(F.lit(measure), F.col("_ds"), F.coalesce(F.col(f"`{c}`"), F.lit("")))
            for measure, c in mapping.measure_columns.items()
        ]
    )
    return rows.withColumn("_bad", bad), cells


def unpivot_wide(df: DataFrame, mapping: MappingConfig, id_columns: list[str]) -> DataFrame:
    """One row per (row, period column); the date comes with the column, so no lookup join."""
    cells = F.array(
        *[
            F.struct(F.lit(day).alias("ds"), F.col(f"`{column}`").alias("raw_value"))
            for column, day in mapping.wide_periods.items()
        ]
    )
    return df.select(*id_columns, F.explode(cells).alias("c")).select(*id_columns, "c.ds", "c.raw_value")


def normalize_wide(
    df: DataFrame, study: StudyConfig, mapping: MappingConfig, row_id: Column, row_order: Column
) -> Canonical:
    """One observation per (row, period column); the row's label names the measure."""
    return _finish(*_wide_rows(df, mapping, row_id, row_order), mapping, df.columns)


def _wide_rows(df: DataFrame, mapping: MappingConfig, row_id: Column, row_order: Column) -> tuple[DataFrame, Column]:
    if mapping.measure_label_column is not None:
        measure = measure_of_label(F.coalesce(F.col(f"`{mapping.measure_label_column}`"), F.lit("")))
    elif len(mapping.measure_columns) == 1:
        measure = F.lit(next(iter(mapping.measure_columns)))
    else:
        measure = F.lit(None).cast("string")
    rows = _annotate(df, mapping, row_id, row_order, {"_measure": measure})
    bad = F.when(F.col("_no_key"), _issue(*KEY_EMPTY)).when(F.col("_measure").isNull(), _issue(*BAD_LABEL))
    cells = F.array(
        *[
            F.struct(F.col("_measure"), F.lit(day), F.coalesce(F.col(f"`{c}`"), F.lit("")))
            for c, day in mapping.wide_periods.items()
        ]
    )
    return rows.withColumn("_bad", bad), cells


def _lanes(text: Column) -> list[Column]:
    """Four numbers of 48 bits from the SHA-256 of a text; their sums don't depend on the order of rows."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(4)]


def _observation_text(series: Column, ds: Column, y: Column) -> Column:
    return F.concat_ws("|", series, F.date_format(ds, "yyyy-MM-dd"), y.cast("string"))


def normalize(
    df: DataFrame,
    study: StudyConfig,
    mapping: MappingConfig,
    row_id: Column,
    row_order: Column,
    name: str = "",
    limits: Limits = Limits(),
) -> Canonical:
    """The whole result of reading a source: tables, every kind of issue, and the fingerprint.

    Missing columns end it before a row is read. Otherwise the text is parsed once, into scratch tables of rows and
    of observations; row counts and the content digest are observed while these are written, in the stage that writes them, so
    a task that runs again isn't counted twice. These tables hold entities as bytes, and series ids are made again
    from them when they are read. Issues are those of rows and cells, dimensions that change
    within an entity (one row per entity and dimension), and limits.
    """
    spark = df.sparkSession
    missing = require_columns(df.columns, mapping)
    if missing:
        rows = [(code, "error", f"column {column!r} is missing", None, None) for code, column in missing]
        return _nothing(spark, spark.createDataFrame(rows, ISSUE_ROW))
    shape = _wide_rows if mapping.wide_periods else _long_rows
    read = Observation()
    parsed = _parsed(*shape(df, mapping, row_id, row_order), mapping, df.columns)
    parsed = parsed.withColumn("entity_id", F.unhex("entity_id"))
    rows = written(parsed.observe(read, F.count(F.lit(1)).alias("rows")), "source_rows")
    rows = rows.withColumn("entity_id", F.lower(F.hex("entity_id")))
    per_cell = rows.select("source_row_id", "_order", "entity_id", "_bad", F.explode("cells").alias("c"))
    kept = Observation()
    found = once(_observations(per_cell), {"_l": F.array(*_lanes(_observation_text(F.col("series_id"), F.col("ds"), F.col("y_raw"))))})
    sums = [F.sum(F.col("_l")[i]).alias(f"lane{i}") for i in range(4)]
    found = found.observe(kept, F.count(F.lit(1)).alias("observations"), *sums).drop("_l", "series_id")
    observations = written(found.withColumn("entity_id", F.unhex("entity_id")), "observations")
    observations = observations.withColumn("entity_id", F.lower(F.hex("entity_id"))).select(
        "source_row_id",
        "_order",
        "entity_id",
        ids.series_id(F.col("entity_id"), F.col("measure")).alias("series_id"),
        "ds",
        "measure",
        "y_raw",
        "observed",
    )
    owners = Observation()
    entities = written(build_entities(rows.where(F.col("_bad").isNull())).observe(owners, F.count(F.lit(1)).alias("entities")), "entities")
    n = {**read.get, **owners.get, **kept.get}
    digest = _digest_text(n["observations"], [n[f"lane{i}"] or 0 for i in range(4)])
    content = hashlib.sha256(digest.encode()).hexdigest()
    fingerprint = ids.stable_id(name, str(n["observations"]), str(n["entities"]), mapping.to_json(), study.to_json(), content)
    issues = _issues(per_cell).unionByName(_conflict_issues(rows, mapping)).unionByName(_limit_issues(spark, n, limits))
    source_rows = rows.select("source_row_id", "_order", "raw_json")
    return Canonical(observations, entities, source_rows, issues, fingerprint)


def _nothing(spark: SparkSession, issues: DataFrame) -> Canonical:
    def empty(schema: str) -> DataFrame:
        return spark.createDataFrame([], schema)

    return Canonical(
        empty("source_row_id string, _order long, entity_id string, series_id string, ds date, measure string, y_raw decimal(20,2), observed boolean"),
        empty("entity_id string, key_json string, dimensions_json string, attributes_json string"),
        empty("source_row_id string, _order long, raw_json string"),
        issues,
        None,
    )


def _conflict_issues(rows: DataFrame, mapping: MappingConfig) -> DataFrame:
    dims = list(mapping.dimension_columns)
    good = rows.where(F.col("_bad").isNull()).select("entity_id", "_order", *[F.col("dims")[d].alias(d) for d in dims])
    found = dimension_conflicts(good, dims, "entity_id", "_order")
    text = F.concat(F.lit(CONFLICT[2] + ": "), "dimension", F.lit(" in "), F.col("conflict_rows").cast("string"), F.lit(" rows"))
    return found.select("code", F.lit(CONFLICT[1]).alias("severity"), text.alias("message"), F.lit(None).cast("string").alias("source_row_id"), "entity_id")


def _limit_issues(spark: SparkSession, n: dict[str, int], limits: Limits) -> DataFrame:
    checks = ((ROW_LIMIT, "rows", limits.rows), (ENTITY_LIMIT, "entities", limits.entities), (OBSERVATION_LIMIT, "observations", limits.observations))
    rows = [(code, "error", f"{n[what]} {what}, limit {most}", None, None) for code, what, most in checks if most is not None and n[what] > most]
    return spark.createDataFrame(rows, ISSUE_ROW)


def build_entities(rows: DataFrame) -> DataFrame:
    """One row per entity, the first source row wins.

    Distinct attribute combinations are reduced first, so an entity that owns a third of all
    rows leaves each map task as a handful of rows. Entities travel packed.
    """
    text = ["_entity", "key_json", "dimensions_json", "attributes_json"]
    flat = once(rows, {"_entity": ids.packed(F.col("entity_id"))}).select(
        "_entity",
        "key_json",
        F.to_json("dims").alias("dimensions_json"),
        F.to_json("attrs").alias("attributes_json"),
        "_order",
    )
    combos = flat.groupBy(*text).agg(F.min("_order").alias("first_order"))
    picked = F.min(F.struct("first_order", "key_json", "dimensions_json", "attributes_json")).alias("p")
    return combos.groupBy("_entity").agg(picked).select(
        ids.unpacked(F.col("_entity")).alias("entity_id"), "p.key_json", "p.dimensions_json", "p.attributes_json"
    )


def dimension_conflicts(rows: DataFrame, dimensions: list[str], entity: str, order: str) -> DataFrame:
    """Per (entity, dimension): the first value and how many rows disagree with it.

    Two aggregates, both combined map-side: rows per value, then values per entity. Entities travel packed,
    dimensions as their number.
    """
    long = once(rows, {"_entity": ids.packed(F.col(entity).cast("string"))}).select(
        "_entity",
        F.col(order).alias("_order"),
        F.explode(
            F.array(
                *[F.struct(F.lit(k).alias("d"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for k, d in enumerate(dimensions)]
            )
        ).alias("v"),
    ).select("_entity", "_order", "v.d", "v.value")
    per_value = long.groupBy("_entity", "d", "value").agg(
        F.min("_order").alias("first_order"), F.count("*").alias("n")
    )
    first = F.min(F.struct("first_order", "value", "n"))
    out = per_value.groupBy("_entity", "d").agg(
        F.count("*").alias("n_values"), F.sum("n").alias("n_rows"), first.alias("f")
    )
    return out.where((F.col("n_values") > 1) & (F.col("f.value") != "")).select(
        ids.unpacked(F.col("_entity")).alias("entity_id"),
        F.get(F.array(*[F.lit(d) for d in dimensions]), F.col("d")).alias("dimension"),
        F.col("f.value").alias("first_value"),
        "n_values",
        (F.col("n_rows") - F.col("f.n")).alias("conflict_rows"),
        F.lit(CONFLICT[0]).alias("code"),
    )


def guard_limits(
    observations: DataFrame, max_entities: int | None, max_observations: int | None, max_rows: int | None = None
) -> DataFrame:
    """Size limits as issue rows; a limit left at None is not checked. Rows are source rows."""
    sizes = [F.count("*").alias("n_observations")]
    if max_entities is not None:
        sizes.append(F.countDistinct(ids.packed(F.col("entity_id"))).alias("n_entities"))
    if max_rows is not None:
        sizes.append(F.countDistinct("source_row_id").alias("n_rows"))
    checks = [
        F.struct(F.lit(code).alias("code"), F.col(col).alias("found"), F.lit(limit).cast("long").alias("allowed"))
        for code, col, limit in (
            (ENTITY_LIMIT, "n_entities", max_entities),
            (OBSERVATION_LIMIT, "n_observations", max_observations),
            (ROW_LIMIT, "n_rows", max_rows),
        )
        if limit is not None
    ]
    none = F.array().cast("array<struct<code:string,found:bigint,allowed:bigint>>")
    found = observations.agg(*sizes).select(F.explode(F.array(*checks) if checks else none).alias("c"))
    return found.select("c.*").where("found > allowed")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(
        F.count("*").alias("n_rows"), (F.col("severity") == "error").alias("blocking")
    )


def content_digest(observations: DataFrame) -> DataFrame:
    """Order-independent fingerprint of (series, ds, y) as four summed hash lanes.

    Sums combine map-side, so nothing but one row per task ever meets in one place; a sorted
    concatenation of all row hashes would need the whole table in one task.
    """
    lanes = _lanes(_observation_text(F.col("series_id"), F.col("ds"), F.col("y_raw")))
    hashed = observations.select(F.array(*lanes).alias("h"))
    sums = [F.coalesce(F.sum(F.col("h")[i]), F.lit(0)).cast("string") for i in range(4)]
    text = F.concat_ws("-", F.count("*").cast("string"), *sums)
    return hashed.agg(F.count("*").alias("n_rows"), F.sha2(text, 256).alias("digest"))


def _digest_text(n: int, lanes: list) -> str:
    return "-".join([str(n), *[str(int(x)) for x in lanes]])
