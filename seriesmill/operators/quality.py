"""Profile, repair and eligibility of series (all partitioned by ``series_id``)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from seriesmill.config import (
    ADI_THRESHOLD,
    CV2_THRESHOLD,
    FAST_ZERO_SHARE,
    MAD_MULTIPLIER,
    MAD_SCALE,
    StudyConfig,
    TreatmentPolicy,
)
from seriesmill.functions import ids
from seriesmill.functions.periods import grid_start, period_sequence

SERIES = ["series_id", "measure", "entity_id"]
#: Rows that a task looks at together before it sends them to the task of their series.
RUN_ROWS = 1 << 18


@dataclass(frozen=True)
class Prepared:
    values: DataFrame
    adjustments: DataFrame
    excluded: DataFrame
    preparation_id: str | None = None
    issues: DataFrame | None = None


def profile_series(observations: DataFrame) -> DataFrame:
    y = F.col("y_raw").cast("double")
    positive = F.when(y > 0, y)
    out = observations.groupBy(*SERIES).agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.count("ds").alias("n_periods"),
        F.count("y_raw").alias("n_observed"),
        F.count_if(y.isNull()).alias("n_nulls"),
        F.count_if(y < 0).alias("n_negatives"),
        F.count_if(y == 0).alias("n_zeros"),
        F.count_if(y > 0).alias("n_positives"),
        F.stddev_samp(y).alias("std"),
        F.try_divide(F.sum("y_raw").cast("double"), F.count("y_raw")).alias("mean"),
        F.stddev_samp(positive).alias("_std_pos"),
        F.avg(positive).alias("_mean_pos"),
    )
    return out.withColumns(
        {
            "adi": F.try_divide(F.col("n_periods").cast("double"), F.col("n_positives").cast("double")),
            "cv2": F.pow(F.try_divide(F.col("_std_pos"), F.col("_mean_pos")), F.lit(2.0)),
        }
    ).drop("_std_pos", "_mean_pos")


def intermittency_class(profile: DataFrame) -> DataFrame:
    """Demand class by ADI and CV², plus the fast zero-share rule."""
    sparse = F.col("adi") >= ADI_THRESHOLD
    volatile = F.coalesce(F.col("cv2"), F.lit(0.0)) >= CV2_THRESHOLD
    label = (
        F.when(F.col("n_positives") == 0, "zero")
        .when(sparse & volatile, "lumpy")
        .when(sparse, "intermittent")
        .when(volatile, "erratic")
        .otherwise("smooth")
    )
    fast = (F.col("n_negatives") == 0) & (F.col("n_positives") > 0) & (
        (F.col("n_observed") - F.col("n_positives")) / F.col("n_observed") >= FAST_ZERO_SHARE
    )
    return profile.withColumns({"demand_class": label, "mostly_zero": fast})


def profile_coverage(observations: DataFrame, study: StudyConfig) -> DataFrame:
    """Expected periods from the first one in the grid to the grid end, real gaps and zero share."""
    start = F.lit(grid_start(study.history_end, study.history_periods, study.step))
    end = F.lit(study.history_end)
    inside = observations.where(F.col("ds").between(start, end))
    per_period = inside.groupBy(*SERIES, "ds").agg(F.sum("y_raw").alias("y"))
    months = F.months_between(end, F.col("first_ds")).cast("int")
    return (
        per_period.groupBy(*SERIES)
        .agg(
            F.min("ds").alias("first_ds"),
            F.count("*").alias("n_present"),
            F.count_if(F.col("y") == 0).alias("n_zeros"),
        )
        .withColumn("n_expected", (F.floor(months / study.step) + 1).cast("long"))
        .withColumn("n_gaps", F.col("n_expected") - F.col("n_present"))
        .withColumn("gap_share", F.col("n_gaps") / F.col("n_expected"))
        .withColumn("zero_share", F.col("n_zeros") / F.col("n_present"))
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a series that lie near each other as one row of lists; a list holds RUN_ROWS values at most."""

    def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        keys, rest = SERIES, [c for c in rows.column_names if c not in SERIES]
        lists = rows.group_by(keys, use_threads=False).aggregate([(c, "list") for c in rest])
        yield from lists.select(keys + [f"{c}_list" for c in rest]).rename_columns(keys + rest).to_batches(10_000)

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            held.append(batch.slice(at, RUN_ROWS))
            size += held[-1].num_rows
            if size >= RUN_ROWS:
                yield from joined(held)
                held, size = [], 0
    if held:
        yield from joined(held)


def _tasks(rows: DataFrame) -> int:
    """Adaptive execution merges tasks by what they read; where that grows afterwards in sorts or hash tables, their number is fixed."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def together(observations: DataFrame, values: list[str]) -> DataFrame:
    """The rows with all of a series in one task, so that nothing after it shuffles by series again.

    Ids are several times as long as what they name, so they travel once per series and task, not once per row.
    """
    rest = ["ds", *values]
    rows = observations.select("series_id", "measure", ids.packed(F.col("entity_id")).alias("entity_id"), *rest)
    fields = [StructField(f.name, ArrayType(f.dataType) if f.name in rest else f.dataType) for f in rows.schema]
    met = rows.mapInArrow(_runs, StructType(fields)).repartition(_tasks(rows), "series_id")
    cells = met.select(*SERIES, F.inline(F.arrays_zip(*rest)))
    return cells.withColumn("entity_id", ids.unpacked(F.col("entity_id")))


def _packed_keys() -> list[Column]:
    entity, measure = F.col("entity_id"), F.col("measure")
    series = ids.packed_series(F.col("series_id"), entity, measure).alias("_series")
    return [series, measure, ids.packed(entity).alias("_entity"), F.col("ds")]


def _unpacked(found: DataFrame, name: str) -> DataFrame:
    entity, measure = F.col("entity_id"), F.col("measure")
    found = found.withColumn("entity_id", ids.unpacked(F.col("_entity")))
    return found.withColumn("series_id", ids.unpacked_series(F.col("_series"), entity, measure)).select(*SERIES, "ds", name)


def _per_period(observations: DataFrame, value: Column, name: str, met: bool = False) -> DataFrame:
    """One aggregate per series and date. Ids are packed while they travel; rows that met already travel no more."""
    if met:
        return observations.groupBy(*SERIES, "ds").agg(value.alias(name))
    return _unpacked(observations.groupBy(*_packed_keys()).agg(value.alias(name)), name)


def profile_duplicates(observations: DataFrame) -> DataFrame:
    counted = _per_period(observations, F.count("*"), "n_rows")
    return counted.where("n_rows > 1").withColumn("code", F.lit("E_DUPLICATE"))


def drop_excluded(observations: DataFrame, policy: TreatmentPolicy, excluded_rows: DataFrame | None = None) -> DataFrame:
    out = observations
    if policy.excluded_series:
        out = out.where(~F.col("series_id").isin(*policy.excluded_series))
    if policy.trim_start is not None:
        out = out.where(F.col("ds") >= F.lit(policy.trim_start))
    if policy.trim_end is not None:
        out = out.where(F.col("ds") <= F.lit(policy.trim_end))
    if excluded_rows is not None:
        out = out.join(excluded_rows.select("source_row_id"), "source_row_id", "left_anti")
    return out


def dedup_sum(observations: DataFrame, met: bool = False) -> DataFrame:
    """Sum per series and period; ``met`` says that the rows come from ``together``."""
    return _per_period(observations, F.sum("y_raw").cast("decimal(20,2)"), "y_raw", met)


def keep_first_duplicate(observations: DataFrame, order: str = "_order", met: bool = False) -> DataFrame:
    """First row per series and period, the least value of those with the same order; nulls come first.

    Rows meet before they are compared: a least pair of order and value is found by sorting, which would spill
    whole inputs, while values per order and the first order are found in hash tables.
    """
    keys = [F.col(c) for c in (*SERIES, "ds")] if met else _packed_keys()
    rows = observations.select(*keys, F.col(order).alias("_o"), F.col("y_raw").alias("_y"))
    at = rows.columns[:4]
    if not met:
        rows = rows.repartition(_tasks(rows), *at)
    least = F.when(F.count("_y") == F.count("*"), F.min("_y"))
    per_order = rows.groupBy(*at, "_o").agg(least.alias("_y"))
    unordered = F.col("_o").isNull()
    first = F.when(F.count("_o") < F.count("*"), F.min(F.when(unordered, F.col("_y")))).otherwise(F.min_by("_y", "_o"))
    found = per_order.groupBy(*at).agg(first.alias("y_raw"))
    return found if met else _unpacked(found, "y_raw")


def densify(dedup: DataFrame, study: StudyConfig) -> DataFrame:
    """Every grid period from a series' first date on; one window, no grid cross join.

    Each row spans the periods up to the next one, so gaps are exploded out of the row before
    them and the last seen value is already at hand (``carried``). Dates between grid periods (months
    of a quarterly study, say) are not periods: they have no value here (``off_grid`` lists them),
    but a series that begins with one begins at the period after it.
    """
    start = F.lit(grid_start(study.history_end, study.history_periods, study.step))
    end = F.lit(study.history_end)
    place = _periods_from_end(study)
    on_grid = place["on_grid"]
    newest_first = Window.partitionBy("series_id").orderBy(F.desc("ds"))
    later = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    rows = dedup.select(*SERIES, "ds", F.col("y_raw").cast("double").alias("_y"), on_grid.alias("_on"), place["next"].alias("_up"))
    rows = rows.withColumns(
        {
            "_then": F.last(F.when(F.col("_on"), F.col("ds")), ignorenulls=True).over(later),
            "_opens": F.lead("ds").over(newest_first).isNull(),
        }
    )
    known = rows.where("_on or _opens").select(
        *SERIES,
        F.when(F.col("_on"), F.col("ds")).otherwise(F.col("_up")).alias("ds"),
        F.when(F.col("_on"), F.col("_y")).alias("_y"),
        F.add_months("_then", -study.step).alias("_next"),
    )
    spans = known.select(
        *SERIES,
        F.col("ds").alias("_at"),
        "_y",
        F.explode(
            period_sequence(F.greatest("ds", start), F.least(F.coalesce("_next", end), end), study.step)
        ).alias("ds"),
    )
    here = F.col("ds") == F.col("_at")
    return spans.select(
        *SERIES,
        "ds",
        F.when(here, F.col("_y")).alias("y"),
        F.when(F.col("_at") >= start, F.col("_y")).alias("carried"),
    )


def _periods_from_end(study: StudyConfig) -> dict[str, Column]:
    """Whether ``ds`` is a period of the grid, and the first period on or after it."""
    end = study.history_end
    months = (F.year("ds") - end.year) * 12 + F.month("ds") - end.month
    late = (F.dayofmonth("ds") > end.day).cast("int")
    up = months + late
    return {
        "on_grid": (F.pmod(months, F.lit(study.step)) == 0) & (F.dayofmonth("ds") == end.day),
        "next": F.add_months(F.lit(end), (up + F.pmod(-up, F.lit(study.step))).cast("int")),
    }


def off_grid(dedup: DataFrame, study: StudyConfig) -> DataFrame:
    """Observed rows whose date is not a period of the study, as issues."""
    rows = dedup.where(~_periods_from_end(study)["on_grid"])
    return rows.select(*SERIES, "ds", F.lit("E_DATE_OFF_GRID").alias("code"), F.lit("warning").alias("severity"))


def fill_zero(dense: DataFrame) -> DataFrame:
    return _filled(dense, F.lit(0.0), "zero_preenchido")


def fill_forward(dense: DataFrame) -> DataFrame:
    return _filled(dense, F.col("carried"), "ffill").where(F.col("y").isNotNull())


def _filled(dense: DataFrame, filler: Column, reason: str) -> DataFrame:
    seen = F.col("y").isNotNull()
    return dense.select(
        *SERIES,
        "ds",
        F.coalesce("y", filler).alias("y"),
        seen.alias("observed"),
        (~seen).alias("was_adjusted"),
        F.when(seen, "").otherwise(reason).alias("adjustment_reason"),
    )


def _observed_only(dense: DataFrame) -> DataFrame:
    return dense.where(F.col("y").isNotNull()).select(
        *SERIES,
        "ds",
        "y",
        F.lit(True).alias("observed"),
        F.lit(False).alias("was_adjusted"),
        F.lit("").alias("adjustment_reason"),
    )


def _gapless(dense: DataFrame) -> DataFrame:
    whole = Window.partitionBy("series_id")
    flagged = dense.withColumn("_gaps", F.count_if(F.col("y").isNull()).over(whole))
    return _observed_only(flagged.where("_gaps = 0").drop("_gaps"))


def drop_negatives(values: DataFrame) -> DataFrame:
    return values.where(F.col("y") >= 0)


def winsorize(values: DataFrame, quantile: float) -> DataFrame:
    """Cap at the series quantile; only rows that really change are marked."""
    cap = F.percentile("y", F.lit(quantile)).over(Window.partitionBy("series_id"))
    capped = F.col("y") > F.col("_cap")
    return (
        values.withColumn("_cap", cap)
        .withColumns(
            {
                "was_adjusted": F.col("was_adjusted") | capped,
                "adjustment_reason": F.when(capped, "winsorizado").otherwise(F.col("adjustment_reason")),
                "y": F.least("y", "_cap"),
            }
        )
        .drop("_cap")
    )


def outlier_flags(values: DataFrame, season: int) -> DataFrame:
    """|residual| > 3 × 1.4826 × MAD around the seasonal (two cycles) or overall median."""
    series = Window.partitionBy("series_id")
    slot = Window.partitionBy("series_id", "_slot")
    out = values.withColumn("_slot", F.month("ds") if season == 12 else F.quarter("ds"))
    out = out.withColumn("_n", F.count("*").over(series))
    seasonal = (F.col("_n") >= 2 * season) & F.lit(season > 1)
    centre = F.when(seasonal, F.median("y").over(slot)).otherwise(F.median("y").over(series))
    out = out.withColumn("residual", F.col("y") - centre)
    out = out.withColumn("mad", F.median(F.abs("residual")).over(series))
    limit = F.lit(MAD_MULTIPLIER * MAD_SCALE) * F.col("mad")
    return out.withColumn("is_outlier", (F.col("mad") > 0) & (F.abs("residual") > limit)).drop("_slot", "_n")


def eligible_series(values: DataFrame) -> DataFrame:
    return (
        values.groupBy("series_id")
        .agg(F.count("y").alias("n"), F.count_if(F.col("y").isNull()).alias("n_nulls"))
        .where("n > 0 AND n_nulls = 0")
        .select("series_id")
    )


def excluded_series(observations: DataFrame, values: DataFrame) -> DataFrame:
    """Raw series that did not survive preparation."""
    raw = observations.select("series_id").distinct()
    return raw.join(eligible_series(values), "series_id", "left_anti")


def adjustments_log(values: DataFrame) -> DataFrame:
    return values.where("was_adjusted").select("series_id", "ds", "adjustment_reason")


def prepare(
    observations: DataFrame, study: StudyConfig, policy: TreatmentPolicy, cutoff: date | None = None
) -> Prepared:
    """cutoff → exclusions → duplicates → grid and fill → negatives → outliers → eligibility."""
    raw = observations if cutoff is None else observations.where(F.col("ds") <= F.lit(cutoff))
    kept = drop_excluded(raw, policy)
    summed = policy.duplicates == "sum"
    met = together(kept, ["y_raw"] if summed else ["y_raw", "_order"])
    dedup = dedup_sum(met, met=True) if summed else keep_first_duplicate(met, met=True)
    dense = densify(dedup, study)
    fill = {"zero": fill_zero, "ffill": fill_forward, "exclude_series": _gapless, "keep_gaps": _observed_only}
    values = fill[policy.missing](dense)
    if policy.negatives == "reject":
        values = drop_negatives(values)
    if policy.outliers == "winsorize":
        values = winsorize(values, policy.upper_quantile)
    issues = preparation_issues(kept, dedup, study, policy)
    return Prepared(values, adjustments_log(values), excluded_series(observations, values), None, issues)


def preparation_issues(kept: DataFrame, dedup: DataFrame, study: StudyConfig, policy: TreatmentPolicy) -> DataFrame:
    """Repeated periods (an error where only the first row counts) and dates off the grid, as rows."""
    repeats = profile_duplicates(kept).select(
        *SERIES, "ds", "code", F.lit("error" if policy.duplicates == "reject" else "warning").alias("severity"), "n_rows"
    )
    return repeats.unionByName(off_grid(dedup, study).withColumn("n_rows", F.lit(1).cast("long")))


def preparation_id(fingerprint: Column, policy: TreatmentPolicy, cutoff: date | None) -> Column:
    """Content id of what a policy makes of a source with this fingerprint."""
    stamp = cutoff.isoformat() if cutoff else ""
    return F.sha2(F.to_json(F.array(fingerprint, F.lit(policy.to_json()), F.lit(stamp))), 256)


def preparation_key(fingerprint: str, study: StudyConfig, policy: TreatmentPolicy, cutoff: date | None) -> str:
    """The same for a fingerprint of the observations alone, which doesn't name the study yet."""
    return ids.stable_id(fingerprint, study.to_json(), policy.to_json(), cutoff.isoformat() if cutoff else "")
