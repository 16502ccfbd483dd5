"""Profile, duplicates, fills, winsorizing, outliers, eligibility."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from checks import sql as S
from checks.registry import query
from seriesmill import testbed as T
from seriesmill.config import TreatmentPolicy
from seriesmill.functions.periods import grid_start
from seriesmill.operators import normalize as N
from seriesmill.operators import quality as Q
from seriesmill.plans.preparation import prepare_once
from seriesmill.session import scratch_dir

ZERO = TreatmentPolicy(duplicates="sum", missing="zero")


def canonical(spark, sf):
    src = T.raw_long(spark, sf)
    return N.normalize_long(src, T.STUDY, T.LONG_MAPPING, F.col("row_key"), F.col("row_no"))


def returns(spark, sf):
    """Net movements: returned rows count negative, so negatives occur and duplicates stay."""
    return canonical(spark, sf).observations.withColumn(
        "y_raw", F.when(F.col("source_row_id").endswith("7"), -F.col("y_raw")).otherwise(F.col("y_raw")).cast("decimal(20,2)")
    )


PROFILE_SQL = """
  SELECT series_id, measure, entity_id, min(ds) AS first_ds, max(ds) AS last_ds, count(ds) AS n_periods,
         count(y_raw) AS n_observed, count_if(y_raw IS NULL) AS n_nulls, count_if(y_raw < 0) AS n_negatives,
         count_if(y_raw = 0) AS n_zeros, count_if(y_raw > 0) AS n_positives,
         round(stddev_samp(CAST(y_raw AS DOUBLE)), 4) AS std,
         CAST(sum(y_raw) AS DOUBLE) / count(y_raw) AS mean,
         round(count(ds) / nullif(CAST(count_if(y_raw > 0) AS DOUBLE), 0), 4) AS adi,
         round(pow(stddev_samp(CASE WHEN y_raw > 0 THEN CAST(y_raw AS DOUBLE) END)
             / (CAST(sum(CASE WHEN y_raw > 0 THEN y_raw END) AS DOUBLE) / nullif(count_if(y_raw > 0), 0)), 2), 4) AS cv2
  FROM {t} GROUP BY series_id, measure, entity_id"""

ZDENSE = S.prep("ean").replace("FROM dense)", "FROM dense)")


def rounded(df, *cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("profile_series", S.q(S.obs(), PROFILE_SQL.format(t="obs")))
def _(spark, sf):
    return rounded(Q.profile_series(T.observations(spark, sf)), "std", "adi", "cv2")


CLASS_SQL = f"""
, prof AS (
  SELECT series_id, measure, count(ds) AS n_periods, count_if(y > 0) AS n_pos, count_if(y < 0) AS n_neg,
         stddev_samp(CASE WHEN y > 0 THEN y END) / avg(CASE WHEN y > 0 THEN y END) AS cv
  FROM prep GROUP BY series_id, measure)
SELECT series_id, measure,
       CASE WHEN n_pos = 0 THEN 'zero'
            WHEN n_periods / n_pos >= 1.32 AND coalesce(cv*cv, 0) >= 0.49 THEN 'lumpy'
            WHEN n_periods / n_pos >= 1.32 THEN 'intermittent'
            WHEN coalesce(cv*cv, 0) >= 0.49 THEN 'erratic' ELSE 'smooth' END AS demand_class,
       n_neg = 0 AND n_pos > 0 AND (n_periods - n_pos) / n_periods >= 0.6 AS mostly_zero
FROM prof"""


@query("intermittency_class", f"WITH {S.prep('ean').strip()} {CLASS_SQL.strip()}")
def _(spark, sf):
    values = Q.prepare(T.observations(spark, sf), T.STUDY, ZERO).values
    profile = Q.profile_series(values.withColumn("y_raw", F.col("y").cast("decimal(20,2)")))
    return Q.intermittency_class(profile).select("series_id", "measure", "demand_class", "mostly_zero")


@query(
    "profile_coverage",
    S.q(
        S.obs(),
        """SELECT series_id, measure, entity_id, first_ds, n_present, n_zeros, n_expected,
                  n_expected - n_present AS n_gaps, round((n_expected - n_present) / n_expected, 6) AS gap_share,
                  round(n_zeros / n_present, 6) AS zero_share
           FROM (SELECT series_id, measure, entity_id, min(ds) AS first_ds, count(*) AS n_present,
                        count_if(y_raw = 0) AS n_zeros,
                        date_diff('month', min(ds), DATE '2001-08-01') + 1 AS n_expected
                 FROM obs WHERE ds BETWEEN DATE '1996-09-01' AND DATE '2001-08-01' GROUP BY ALL)""",
    ),
)
def _(spark, sf):
    return rounded(Q.profile_coverage(T.observations(spark, sf), T.STUDY), "gap_share", "zero_share", digits=6)


@query(
    "profile_duplicates",
    S.q(
        S.canon_long(),
        """SELECT series_id, measure, entity_id, ds, count(*) AS n_rows, 'E_DUPLICATE' AS code
           FROM cobs GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def _(spark, sf):
    return Q.profile_duplicates(canonical(spark, sf).observations)


@query(
    "dedup_sum",
    S.q(S.canon_long(), "SELECT series_id, measure, entity_id, ds, CAST(sum(y_raw) AS DOUBLE) AS y_raw FROM cobs GROUP BY ALL"),
)
def _(spark, sf):
    return Q.dedup_sum(canonical(spark, sf).observations).withColumn("y_raw", F.col("y_raw").cast("double"))


@query(
    "keep_first_duplicate",
    S.q(
        S.canon_long(),
        """SELECT series_id, measure, entity_id, ds, CAST(y_raw AS DOUBLE) AS y_raw FROM cobs
           QUALIFY row_number() OVER (PARTITION BY series_id, ds ORDER BY row_no, y_raw) = 1""",
    ),
)
def _(spark, sf):
    return Q.keep_first_duplicate(canonical(spark, sf).observations).withColumn("y_raw", F.col("y_raw").cast("double"))


@query("filter_cutoff", S.q(S.obs(), "SELECT measure, count(*) AS n_rows, max(ds) AS last_ds, CAST(sum(y_raw) AS DOUBLE) AS total FROM obs WHERE ds <= DATE '2000-12-01' GROUP BY measure"))
def _(spark, sf):
    obs = T.observations(spark, sf).where(F.col("ds") <= F.lit(date(2000, 12, 1)))
    return obs.groupBy("measure").agg(
        F.count("*").alias("n_rows"), F.max("ds").alias("last_ds"), F.sum("y_raw").cast("double").alias("total")
    )


@query(
    "drop_excluded",
    S.q(
        S.canon_long(),
        """SELECT measure, count(*) AS n_rows, CAST(sum(y_raw) AS DOUBLE) AS total FROM cobs
           WHERE ds BETWEEN DATE '1997-01-01' AND DATE '2000-12-01'
             AND source_row_id NOT IN (SELECT row_key FROM src WHERE tipo = 'ECONOMY') GROUP BY measure""",
    ),
)
def _(spark, sf):
    policy = TreatmentPolicy(trim_start=date(1997, 1, 1), trim_end=date(2000, 12, 1))
    marked = T.raw_long(spark, sf).where("tipo = 'ECONOMY'").select(F.col("row_key").alias("source_row_id"))
    out = Q.drop_excluded(canonical(spark, sf).observations, policy, marked)
    return out.groupBy("measure").agg(F.count("*").alias("n_rows"), F.sum("y_raw").cast("double").alias("total"))


@query(
    "drop_negatives",
    S.q(
        S.canon_long(),
        """, signed AS (SELECT *, CASE WHEN suffix(source_row_id, '7') THEN -y_raw ELSE y_raw END AS y FROM cobs)
           SELECT measure, count(*) AS n_rows, CAST(sum(y) AS DOUBLE) AS total FROM signed WHERE y >= 0 GROUP BY measure""",
    ).replace(")\n, signed", "),\nsigned"),
)
def _(spark, sf):
    values = returns(spark, sf).withColumnRenamed("y_raw", "y")
    return Q.drop_negatives(values).groupBy("measure").agg(
        F.count("*").alias("n_rows"), F.sum("y").cast("double").alias("total")
    )


@query("densify_series", S.q(S.prep("marca"), "SELECT series_id, measure, entity_id, ds, y FROM dense"))
def _(spark, sf):
    return Q.densify(T.observations(spark, sf, "marca"), T.STUDY).select("series_id", "measure", "entity_id", "ds", "y")


@query(
    "gap_join",
    S.q(
        S.prep("ean"),
        """SELECT measure, ds, count(*) AS n_rows, count_if(y IS NULL) AS n_gaps,
                  round(CAST(sum(CAST(y AS DECIMAL(20,2))) AS DOUBLE), 2) AS total FROM dense GROUP BY measure, ds""",
    ),
)
def _(spark, sf):
    dense = Q.densify(T.observations(spark, sf), T.STUDY)
    return dense.groupBy("measure", "ds").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("y").isNull()).alias("n_gaps"),
        F.round(F.sum(F.col("y").cast("decimal(20,2)")).cast("double"), 2).alias("total"),
    )


PREP_COLS = "series_id, measure, entity_id, ds, y, observed, was_adjusted, adjustment_reason"


@query("fill_zero", S.q(S.prep("marca"), f"SELECT {PREP_COLS} FROM prep"))
def _(spark, sf):
    return Q.fill_zero(Q.densify(T.observations(spark, sf, "marca"), T.STUDY))


@query("fill_forward", S.q(S.prep("marca", "ffill"), f"SELECT {PREP_COLS} FROM prep"))
def _(spark, sf):
    return Q.fill_forward(Q.densify(T.observations(spark, sf, "marca"), T.STUDY))


@query("prepare", S.q(S.prep("ean"), f"SELECT {PREP_COLS} FROM prep"))
def _(spark, sf):
    return Q.prepare(T.observations(spark, sf), T.STUDY, ZERO).values


@query(
    "prepare_exclude_series",
    S.q(
        S.prep("marca"),
        """SELECT series_id, measure, entity_id, ds, y FROM dense
           QUALIFY count_if(y IS NULL) OVER (PARTITION BY series_id) = 0""",
    ),
)
def _(spark, sf):
    policy = replace(ZERO, missing="exclude_series")
    return Q.prepare(T.observations(spark, sf, "marca"), T.STUDY, policy).values.select(
        "series_id", "measure", "entity_id", "ds", "y"
    )


@query("prepare_keep_gaps", S.q(S.prep("marca"), "SELECT series_id, measure, entity_id, ds, y FROM dense WHERE y IS NOT NULL"))
def _(spark, sf):
    policy = replace(ZERO, missing="keep_gaps", duplicates="reject")
    return Q.prepare(T.observations(spark, sf, "marca"), T.STUDY, policy).values.select(
        "series_id", "measure", "entity_id", "ds", "y"
    )


WINSOR = """, cap AS (SELECT series_id, quantile_cont(y, 0.9) AS c FROM prep GROUP BY series_id),
win AS (
  SELECT p.series_id, p.measure, p.entity_id, p.ds, least(p.y, c) AS y, p.observed,
         p.was_adjusted OR p.y > c AS was_adjusted,
         CASE WHEN p.y > c THEN 'winsorizado' ELSE p.adjustment_reason END AS adjustment_reason
  FROM prep p JOIN cap USING (series_id))"""


@query(
    "winsorize",
    f"""WITH {S.prep("marca").strip()} {WINSOR}
    SELECT series_id, measure, entity_id, ds, round(y, 4) AS y, observed, was_adjusted, adjustment_reason FROM win""",
)
def _(spark, sf):
    values = Q.prepare(T.observations(spark, sf, "marca"), T.STUDY, ZERO).values
    return rounded(Q.winsorize(values, 0.9), "y")


@query(
    "adjustments_log",
    f"""WITH {S.prep("ean").strip()} {WINSOR}
    SELECT adjustment_reason, ds, count(*) AS n_rows, count(DISTINCT series_id) AS n_series
    FROM win WHERE was_adjusted GROUP BY ALL""",
)
def _(spark, sf):
    policy = replace(ZERO, outliers="winsorize", upper_quantile=0.9)
    log = Q.prepare(T.observations(spark, sf), T.STUDY, policy).adjustments
    return log.groupBy("adjustment_reason", "ds").agg(
        F.count("*").alias("n_rows"), F.countDistinct("series_id").alias("n_series")
    )


@query(
    "outlier_flags",
    f"""WITH {S.prep("ean").strip()}
, c AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM prep),
r AS (SELECT *, y - CASE WHEN n >= 24 THEN median(y) OVER (PARTITION BY series_id, month(ds))
                         ELSE median(y) OVER (PARTITION BY series_id) END AS residual FROM c),
m AS (SELECT *, median(abs(residual)) OVER (PARTITION BY series_id) AS mad FROM r)
SELECT series_id, measure, entity_id, ds, y, round(residual, 4) AS residual, round(mad, 4) AS mad
FROM m WHERE mad > 0 AND abs(residual) > 3 * 1.4826 * mad""",
)
def _(spark, sf):
    values = Q.prepare(T.observations(spark, sf), T.STUDY, ZERO).values
    out = Q.outlier_flags(values, 12).where("is_outlier")
    return rounded(out.select("series_id", "measure", "entity_id", "ds", "y", "residual", "mad"), "residual", "mad")


@query("eligible_series", S.q(S.prep("ean"), "SELECT series_id FROM prep GROUP BY 1 HAVING count(y) > 0 AND count_if(y IS NULL) = 0"))
def _(spark, sf):
    return Q.eligible_series(Q.prepare(T.observations(spark, sf), T.STUDY, ZERO).values)


@query(
    "excluded_minus_eligible",
    S.q(
        S.prep("marca"),
        """SELECT DISTINCT series_id FROM obs WHERE series_id NOT IN (
             SELECT series_id FROM dense GROUP BY 1 HAVING count_if(y IS NULL) = 0)""",
    ),
)
def _(spark, sf):
    return Q.prepare(T.observations(spark, sf, "marca"), T.STUDY, replace(ZERO, missing="exclude_series")).excluded


@query("issue_counts", S.q(S.canon_long(), "SELECT code, severity, count(*) AS n_rows, severity = 'error' AS blocking FROM issues GROUP BY ALL"))
def _(spark, sf):
    return N.issue_counts(canonical(spark, sf).issues)


def _json(value: str) -> str:
    return "'" + json.dumps(value, ensure_ascii=False).replace("'", "''") + "'"


LANES = "".join(f"|| '-' || CAST(sum(CAST(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))


def digest_sql(source: str) -> str:
    return f"""h AS (SELECT sha256(series_id || '|' || strftime(ds, '%Y-%m-%d') || '|' || CAST(y_raw AS VARCHAR)) AS h FROM {source}),
dig AS (SELECT count(*) AS n_rows, sha256(CAST(count(*) AS VARCHAR) {LANES}) AS digest FROM h)"""


@query("preparation_id", S.q(S.canon_long() + ",\n" + digest_sql("cobs"), f"""SELECT n_rows, sha256('["' || digest || '",' || {_json(ZERO.to_json())} || ',""]') AS preparation_id FROM dig"""))
def _(spark, sf):
    digest = N.content_digest(canonical(spark, sf).observations)
    return digest.select("n_rows", Q.preparation_id(F.col("digest"), ZERO, None).alias("preparation_id"))


@query("prepare_once", S.q(S.prep("marca") + ",\n" + digest_sql("obs"), f"""SELECT sha256('["' || digest || '",' || {_json(T.STUDY.to_json())} || ',' || {_json(ZERO.to_json())} || ',""]') AS preparation_id,
 adjustment_reason, count(*) AS n_rows, round(sum(y), 2) AS total, CAST(1 AS BIGINT) AS n_kept FROM prep, dig GROUP BY ALL"""))
def _(spark, sf):
    """Prepared twice: the second one finds the first by its content and keeps nothing new."""
    root = scratch_dir(spark, "prepared")
    obs = T.observations(spark, sf, "marca")
    first = prepare_once(obs, T.STUDY, ZERO, root)
    again = prepare_once(obs.repartition(3), T.STUDY, ZERO, root)
    assert first.preparation_id == again.preparation_id
    kept = spark.read.parquet(f"{root}/catalog").count()
    out = again.values.groupBy("adjustment_reason").agg(F.count("*").alias("n_rows"), F.round(F.sum("y"), 2).alias("total"))
    return out.withColumns({"preparation_id": F.lit(again.preparation_id), "n_kept": F.lit(kept).cast("long")})


@query("preparation_issues", S.q(S.raw_long(), """, k AS (SELECT row_no, CAST(strptime(CASE WHEN length(periodo) = 7 AND periodo[5] = '-' THEN periodo || '-01' END, '%Y-%m-%d') AS DATE) AS ds, ean FROM src
 WHERE ean <> '' AND regexp_full_match(periodo, '\\d{4}-\\d{2}') AND periodo <> '2026-13'),
d AS (SELECT ean, ds, count(*) AS n FROM k GROUP BY ALL)
SELECT 'E_DUPLICATE' AS code, 'error' AS severity, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_rows FROM d WHERE n > 1
UNION ALL SELECT 'E_DATE_OFF_GRID', 'warning', count(*), count(*) FROM d WHERE (2001 * 12 + 8 - year(ds) * 12 - month(ds)) % 3 <> 0""").replace(")\n, k", "),\nk"))
def _(spark, sf):
    """Single rows of lineitem in a quarterly study that keeps the first of repeated periods."""
    rows = T.raw_long(spark, sf).where((F.col("ean") != "") & F.col("periodo").rlike(r"^\d{4}-\d{2}$") & (F.col("periodo") != "2026-13"))
    rows = rows.select(
        F.col("ean").alias("series_id"), F.lit("unidades").alias("measure"), F.col("ean").alias("entity_id"),
        F.to_date(F.concat("periodo", F.lit("-01"))).alias("ds"), F.lit(1).cast("decimal(20,2)").alias("y_raw"), F.col("row_no").alias("_order"),
    )
    study = replace(T.STUDY, source_frequency="quarterly", model_frequency="quarterly")
    issues = Q.prepare(rows, study, replace(ZERO, duplicates="reject")).issues
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n_cells"), F.sum("n_rows").alias("n_rows"))


GRID_START = grid_start(T.STUDY.history_end, T.STUDY.history_periods, T.STUDY.step)
