"""Adapters from the TPC-H-like parquet tables to source tables and canonical series."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.config import HierarchyConfig, MappingConfig, StudyConfig
from seriesmill.functions import ids

HISTORY_END = date(2001, 8, 1)
DIMENSIONS = ("tipo", "marca", "ean")
STUDY = StudyConfig(name="lineitem", dimensions=DIMENSIONS, history_end=HISTORY_END, analysis_level="ean")
HIERARCHY = HierarchyConfig(levels=(("tipo",), ("tipo", "marca"), ("tipo", "marca", "ean")))
LONG_MAPPING = MappingConfig(
    key_columns=DIMENSIONS,
    dimension_columns={d: d for d in DIMENSIONS},
    attribute_columns={"tamanho": "tamanho"},
    measure_columns={"unidades": "unidades", "valor": "valor"},
    period_column="periodo",
    thousands_separator="",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    """Whole cents as a long: exact sums in any order, and cheaper than wide decimals."""
    return F.floor(amount * 100 + 0.5).cast("long")


def _money(total: Column) -> Column:
    return (total.cast("decimal(20,0)") / 100).cast("decimal(20,2)")


def _met(rows: DataFrame) -> DataFrame:
    """Rows of parts that meet others by a shuffled join.

    Spark goes by the size of a file, and ids and texts made from it are many times larger: sent whole,
    they would fill the driver.
    """
    return rows.hint("merge")


def _part_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents per part and month; lineitem is reduced before anything joins it."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("ds"),
        cents(F.col("l_quantity")).alias("q"),
        cents(F.col("l_extendedprice")).alias("v"),
    )
    return items.groupBy("l_partkey", "ds").agg(F.sum("q").alias("q"), F.sum("v").alias("v"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_type").alias("tipo"),
        F.col("p_brand").alias("marca"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"),
    )
    return _met(rows)


def monthly_sales(spark: SparkSession, sf_dir: str, grain: str = "ean") -> DataFrame:
    """Sales per month of the grain."""
    joined = _part_sales(spark, sf_dir).join(_parts(spark, sf_dir), "l_partkey")
    dims = grain_dims(grain)
    if grain != "ean":
        joined = joined.groupBy(*dims, "ds").agg(F.sum("q").alias("q"), F.sum("v").alias("v"))
    return joined.select(*dims, "ds", _money(F.col("q")).alias("unidades"), _money(F.col("v")).alias("valor"))


def grain_dims(grain: str) -> list[str]:
    return list(DIMENSIONS[: DIMENSIONS.index(grain) + 1])


def _with_ids(rows: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    owned = rows.select(*keep, ids.entity_id([(d, F.col(d)) for d in dims]).alias("entity_id"))
    return owned.withColumns({f"id_{m}": ids.series_id(F.col("entity_id"), F.lit(m)) for m in ("unidades", "valor")})


def observations(spark: SparkSession, sf_dir: str, grain: str = "ean") -> DataFrame:
    """Canonical observations of monthly sales, one row per series and month.

    Ids of parts are made once per part, before the join with its months.
    """
    dims = grain_dims(grain)
    if grain == "ean":
        owners = _with_ids(_parts(spark, sf_dir), dims, ["l_partkey"])
        sales = _part_sales(spark, sf_dir).join(owners, "l_partkey")
        sales = sales.withColumns({"unidades": _money(F.col("q")), "valor": _money(F.col("v"))})
    else:
        sales = _with_ids(monthly_sales(spark, sf_dir, grain), dims, ["ds", "unidades", "valor"])
    measures = F.array(
        *[
            F.struct(F.col(f"id_{m}").alias("series_id"), F.lit(m).alias("measure"), F.col(m).alias("y_raw"))
            for m in ("unidades", "valor")
        ]
    )
    return (
        sales.select("entity_id", "ds", F.explode(measures).alias("m"))
        .select("entity_id", "m.series_id", "ds", "m.measure", "m.y_raw")
        .withColumn("_order", F.datediff("ds", F.lit(date(1970, 1, 1))).cast("long"))
    )


def entities(spark: SparkSession, sf_dir: str, grain: str = "ean") -> DataFrame:
    """Entities that own at least one sale, with their dimensions as columns and as a map."""
    dims = grain_dims(grain)
    sold = _met(table(spark, sf_dir, "lineitem").select("l_partkey").distinct())
    part = table(spark, sf_dir, "part")
    rows = part.join(sold, part.p_partkey == sold.l_partkey, "left_semi").select(
        F.col("p_type").alias("tipo"),
        F.col("p_brand").alias("marca"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"),
    )
    if grain != "ean":
        rows = rows.select(*dims).distinct()
    named = rows.select(
        ids.entity_id([(d, F.col(d)) for d in dims]).alias("entity_id"),
        *dims,
        F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))]).alias("dims"),
    )
    return _met(named) if grain == "ean" else named


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as messy text: locale money, mixed period spellings, blanks, bad keys."""
    items = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    joined = items.join(part, items.l_partkey == part.p_partkey)
    no_key = (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)
    ship = F.col("l_shipdate").cast("date")
    money = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"),
        F.when(no_key, "").otherwise(F.col("p_type")).alias("tipo"),
        F.when(no_key, "").otherwise(F.col("p_brand")).alias("marca"),
        F.when(no_key, "").otherwise(F.lpad(F.col("p_partkey").cast("string"), 13, "0")).alias("ean"),
        F.col("p_size").cast("string").alias("tamanho"),
        F.when((F.col("l_tax") == 0.07) & (F.col("l_discount") == 0.09), "2026-13")
        .when(F.col("l_returnflag") == "A", F.date_format(ship, "yyyyMM"))
        .when(F.col("l_linestatus") == "O", F.concat(F.date_format(ship, "yyyy"), F.lit("-Q"), F.quarter(ship)))
        .otherwise(F.date_format(ship, "yyyy-MM"))
        .alias("periodo"),
        F.when((F.col("l_tax") == 0.01) & (F.col("l_discount") == 0.05), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",5")))
        .otherwise(F.col("l_quantity").cast("long").cast("string"))
        .alias("unidades"),
        F.when((F.col("l_tax") == 0.02) & (F.col("l_discount") == 0.04), "n/a")
        .when((F.col("l_tax") == 0.02) & (F.col("l_discount") == 0.03), "--")
        .when((F.col("l_tax") == 0.02) & (F.col("l_discount") == 0.02), "sem valor")
        .otherwise(F.concat(F.lit("R$ "), money))
        .alias("valor"),
        F.col("l_suppkey").cast("string").alias("fornecedor"),
    )


def period_names(periods: int = 60) -> dict[str, date]:
    """Wide column names, newest last, spelled as YYYYMM."""
    from seriesmill.functions.periods import shift_date

    days = [shift_date(HISTORY_END, k) for k in range(-(periods - 1), 1)]
    return {d.strftime("%Y%m"): d for d in days}


# How each measure is labelled in the wide test table.
WIDE_LABELS = {"unidades": "UN", "valor": " Venda "}


def wide_mapping() -> MappingConfig:
    return MappingConfig(
        key_columns=("tipo", "marca"),
        dimension_columns={"tipo": "tipo", "marca": "marca"},
        measure_columns={"unidades": "unidades", "valor": "valor"},
        wide_periods=period_names(),
        measure_label_column="medida",
        decimal_separator=".",
    )


def raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text row per (tipo, marca, label) and one text column per month."""
    names = period_names()
    sales = monthly_sales(spark, sf_dir, "marca").where(
        F.col("ds").between(F.lit(min(names.values())), F.lit(max(names.values())))
    )
    cells = sales.select(
        "tipo",
        "marca",
        F.date_format("ds", "yyyyMM").alias("p"),
        F.explode(
            F.array(
                F.struct(F.lit(WIDE_LABELS["unidades"]).alias("medida"), F.col("unidades").cast("string").alias("t")),
                F.struct(F.lit(WIDE_LABELS["valor"]).alias("medida"), F.col("valor").cast("string").alias("t")),
                F.struct(F.lit("peso").alias("medida"), F.col("unidades").cast("string").alias("t")),
            )
        ).alias("m"),
    )
    wide = cells.groupBy("tipo", "marca", "m.medida").pivot("p", list(names)).agg(F.first("m.t"))
    return wide.na.fill("")
