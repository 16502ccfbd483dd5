"""Text-table scans, header inspection and layout detection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from seriesmill.config import MappingConfig, StudyConfig
from seriesmill.functions.periods import infer_frequency, parse_period_header
from seriesmill.functions.text import looks_like
from seriesmill.session import written

# Candidate separators, in order of preference, and name hints per column role.
DELIMITERS = (";", ",", "\t")
MEASURE_WORDS = {"unidades", "valor", "value", "units", "qty", "quantity", "vendas", "sales", "revenue", "receita"}
PERIOD_WORDS = {"periodo", "period", "date", "data", "mes", "month"}
MIN_WIDE_PERIODS = 12
# End of fixed values.
#: Blocks whose row counts (some 200 bytes each) are sent to every task.
SENT_BLOCKS = 100_000


def scan_text_table(
    spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "UTF-8", header: bool = True
) -> DataFrame:
    """Delimited text with every cell as a string: no inference, blanks as empty text.

    Column names come from the header line as it is written: the reader itself would rename repeated
    ones first.
    """

    def reader():
        return spark.read.option("sep", delimiter).option("encoding", encoding).option("escape", '"')

    plain = reader().csv(path, header=False, inferSchema=False)
    if not header:
        return plain.na.fill("")
    line = plain.first()
    if line is None:
        return plain
    names = dedup_header([c if c is not None else f"_c{k}" for k, c in enumerate(line)])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return reader().schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=True).na.fill("")


def sniff_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """Separator seen in the first non-empty line; the default is the first candidate."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1)
    found = F.coalesce(*[F.when(F.col("value").contains(d), F.lit(d)) for d in DELIMITERS], F.lit(DELIMITERS[0]))
    return first.select(found.alias("delimiter"))


def dedup_header(names: list[str]) -> list[str]:
    """Repeated headers get ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def column_role(name: str) -> str:
    if looks_like(name, PERIOD_WORDS):
        return "period"
    return "measure" if looks_like(name, MEASURE_WORDS) else "dimension"


def classify_columns(names: list[str]) -> dict[str, str]:
    return {name: column_role(name) for name in names}


def inspect_source(df: DataFrame) -> DataFrame:
    """Per column: guessed role, inferred type, filled cells and total rows, in one pass."""

    def stats(name: str) -> list[Column]:
        text = F.trim(F.col(f"`{name}`").cast("string"))
        filled = text != ""
        return [
            F.count_if(filled),
            F.count_if(filled & text.try_cast("long").isNotNull()),
            F.count_if(filled & text.try_cast("double").isNotNull()),
            F.count_if(filled & text.rlike(r"^\d{4}-\d{2}-\d{2}") & F.substring(text, 1, 10).try_cast("date").isNotNull()),
        ]

    names = df.columns
    one = df.agg(
        F.count("*").alias("n_rows"), *[F.array(*stats(n)).alias(f"_{i}") for i, n in enumerate(names)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.lit(column_role(n)).alias("role"), F.col(f"_{i}").alias("s"))
            for i, n in enumerate(names)
        ]
    )
    s = F.col("c.s")
    kind = (
        F.when(s[0] == 0, "empty")
        .when(s[1] == s[0], "integer")
        .when(s[2] == s[0], "number")
        .when(s[3] == s[0], "date")
        .otherwise("text")
    )
    return one.select("n_rows", F.explode(rows).alias("c")).select(
        "c.column", "c.role", kind.alias("inferred_type"), s[0].alias("n_filled"), "n_rows"
    )


#: Rows of the sample that tells what a source holds.
SAMPLE = 100


def source_sample(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "UTF-8", rows: int = SAMPLE) -> DataFrame:
    """The first rows of a source, by file name: files are opened until there are enough rows."""
    found = None
    for file in sorted(spark.read.text(path).inputFiles()):
        part = scan_text_table(spark, file, delimiter, encoding).limit(rows)
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        taken = found.limit(rows).collect()
        if len(taken) == rows:
            break
    if found is None or not found.columns:
        return spark.createDataFrame([], "")
    return spark.createDataFrame(taken, found.schema)


def over_limit(df: DataFrame, most: int) -> bool:
    """Whether there are more rows than that. Partitions are read until the answer is known, not all of them."""
    return bool(df.select(F.lit(1)).offset(most).limit(1).collect())


def inspect_text(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", max_rows: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(column profile of the sample, the sample, issues) of a delimited source, without reading all of it."""
    if delimiter is None:
        first = sniff_delimiter(spark, path).first()
        delimiter = first["delimiter"] if first else DELIMITERS[0]
    sample = source_sample(spark, path, delimiter, encoding)
    rows = scan_text_table(spark, path, delimiter, encoding)
    over = max_rows is not None and over_limit(rows, max_rows)
    issues = [("E_ROWS_LIMIT", "error", f"more than {max_rows} rows")] if over else []
    if not sample.columns:
        issues.append(("E_ROWS_INVALID", "error", "there is no header line"))
    profile = inspect_source(sample) if sample.columns else spark.createDataFrame([], PROFILE)
    return profile, sample, spark.createDataFrame(issues, "code string, severity string, message string")


PROFILE = "column string, role string, inferred_type string, n_filled long, n_rows long"


def number_rows(df: DataFrame, first: int = 0) -> DataFrame:
    """Dense row numbers in file order (path, then place in the file) without a global sort.

    Each block of a file counts its own rows; only one row per block is ordered to get the offsets,
    written once, and sent to all tasks if there are at most ``SENT_BLOCKS`` of them. Frames that
    don't come from files are numbered by their partitions. ``df`` must be a plain scan or a
    checkpointed frame, so both passes see the same blocks.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        part = F.shiftright(F.monotonically_increasing_id(), 33)
        placed = df.select("*", F.lit("").alias("_path"), part.alias("_block"))
    tagged = placed.withColumn("_mono", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_mono").alias("_least"))
    earlier = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_least")
    offsets = written(sizes.select("_path", "_block", before.alias("_before")), "offsets")
    if offsets.count() <= SENT_BLOCKS:
        offsets = F.broadcast(offsets)
    return (
        tagged.join(offsets, ["_path", "_block"])
        .withColumn("row_index", F.col("_before") + F.col("_mono") + first)
        .drop("_mono", "_path", "_block", "_before")
    )


def assign_source_row_id(df: DataFrame, key: Column | None = None) -> DataFrame:
    """``r<i>`` ids and header-based row numbers; with a key column nothing is shuffled."""
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw_json")
    if key is not None:
        return df.select(F.concat(F.lit("r"), key.cast("string")).alias("source_row_id"), raw)
    return number_rows(df).select(
        F.concat(F.lit("r"), F.col("row_index").cast("string")).alias("source_row_id"),
        (F.col("row_index") + 2).alias("row_number"),
        raw,
    )


def time_settings(dates: DataFrame, column: str = "ds") -> DataFrame:
    """Last period, number of periods and frequency from the smallest gap between distinct dates."""
    gaps = period_gaps(dates, column)
    n = F.count("*")
    return gaps.agg(
        F.max("ds").alias("history_end"),
        n.alias("n_periods"),
        infer_frequency(F.min("gap_days")).alias("frequency"),
    ).withColumns(
        {
            "history_end": F.when(F.col("n_periods") >= 2, F.col("history_end")),
        }
    )


def period_gaps(dates: DataFrame, column: str = "ds") -> DataFrame:
    """Gap to the previous distinct period; the distinct calendar is small whatever the data."""
    distinct = dates.where(F.col(column).isNotNull()).select(F.col(column).alias("ds")).distinct()
    before = F.lag("ds").over(Window.orderBy("ds"))
    return distinct.select("ds", F.datediff("ds", before).alias("gap_days"))


def autodetect_wide(
    df: DataFrame, history_end: date | None = None, name: str = "autodetected"
) -> tuple[StudyConfig, MappingConfig] | None:
    """Period-like headers become periods, the others dimensions; None when too few of either.

    Only the header is read: the parse runs on the column names, not on the rows.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "name string")
    parsed = names.select("name", parse_period_header(F.col("name"), history_end).alias("ds")).collect()
    days = {r["name"]: r["ds"] for r in parsed}
    periods = {c: days[c] for c in df.columns if days[c] is not None}
    dims = tuple(c for c in df.columns if days[c] is None)
    if len(periods) < MIN_WIDE_PERIODS or not dims:
        return None
    calendar = spark.createDataFrame([(d,) for d in periods.values()], "ds date")
    found = time_settings(calendar).first()
    frequency = found["frequency"] or "monthly"
    study = StudyConfig(
        name=name,
        dimensions=dims,
        history_end=found["history_end"],
        history_periods=len(periods),
        measures=("unidades",),
        source_frequency=frequency,
        model_frequency=frequency,
        analysis_level=dims[-1],
    )
    mapping = MappingConfig(
        key_columns=dims,
        dimension_columns={d: d for d in dims},
        measure_columns={"unidades": "unidades"},
        wide_periods=periods,
        decimal_separator=".",
    )
    return study, mapping
