"""Period parsing and calendar arithmetic as Column expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.config import STEP_MONTHS


def _month_start(year: Column, month: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-01")).try_cast("date")


def _quarter_start(text: Column, pattern: str) -> Column:
    quarter = F.regexp_extract(text, pattern, 2).try_cast("int")
    return _month_start(F.regexp_extract(text, pattern, 1), (quarter * 3 - 2).cast("string"))


# The accepted period spellings.
YEAR_MONTH = r"^(\d{4})-(\d{1,2})$"
COMPACT = r"^(\d{4})(\d{2})$"
QUARTER = r"^(\d{4})-?[Qq]([1-4])$"
YEAR = r"^(\d{4})$"
ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})([ T].*)?$"
COMPACT_FLOAT = r"^(\d{4})(\d{2})(\.0)?$"
YEAR_SLASH = r"^(\d{4})/(\d{1,2})$"
SLASH_YEAR = r"^(\d{1,2})/(\d{4})$"
MAT_END = r"^MAT-(\d{4})-(\d{1,2})$"
RELATIVE = r"^[Mm][êe]s (\d{1,3})$"
# End of fixed values.


def _pair(text: Column, pattern: str, year_group: int = 1, month_group: int = 2) -> Column:
    return _month_start(F.regexp_extract(text, pattern, year_group), F.regexp_extract(text, pattern, month_group))


def parse_period(text: Column, fmt: str = "auto") -> Column:
    """First day of the period for YYYY-MM, YYYYMM, YYYY-Qn and YYYY; null when unreadable."""
    s = F.trim(text)
    by_format = {
        "YYYY-MM": (YEAR_MONTH, _pair(s, YEAR_MONTH)),
        "YYYYMM": (COMPACT, _pair(s, COMPACT)),
        "YYYY-Qn": (QUARTER, _quarter_start(s, QUARTER)),
        "YYYY": (YEAR, _month_start(F.regexp_extract(s, YEAR, 1), F.lit("01"))),
    }
    chosen = by_format.values() if fmt == "auto" else [by_format[fmt]]
    out = F.lit(None).cast("date")
    for pattern, value in reversed(list(chosen)):
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def parse_period_header(text: Column, history_end: date | None = None, step: int = 1) -> Column:
    """Column-header grammar of wide files; ``Mês k`` counts back from ``history_end``."""
    s = F.trim(text)
    out = F.when(s.rlike(ISO_DATE), F.trunc(F.substring(s, 1, 10).try_cast("date"), "month"))
    out = out.when(s.rlike(COMPACT_FLOAT), _pair(s, COMPACT_FLOAT))
    out = out.when(s.rlike(YEAR_MONTH), _pair(s, YEAR_MONTH))
    out = out.when(s.rlike(YEAR_SLASH), _pair(s, YEAR_SLASH))
    out = out.when(s.rlike(SLASH_YEAR), _pair(s, SLASH_YEAR, 2, 1))
    out = out.when(s.rlike(QUARTER), _quarter_start(s, QUARTER))
    out = out.when(s.rlike(YEAR), _month_start(s, F.lit("01")))
    out = out.when(s.rlike(MAT_END), _pair(s, MAT_END))
    if history_end is not None:
        back = F.regexp_extract(s, RELATIVE, 1).try_cast("int")
        out = out.when(s.rlike(RELATIVE), F.add_months(F.lit(history_end), (1 - back) * step))
    return out


def period_floor(ds: Column, frequency: str) -> Column:
    unit = {"monthly": "month", "mat": "month", "quarterly": "quarter", "yearly": "year"}[frequency]
    return F.trunc(ds, unit)


def add_periods(ds: Column, count: Column | int, step: int) -> Column:
    count = F.lit(count) if isinstance(count, int) else count
    return F.add_months(ds, (count * step).cast("int"))


def shift_date(value: date, months: int) -> date:
    index = value.year * 12 + value.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def grid_start(history_end: date, periods: int, step: int) -> date:
    return shift_date(history_end, -(periods - 1) * step)


def period_sequence(start: Column, end: Column, step: int) -> Column:
    """Dates from start to end; empty when start lies after end (``sequence`` alone would raise)."""
    interval = F.expr(f"interval {step} months")
    return F.when(start <= end, F.sequence(start, end, interval)).otherwise(F.array().cast("array<date>"))


def period_label(ds: Column, frequency: str) -> Column:
    if frequency == "yearly":
        return F.date_format(ds, "yyyy")
    if frequency == "quarterly":
        return F.concat(F.date_format(ds, "yyyy"), F.lit("-Q"), F.quarter(ds).cast("string"))
    return F.date_format(ds, "yyyy-MM")


def infer_frequency(min_gap_days: Column) -> Column:
    return (
        F.when(min_gap_days.isNull(), F.lit(None).cast("string"))
        .when(min_gap_days <= 31, "monthly")
        .when(min_gap_days <= 100, "quarterly")
        .otherwise("yearly")
    )


def months_of(frequency: str) -> int:
    return STEP_MONTHS[frequency]
