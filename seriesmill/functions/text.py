"""Locale numbers, measure labels and text protection as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seriesmill.config import MODEL_LABELS

# Measure labels, formula characters and the shape of a number.
MEASURE_LABELS = {
    "un": "unidades",
    "unidade": "unidades",
    "unidades": "unidades",
    "valor": "valor",
    "venda": "valor",
    "value": "valor",
    "val": "valor",
}
FORMULA_START = r"^[=+\-@]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# End of fixed values.


def parse_number(text: Column, decimal: str = ",", thousands: str = "") -> Column:
    """Text to double; thousands marks, currency and spaces are dropped, anything else odd is null.

    Blank marks such as ``-`` and ``n/a`` match no number and need no test of their own. Each
    branch cleans the text once.
    """
    s = F.btrim(text, F.lit(" \t\r\n\u00a0"))
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    s = F.translate(F.replace(s, F.lit("R$"), F.lit("")), " \u00a0", "")
    if decimal == ",":
        s = F.when(text.contains(","), F.translate(s, ",.", ".")).otherwise(s)
    return F.regexp_extract(s, NUMBER, 0).try_cast("double")


def measure_of_label(text: Column) -> Column:
    """Canonical measure of a row label, null when the label is unknown."""
    flat = [F.lit(item) for pair in MEASURE_LABELS.items() for item in pair]
    return F.element_at(F.create_map(*flat), F.lower(F.trim(text)))


def protect_formula(text: Column) -> Column:
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def is_formula(text: Column) -> Column:
    return F.coalesce(text.rlike(FORMULA_START), F.lit(False))


def clean_study_name(text: Column) -> Column:
    """Whitespace collapsed; null when empty or longer than 120 characters."""
    s = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when((s != "") & (F.length(s) <= 120), s)


def filters_from_text(text: Column) -> Column:
    """``dim=v1,v2; dim2=v3`` to a map of value lists."""
    raw = F.str_to_map(text, F.lit("; ?"), F.lit("="))
    return F.transform_values(raw, lambda _, v: F.transform(F.split(v, ","), lambda x: F.trim(x)))


def filters_to_text(filters: Column) -> Column:
    parts = F.transform(F.map_entries(filters), lambda e: F.concat(e["key"], F.lit("="), F.concat_ws(",", e["value"])))
    return F.concat_ws("; ", F.array_sort(parts))


def chip_label(parts: list[Column]) -> Column:
    return F.concat_ws(" / ", *[F.when(p != "", p) for p in parts])


def model_label(alias: Column) -> Column:
    """Display name of a method; an unknown alias stands for itself."""
    flat = [F.lit(x) for pair in MODEL_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), alias), alias)


def looks_like(name: str, words: set[str]) -> bool:
    return any(w in words for w in re.split(r"[^0-9a-zà-ÿ]+", name.lower()))
