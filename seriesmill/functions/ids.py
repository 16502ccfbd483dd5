"""Stable identifiers: SHA-256 over compact JSON text, the same on every cluster."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = "".join(map(chr, range(1, 32)))
# First byte of a packed id: any text, lower-case hex, made from its parts.
TEXT, HEX, MADE = b"\x00", b"\x01", b"\x02"


def clean_key(value: Column) -> Column:
    """Key text without control characters; null becomes the empty string."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), CONTROL, "")


def json_string(value: Column) -> Column:
    """One value as a quoted, escaped JSON string."""
    boxed = F.to_json(F.array(value))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def pairs_json(pairs: list[tuple[str, Column]]) -> Column:
    return F.to_json(F.array(*[F.array(F.lit(name), F.coalesce(col.cast("string"), F.lit(""))) for name, col in pairs]))


def entity_id(pairs: list[tuple[str, Column]]) -> Column:
    return F.sha2(pairs_json(pairs), 256)


def series_id(entity: Column, measure: Column) -> Column:
    return F.sha2(F.to_json(F.array(entity, measure)), 256)


def packed(value: Column) -> Column:
    """An id as bytes for a shuffle: half its length where it is lower-case hex. Null stays null, ``unpacked`` gives any text back."""
    bare = F.unhex(value)
    return F.when(F.lower(F.hex(bare)) == value, F.concat(F.lit(HEX), bare)).otherwise(F.concat(F.lit(TEXT), value.cast("binary")))


def unpacked(value: Column) -> Column:
    rest = F.substring(value, 2, 2**31 - 1)
    return F.when(F.substring(value, 1, 1) == F.lit(HEX), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def packed_series(series: Column, entity: Column, measure: Column) -> Column:
    """The same for a series id: one byte where it is the one that ``series_id`` makes."""
    return F.when(series == series_id(entity, measure), F.lit(MADE)).otherwise(packed(series))


def unpacked_series(value: Column, entity: Column, measure: Column) -> Column:
    return F.when(value == F.lit(MADE), series_id(entity, measure)).otherwise(unpacked(value))


def node_id(level: int, values: list[Column]) -> Column:
    parts = [F.lit(f'["h",{level}')]
    parts += [F.concat(F.lit(","), json_string(F.coalesce(v, F.lit("")))) for v in values]
    return F.sha2(F.concat(*parts, F.lit("]")), 256)


def total_node_id() -> Column:
    return F.sha2(F.lit('["h","total"]'), 256)


def stable_id(*parts: str) -> str:
    """The id of some texts known to the driver, as the column functions make it."""
    return hashlib.sha256(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
