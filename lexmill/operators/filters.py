"""Predicates built from filter maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text, vocab

#: Lists under these names are ignored if empty.
NAMED = {"sources": "source", "cantons": "canton", "law_types": "law_type"}


def compile_filter(filters: dict | None) -> Column:
    """The conjunction of year range, IN lists and equalities; rows without the field don't match."""
    parts: list[Column] = []
    for name, value in (filters or {}).items():
        if name == "year_range":
            if value.get("min") is not None:
                parts.append(F.col("year") >= value["min"])
            if value.get("max") is not None:
                parts.append(F.col("year") <= value["max"])
        elif name in NAMED:
            if value:
                parts.append(F.col(NAMED[name]).isin(*value))
        elif isinstance(value, (list, tuple, set)):
            parts.append(F.col(name).isin(*value))
        elif value is not None:
            parts.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def active_only(rows: DataFrame, active: DataFrame | None, number: str = "sr_number", source: str = "source") -> DataFrame:
    """Rows of cantonal source, and those whose number is active; without a list all rows."""
    if active is None or active.isEmpty():
        return rows
    known = active.select(F.col(number).alias("_active")).distinct()
    return rows.join(known, F.col(number) == F.col("_active"), "left").where((F.coalesce(F.col(source), F.lit("fedlex")) == "ticino") | F.col("_active").isNotNull()).drop("_active")


def is_ordinance(name: Column) -> Column:
    """P5."""
    return F.coalesce(text.contains_any(name, vocab.ORDINANCE_WORDS), F.lit(False))
