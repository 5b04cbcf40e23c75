"""Literal arrays and maps of many entries as one SQL expression each: plans with them are built in one call."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value: str | int | float) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def array_of(values: Iterable) -> Column:
    return F.expr(f"array({', '.join(map(_literal, values))})")


def map_of(values: dict) -> Column:
    return F.expr(f"map({', '.join(_literal(x) for kv in values.items() for x in kv)})")
