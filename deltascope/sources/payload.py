"""Rows that come as JSON text: only objects and arrays of the expected shape are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_record(c: Column, schema: str) -> Column:
    """The struct of a JSON object; one with nulls for anything else."""
    read = F.when(F.ltrim(c).startswith("{"), F.from_json(c, schema))
    return F.coalesce(read, F.from_json(F.lit("{}"), schema))


def as_array(c: Column, element: str) -> Column:
    """The array of a JSON array, its entries of another shape left out; else empty."""
    read = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{element}>"))
    return F.coalesce(F.filter(read, lambda x: x.isNotNull()), F.array().cast(f"array<{element}>"))
