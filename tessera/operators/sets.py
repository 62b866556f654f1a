"""Bag union of relations with equal names and types."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of both; ValueError unless names and types are equal in order."""
    kinds = [[(f.name, f.dataType.simpleString()) for f in df.schema] for df in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"schemas differ: {kinds[0]} and {kinds[1]}")
    return left.unionAll(right)
