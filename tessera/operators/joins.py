"""Joins: four methods with the same result, as hints to Spark's planner; semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

METHODS = {"nested-loops", "block-nested-loops", "indexed", "hash"}
#: Largest estimated size of an inner side that is broadcast.
BROADCAST_BYTES = 64 << 20
#: Tasks for each core over which a side is spread.
TASKS_EACH = 8


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a plan's size, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def scanned(df: DataFrame):
    """Spark's logical plan of df below its projections and filters."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan


def of_parquet(plan) -> bool:
    return plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet"


def fits_partitions(df: DataFrame) -> bool:
    """Whether a shuffle partition's share of df is known to be small enough for a hash table, which cannot spill."""
    return estimated_bytes(df) <= BROADCAST_BYTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: float) -> bool:
    """Whether df, of so many rows before any filter, is a stored relation under projections and filters that is small enough for a broadcast.

    Its rows are taken with all columns and uncompressed.  Whatever else makes rows is not small, as these are only guessed.
    """
    plan = scanned(df)
    if plan.nodeName() not in ("LocalRelation", "Range") and not of_parquet(plan):
        return False
    return max(estimated_bytes(df), rows * df._jdf.schema().defaultSize()) <= BROADCAST_BYTES


def hinted(right: DataFrame, method: str, equi: bool) -> DataFrame:
    """The inner side with the hint of a method.

    Block nested loops and indexed joins keep the inner side at every task, so they
    broadcast it, but only where it is estimated to be small; otherwise Spark partitions
    an equi join, and a theta join becomes a partitioned product.  The inner side of nested loops
    over a theta join goes the same way.  A hash table is asked for where it fits a task.
    """
    if method == "hash":
        return right.hint("shuffle_hash") if equi and fits_partitions(right) else right
    if method == "nested-loops" and equi:
        return right
    if estimated_bytes(right) <= BROADCAST_BYTES:
        return right.hint("broadcast")
    return right if equi else right.hint("shuffle_replicate_nl")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over several tasks for each core: a small file is one task otherwise, however many rows a join makes of it."""
    return df.repartition(TASKS_EACH * df.sparkSession.sparkContext.defaultParallelism)


def disjoint(left: DataFrame, right: DataFrame) -> None:
    common = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if common:
        raise ValueError(f"both sides have {sorted(common)}")


def inner_join(left: DataFrame, right: DataFrame, on: Column | None, method: str, equi: bool) -> DataFrame:
    """All columns of left, then all of right."""
    if method not in METHODS:
        raise ValueError(f"unknown join method {method!r}")
    disjoint(left, right)
    if on is None:
        return left.crossJoin(right)
    return left.join(hinted(right, method, equi), on, "inner")


def semi_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")
