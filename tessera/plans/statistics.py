"""Statistics of relations and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 10


def equi_width_histogram(df: DataFrame, field: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, low, high, n): equal ranges of width (max - min + 1) / buckets over a numeric column.

    One pass finds the ends, a second counts; both combine before their exchange.  Empty
    buckets are left out, and an empty table has none.
    """
    ends = df.agg(F.min(field).cast("double").alias("least"), F.max(field).cast("double").alias("most"))
    width = (F.col("most") - F.col("least") + 1) / buckets
    bucket = F.least(F.floor((F.col(field).cast("double") - F.col("least")) / F.col("width")), F.lit(buckets - 1)).cast("int")
    # One row: its size is fixed.
    placed = df.select(field).crossJoin(F.broadcast(ends.withColumn("width", width)))
    counted = placed.groupBy(bucket.alias("bucket"), "least", "width").agg(F.count(F.lit(1)).alias("n")).where("bucket is not null")
    low = F.col("least") + F.col("bucket") * F.col("width")
    return counted.select("bucket", low.alias("low"), (low + F.col("width")).alias("high"), "n")


def sample_estimate(df: DataFrame, factor: float, seed: int = 7) -> float:
    """Rows of a sample of one row in factor, times factor."""
    return df.sample(1.0 / factor, seed).count() * factor


def selectivity(before: DataFrame, after: DataFrame, factor: float = 1.0, seed: int = 7) -> float:
    """Share of rows that an operator keeps, by samples of both sides."""
    rows = sample_estimate(before, factor, seed)
    return sample_estimate(after, factor, seed) / rows if rows else 0.0


def analyze(database, name: str) -> str:
    """Save a relation as a catalog table and compute statistics of all columns, for cost-based plans in SQL."""
    table = f"{name.lower()}_analyzed"
    database.table(name).write.mode("overwrite").saveAsTable(table)
    database.spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
    return table
