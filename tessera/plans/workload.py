"""The access workload: a sequential scan, and reads by row number with a share of them remapped at random."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of row numbers that each mode remaps; mode 1 is the scan.
REMAPPED = {1: 0.0, 2: 0.2, 3: 0.5, 4: 0.8}


def access_order(df: DataFrame, key: list[str], mode: int, seed: int = 7) -> DataFrame:
    """df with ``position``: every row once, its place in the order of access.

    Mode 1 is the order of key.  In the other modes a share of the rows, chosen by hash, swap
    their places among themselves.  Row numbers need a global order, which is dealt by key
    ranges with counts of the ranges before.
    """
    numbered = row_numbers(df, key)
    if mode not in REMAPPED:
        raise ValueError(f"unknown mode {mode}")
    if mode == 1:
        return numbered
    hashed = F.xxhash64(F.lit(seed), *key)
    moved = F.pmod(hashed, F.lit(1000)) < int(1000 * REMAPPED[mode])
    stay = numbered.where(~moved)
    go = numbered.where(moved)
    old = row_numbers(go.select("position"), ["position"], "slot").select("slot", F.col("position").alias("to"))
    new = row_numbers(go.withColumn("__h", hashed), ["__h", *key], "slot")
    return stay.unionByName(new.drop("position", "__h").join(old, "slot").drop("slot").withColumnRenamed("to", "position"))


def row_numbers(df: DataFrame, key: list[str], name: str = "position") -> DataFrame:
    """Numbers from 0 in the order of key, by buckets of the first key's quantiles: no window over the whole table.

    There are as many buckets as shuffle partitions, so they shrink as a cluster grows.
    """
    first, n = key[0], max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = sorted({float(x) for x in df.approxQuantile(first, [k / n for k in range(1, n)], 0.2 / n)})
    bounds = F.array(*[F.lit(q) for q in quantiles]) if quantiles else F.array().cast("array<double>")
    dealt = df.withColumn("__bucket", F.size(F.filter(bounds, lambda q: F.col(first) >= q)))
    counts = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__bucket", before.alias("__before"))  # one row a bucket
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*key)) - 1
    return dealt.withColumn("__at", within).join(F.broadcast(offsets), "__bucket").withColumn(name, F.col("__before") + F.col("__at")).drop("__bucket", "__at", "__before")


def run_workload(tables: list[tuple[DataFrame, list[str]]], mode: int) -> int:
    """Rows read, each once, in any mode."""
    return sum(access_order(df, key, mode).agg(F.count("position")).head()[0] for df, key in tables)
