"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of a 64-bit finaliser (splitmix64); fixed values.
MIX_1 = U64(0xBF58476D1CE4E5B9)
MIX_2 = U64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none, and all runs on one machine (tests), a temporary folder is chosen.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a reader of it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and that nothing is to read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int | None:
    """The plan's size estimate; None where Spark knows nothing (it then says the largest long, or multiples)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def shuffle_partitions(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Partitions for a custom exchange: the session's number, or more if the plan's size estimate asks for it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, (estimated_bytes(df) or 0) // bytes_each)


def built(df: DataFrame, bytes_each: int = 64 << 20) -> DataFrame:
    """df as the side that a hash join builds, if a shuffle partition's share of it is known to fit into bytes_each.

    Such a table cannot spill.  Where the size is unknown or larger, df comes back without a
    hint and Spark sorts and merges.  For tables with one row a key only.  Written tables are
    compressed; four times their size is reckoned with.
    """
    size, n = estimated_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if size is not None and 4 * size <= n * bytes_each else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand at most so many rows to Python at once: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def texts_of(docs: DataFrame) -> DataFrame:
    """Only doc_id and text of a table of documents, whatever else it has."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> U64(30))
    x = x * MIX_1
    x = x ^ (x >> U64(27))
    x = x * MIX_2
    return x ^ (x >> U64(31))


def odd_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)
