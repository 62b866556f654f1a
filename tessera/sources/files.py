"""Delimited and fixed-width sources, and the sinks they are loaded into."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.schema import Schema

#: Field layouts of fixed-width records (struct letters), 143 and 139 bytes; fixed values.
LINEITEM_FORMAT = "iiiiffffss10s10s10s25s10s44s"
ORDERS_FORMAT = "iisf10s15s15si79s"
#: Parsers of delimited fields: i integer, d double, s string, t date as yyyymmdd.
PARSERS = "idst"
#: Fixed-width records that are decoded at once.
RECORDS = 1 << 16


def as_yyyymmdd(column):
    """A date or timestamp as an integer yyyymmdd."""
    return F.date_format(column, "yyyyMMdd").cast("int")


def read_delimited(spark: SparkSession, path: str, schema: Schema, parsers: str, separator: str = "|") -> DataFrame:
    """A file without header; one parser letter for each field.  Malformed rows fail the read."""
    if len(parsers) != len(schema.fields) or set(parsers) - set(PARSERS):
        raise ValueError("one parser of i, d, s, t is needed for each field")
    kinds = {"i": T.LongType(), "d": T.DoubleType(), "s": T.StringType(), "t": T.StringType()}
    raw = T.StructType([T.StructField(f, kinds[p]) for f, p in zip(schema.fields, parsers, strict=True)])
    df = spark.read.csv(path, sep=separator, schema=raw, header=False, mode="FAILFAST")
    dates = {f: as_yyyymmdd(F.to_date(f)) for f, p in zip(schema.fields, parsers, strict=True) if p == "t"}
    return schema.conform(df.withColumns(dates) if dates else df)


def load_delimited(spark: SparkSession, paths: dict[str, tuple[str, Schema, str]], database, scale_factor: float = 1.0, seed: int = 7) -> None:
    """Create and fill relations from files, keeping each row with probability scale_factor."""
    for name, (path, schema, parsers) in paths.items():
        df = read_delimited(spark, path, schema, parsers)
        database.createRelation(name, schema, replace=True)
        database.insert(name, df.sample(scale_factor, seed) if scale_factor < 1 else df)


def fixed_fields(layout: str) -> list[tuple[str, int, int]]:
    """(letter, size, offset) of each field of a layout; numbers are aligned to their size, as in native structs."""
    out, at, number = [], 0, ""
    for c in layout:
        if c.isdigit():
            number += c
            continue
        size = int(number or 1) if c == "s" else struct.calcsize(f"<{c}")
        for _ in range(1 if c == "s" else int(number or 1)):
            at += -at % size if c != "s" else 0
            out.append((c, size, at))
            at += size
        number = ""
    return out


def record_size(layout: str) -> int:
    c, size, at = fixed_fields(layout)[-1]
    return at + size


def record_dtype(layout: str, names: list[str]) -> np.dtype:
    """The layout as a structured type: native alignment, no padding after the last field."""
    fields = fixed_fields(layout)
    if len(fields) != len(names):
        raise ValueError(f"{len(fields)} names needed")
    formats = [f"S{size}" if c == "s" else {"i": "<i4", "f": "<f4", "d": "<f8", "q": "<i8", "h": "<i2"}[c] for c, size, _ in fields]
    return np.dtype({"names": names, "formats": formats, "offsets": [at for *_, at in fields], "itemsize": record_size(layout)})


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a folder, or a single file, with their sizes; hidden ones are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath(), s.getLen()) for s in system.listStatus(where) if s.isFile()]
    return [(p.toString(), n) for p, n in found if not p.getName().startswith(("_", "."))]


def _local(path: str) -> str:
    """A URI that pyarrow opens: Hadoop writes file:/x for local files."""
    return path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1)


def read_fixed(spark: SparkSession, path: str, layout: str, names: list[str], range_bytes: int = 64 << 20) -> DataFrame:
    """Packed little-endian records of one size: ranges of whole records, decoded as arrays.

    A table has one row for each range of a file; executors read their ranges by pyarrow's
    file systems.  A file that ends within a record fails the read.
    """
    dtype, size = record_dtype(layout, names), record_size(layout)
    each, ranges = max(1, range_bytes // size) * size, []
    for file, length in _files(spark, path):
        if length % size:
            raise ValueError(f"{file} ends within a record")
        ranges += [(file, at, min(each, length - at)) for at in range(0, length, each)]
    kinds = {"S": T.StringType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
    kind_of = {n: kinds["S" if dtype[n].kind == "S" else dtype[n].str[1:]] for n in names}
    schema = T.StructType([T.StructField(n, kind_of[n]) for n in names])

    def read(batches):
        for batch in batches:
            for file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = fs.FileSystem.from_uri(_local(file))
                with system.open_input_file(name) as f:
                    for begin in range(at, at + length, size * RECORDS):
                        raw = f.read_at(min(size * RECORDS, at + length - begin), begin)
                        records = np.frombuffer(raw, dtype=dtype)
                        yield pa.record_batch([text_array(records[n]) if dtype[n].kind == "S" else pa.array(np.ascontiguousarray(records[n])) for n in names], names)

    table = spark.createDataFrame(ranges, "file string, start long, length long")
    return table.repartition(max(1, len(ranges)), "file", "start").mapInArrow(read, schema) if ranges else spark.createDataFrame([], schema)


def text_array(column: np.ndarray) -> pa.Array:
    """Strings without the padding at their end."""
    return pa.array(np.char.rstrip(column, b"\0 \n").tolist(), pa.binary()).cast(pa.string())


def write_fixed(df: DataFrame, path: str, layout: str) -> None:
    """Packed records as one binary file a partition, strings cut to size.  NULL fails the write.

    Every attempt of a task writes a file of its own in a hidden folder; those of the
    attempts that succeeded are then moved into place, so retries leave nothing twice.
    """
    spark, names = df.sparkSession, [f"c{k}" for k in range(len(df.columns))]
    dtype = record_dtype(layout, names)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(conf)
    where = where.makeQualified(system.getUri(), system.getWorkingDirectory())
    hidden = jvm.org.apache.hadoop.fs.Path(where, f"_writing-{uuid.uuid4().hex}")
    system.mkdirs(hidden)
    target = _local(hidden.toString())

    def write(batches):
        name = f"part-{uuid.uuid4().hex}.bin"
        system, base = fs.FileSystem.from_uri(target)
        with system.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                records = np.zeros(batch.num_rows, dtype=dtype)
                for n, column in zip(names, batch.columns, strict=True):
                    if column.null_count:
                        raise ValueError("NULL has no place in a fixed-width record")
                    records[n] = [x.encode() for x in column.to_pylist()] if dtype[n].kind == "S" else column.to_numpy(zero_copy_only=False)
                out.write(records.tobytes())
        yield pa.record_batch([pa.array([name])], ["name"])

    for r in df.toDF(*names).mapInArrow(write, "name string").collect():  # one name a partition
        system.rename(jvm.org.apache.hadoop.fs.Path(hidden, r.name), jvm.org.apache.hadoop.fs.Path(where, r.name))
    system.delete(hidden, True)
