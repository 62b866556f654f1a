"""The database: a catalog of relations under one folder, with DML, indexes and statistics.

Relations are Parquet folders, one version after the other; a change writes the next version
and then moves the catalog on, so readers never see half of it.  Appends add files to the
current version.  The catalog is one JSON file beside them, written through Spark's own
file systems, and is read again when a database is opened.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expressions import column, parse
from tessera.functions.types import parse_type
from tessera.operators.joins import of_parquet, scanned
from tessera.plans.builder import Plan, Query, condition, resolver
from tessera.plans.schema import Schema

#: Rows that a relation is taken to have if Spark cannot tell its size.
UNKNOWN_ROWS = 1e6
#: Files of a relation whose footers are read to estimate its rows.
FOOTERS = 16


def rows_by_footers(df: DataFrame) -> float | None:
    """Rows of a Parquet source, also under projections and filters: those of the footers of some files, by bytes for all; no job runs.

    None for anything else.
    """
    plan = scanned(df)
    if not of_parquet(plan):
        return None
    jvm, configuration = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    files = list(df.inputFiles())
    rows = size = 0
    for uri in files[:: -(-len(files) // FOOTERS) or 1]:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri)), configuration)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        rows, size = rows + reader.getRecordCount(), size + file.getLength()
        reader.close()
    return max(1.0, rows * int(str(plan.relation().location().sizeInBytes())) / size) if size else None


class Database:
    def __init__(self, spark: SparkSession, dataDir: str | None = None):  # noqa: N803
        self.spark = spark
        self.folder = (dataDir or f"{spark.conf.get('spark.sql.warehouse.dir')}/db-{uuid.uuid4().hex[:8]}").rstrip("/")
        self.catalog: dict = {"relations": {}, "indexes": {}, "next": 1}
        self.views: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        self.materialized: dict[str, DataFrame] = {}
        self._registered: dict[str, int] = {}
        self._stats: dict[tuple, object] = {}
        from tessera.plans.optimizer import Optimizer

        self.optimizer = Optimizer(self)
        self._restore()

    # The catalog file.

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _restore(self) -> None:
        system, path = self._path("catalog.json")
        if system.exists(path):
            text = self.spark.read.text(path.toString(), wholetext=True).head()[0]
            self.catalog = json.loads(text)

    def checkpoint(self) -> None:
        """Write the catalog; every change does so."""
        system, path = self._path("catalog.json")
        out = system.create(path, True)
        out.write(bytearray(json.dumps(self.catalog).encode()))
        out.close()

    def close(self) -> None:
        self.checkpoint()

    # Relations.

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A read-only relation over any DataFrame, such as a Parquet source, or over what a function returns when it is first read."""
        self.views[name.lower()] = df
        self._registered[name.lower()] = self._registered.get(name.lower(), 0) + 1

    def unregister(self, name: str) -> None:
        """Take a registered relation away; a catalog relation of that name shows again."""
        del self.views[name.lower()]
        self._registered[name.lower()] += 1

    def state(self, name: str) -> str:
        """What the present rows of a relation are called: another text after every change."""
        key, entry = name.lower(), self.catalog["relations"].get(name.lower())
        registered = f"r{self._registered.get(key, 0)}"
        return registered if key in self.views or entry is None else f"{registered} v{entry['version']}.{entry.get('changes', 0)}"

    def relations(self) -> list[str]:
        return sorted({*self.views, *self.catalog["relations"]})

    def hasRelation(self, name: str) -> bool:  # noqa: N802
        return name.lower() in self.views or name.lower() in self.catalog["relations"]

    def relationSchema(self, name: str) -> Schema:  # noqa: N802
        entry = self.catalog["relations"].get(name.lower())
        return Schema.from_json(entry["schema"]) if entry else Schema.of(name, self.table(name))

    def createRelation(self, name: str, schema: Schema | list[tuple[str, str]], replace: bool = False) -> None:  # noqa: N802
        if self.hasRelation(name):
            if not replace:
                raise ValueError(f"relation {name} exists")
            self.removeRelation(name)
        schema = schema if isinstance(schema, Schema) else Schema(name, schema)
        self.catalog["relations"][name.lower()] = {"schema": schema.to_json(), "version": 0, "rows": 0}
        self._write(self.spark.createDataFrame([], schema.spark()), name)

    def removeRelation(self, name: str) -> None:  # noqa: N802
        if not self.hasRelation(name):
            raise ValueError(f"no relation {name}")
        if name.lower() in self.views:
            self.unregister(name)
        else:
            del self.catalog["relations"][name.lower()]
            self.catalog["indexes"] = {k: v for k, v in self.catalog["indexes"].items() if v["relation"] != name.lower()}
            system, path = self._path(name.lower())
            system.delete(path, True)
            self.checkpoint()

    def _version(self, name: str) -> str:
        return f"{self.folder}/{name.lower()}/v{self.catalog['relations'][name.lower()]['version']}"

    def table(self, name: str) -> DataFrame:
        key = name.lower()
        if key in self.views:
            if not isinstance(self.views[key], DataFrame):
                self.views[key] = self.views[key]()
            return self.views[key]
        if key not in self.catalog["relations"]:
            raise ValueError(f"no relation {name}")
        return self.spark.read.schema(self.relationSchema(name).spark()).parquet(self._version(name))

    def _write(self, df: DataFrame, name: str) -> None:
        """The next version of a relation."""
        entry = self.catalog["relations"][name.lower()]
        entry["version"] += 1
        df.write.parquet(self._version(name))
        self._changed(name)

    def _changed(self, name: str) -> None:
        for index in self.catalog["indexes"].values():
            if index["relation"] == name.lower():
                index["fresh"] = False
        entry = self.catalog["relations"][name.lower()]
        entry["changes"] = entry.get("changes", 0) + 1
        self.checkpoint()

    # DML.

    def insert(self, name: str, df: DataFrame) -> None:
        """Append rows, by position, in the relation's types; NULL and values out of range fail."""
        self.relationSchema(name).conform(df).write.mode("append").parquet(self._version(name))
        self._changed(name)

    def insertTuples(self, name: str, rows: list) -> None:  # noqa: N802
        schema = self.relationSchema(name)
        self.insert(name, self.spark.createDataFrame([tuple(schema.instantiate(*r)) for r in rows], schema.spark()))

    def insertTuple(self, name: str, row) -> None:  # noqa: N802
        self.insertTuples(name, [row])

    def deleteWhere(self, name: str, expression: str) -> None:  # noqa: N802
        """Delete the rows for which the expression is true; where it is unknown (NULL) they stay."""
        df = self.table(name)
        self._write(df.filter(~F.coalesce(condition(df, parse(expression)), F.lit(False))), name)

    def updateWhere(self, name: str, changes: dict[str, str], expression: str = "True") -> None:  # noqa: N802
        """Set fields to expressions of the old row where the expression is true."""
        df, schema = self.table(name), self.relationSchema(name)
        resolve, hit = resolver(df), condition(df, parse(expression))
        unknown = set(changes) - set(schema.fields)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        new = [F.when(hit, column(parse(changes[f]), resolve)).otherwise(F.col(f)).alias(f) if f in changes else F.col(f) for f in schema.fields]
        self._write(schema.conform(df.select(*new)), name)

    def _key_equals(self, df: DataFrame, fields: list[str], key) -> Column:
        values = list(key) if isinstance(key, (tuple, list, Row)) else [key]
        if len(values) != len(fields):
            raise ValueError(f"{len(fields)} key values needed")
        out = F.lit(True)
        for f, v in zip(fields, values, strict=True):
            out = out & (F.col(f) == F.lit(v))
        return out

    def deleteByKey(self, name: str, fields: list[str], key) -> None:  # noqa: N802
        df = self.table(name)
        self._write(df.filter(~self._key_equals(df, fields, key)), name)

    # Tuples by id: the file of the present version that holds a row, and its place there.

    def withTupleIds(self, name: str) -> DataFrame:  # noqa: N802
        """The relation with ``tuple_id``; ids hold until rows are updated or deleted, appends keep them."""
        if name.lower() not in self.catalog["relations"] or name.lower() in self.views:
            raise ValueError(f"{name} is not a catalog relation")
        where = F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string"))
        return self.table(name).select("*", where.alias("tuple_id"))

    def _tuple(self, name: str, tuple_id: str) -> tuple[DataFrame, Column]:
        file, _, place = tuple_id.rpartition(":")
        if not file or not place.isdigit():
            raise ValueError(f"not a tuple id: {tuple_id!r}")
        here = (F.col("_metadata.file_name") == file) & (F.col("_metadata.row_index") == int(place))
        if self.table(name).filter(here).isEmpty():
            raise ValueError(f"no tuple {tuple_id}")
        return self.withTupleIds(name), F.col("tuple_id") == tuple_id

    def getTuple(self, name: str, tuple_id: str) -> Row:  # noqa: N802
        """The row of an id; the file's name prunes the scan."""
        df, here = self._tuple(name, tuple_id)
        return df.filter(here).drop("tuple_id").head()

    def deleteTuple(self, name: str, tuple_id: str) -> None:  # noqa: N802
        df, here = self._tuple(name, tuple_id)
        self._write(df.filter(~here).drop("tuple_id"), name)

    def updateTuple(self, name: str, tuple_id: str, row) -> None:  # noqa: N802
        df, here = self._tuple(name, tuple_id)
        schema = self.relationSchema(name)
        new = schema.instantiate(*row)
        columns = [F.when(here, F.lit(v)).otherwise(F.col(f)).alias(f) for f, v in zip(schema.fields, new, strict=True)]
        self._write(schema.conform(df.select(*columns)), name)

    def clearTuple(self, name: str, tuple_id: str) -> None:  # noqa: N802
        """Set the row of an id to the default values of its fields."""
        self.updateTuple(name, tuple_id, self.relationSchema(name).default())

    # Indexes: a sorted copy, brought up to date when it is next read.

    def createIndex(self, name: str, fields: list[str], primary: bool = False) -> int:  # noqa: N802
        schema = self.relationSchema(name)
        unknown = [f for f in fields if f.lower() not in {x.lower() for x in schema.fields}]
        if unknown:
            raise ValueError(f"unknown fields {unknown}")
        own = [v for v in self.catalog["indexes"].values() if v["relation"] == name.lower()]
        if primary and any(v["primary"] for v in own):
            raise ValueError(f"{name} has a primary index")
        if any(v["fields"] == fields for v in own):
            raise ValueError(f"{name} has such an index")
        number = self.catalog["next"]
        self.catalog["next"] += 1
        self.catalog["indexes"][str(number)] = {"relation": name.lower(), "fields": fields, "primary": primary, "fresh": False, "build": 0}
        self.checkpoint()
        return number

    def removeIndex(self, number: int) -> None:  # noqa: N802
        if not self.hasIndexId(number):
            raise ValueError(f"no index {number}")
        del self.catalog["indexes"][str(number)]
        self.checkpoint()

    def detachIndex(self, number: int) -> dict:  # noqa: N802
        """Forget an index but keep its copy; the answer lets attachIndex take it up again."""
        if not self.hasIndexId(number):
            raise ValueError(f"no index {number}")
        index = self.catalog["indexes"].pop(str(number))
        self.checkpoint()
        return {"number": number, **index}

    def attachIndex(self, index: dict) -> int:  # noqa: N802
        """Take up a detached index; it is brought up to date when it is next read."""
        number = index["number"]
        if self.hasIndexId(number) or self.matchIndex(index["relation"], index["fields"]) is not None:
            raise ValueError("there is such an index")
        self.catalog["indexes"][str(number)] = {k: v for k, v in index.items() if k != "number"} | {"fresh": False}
        self.checkpoint()
        return number

    def hasIndexId(self, number: int) -> bool:  # noqa: N802
        return str(number) in self.catalog["indexes"]

    def indexFields(self, number: int) -> list[str]:  # noqa: N802
        return list(self.catalog["indexes"][str(number)]["fields"])

    def indexRelation(self, number: int) -> str:  # noqa: N802
        return self.catalog["indexes"][str(number)]["relation"]

    def scanIndex(self, number: int) -> DataFrame:  # noqa: N802
        """The rows of an indexed relation from the index's copy, in no order."""
        return self._indexed(number)

    def matchIndex(self, name: str, fields: list[str]) -> int | None:  # noqa: N802
        for k, v in self.catalog["indexes"].items():
            if v["relation"] == name.lower() and v["fields"] == fields:
                return int(k)
        return None

    def _indexed(self, number: int) -> DataFrame:
        if not self.hasIndexId(number):
            raise ValueError(f"no index {number}")
        index = self.catalog["indexes"][str(number)]
        path = f"{self.folder}/index-{number}/b"
        if not index["fresh"] or index.get("state") != self.state(index["relation"]):
            index["build"] += 1
            df, fields = self.table(index["relation"]), index["fields"]
            index["state"] = self.state(index["relation"])
            # Sorted ranges: each file and row group covers few keys, so readers skip the others.
            df.repartitionByRange(*fields).sortWithinPartitions(*fields).write.mode("overwrite").parquet(f"{path}{index['build']}")
            index["fresh"] = True
            self.checkpoint()
        return self.spark.read.parquet(f"{path}{index['build']}")

    def lookupByIndex(self, number: int, key) -> DataFrame:  # noqa: N802
        df = self._indexed(number)
        return df.filter(self._key_equals(df, self.indexFields(number), key))

    def lookupByKey(self, name: str, key) -> DataFrame:  # noqa: N802
        for k, v in self.catalog["indexes"].items():
            if v["relation"] == name.lower() and v["primary"]:
                return self.lookupByIndex(int(k), key)
        raise ValueError(f"{name} has no primary index")

    def scanByIndex(self, number: int) -> DataFrame:  # noqa: N802
        return self._indexed(number).orderBy(*self.indexFields(number))

    def deleteByIndex(self, number: int, key) -> None:  # noqa: N802
        index = self.catalog["indexes"][str(number)]
        self.deleteByKey(index["relation"], index["fields"], key)

    def updateByIndex(self, number: int, key, changes: dict[str, str]) -> None:  # noqa: N802
        index = self.catalog["indexes"][str(number)]
        values = list(key) if isinstance(key, (tuple, list)) else [key]
        self.updateWhere(index["relation"], changes, " and ".join(f"{f} == {v!r}" for f, v in zip(index["fields"], values, strict=True)))

    # Queries.

    def query(self) -> Query:
        return Query(self)

    def processQuery(self, plan: Plan) -> Plan:  # noqa: N802
        return plan.prepare(self)

    def optimizeQuery(self, plan: Plan) -> Plan:  # noqa: N802
        return self.optimizer.optimizeQuery(plan)

    def setOptimizer(self, optimizer_class) -> None:  # noqa: N802
        self.optimizer = optimizer_class(self)

    # Statistics.

    def _known(self, name: str, what: str, find):
        """find(), remembered for the present rows of a relation."""
        key = (name.lower(), self.state(name), what)
        if key not in self._stats:
            self._stats[key] = find()
        return self._stats[key]

    def statistics(self, name: str) -> dict:
        """rows, files and estimated bytes of a relation; counted once for each state of it."""

        def count() -> dict:
            df = self.table(name)
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return {"rows": df.count(), "files": len(df.inputFiles()), "bytes": size}

        return self._known(name, "rows", count)

    def histogram(self, name: str, field: str) -> list[tuple[float, float, int]]:
        """(low, high, rows) of the equi-width buckets of a numeric field, counted once for each state."""
        from tessera.plans.statistics import equi_width_histogram

        return self._known(name, f"histogram {field.lower()}", lambda: sorted((r.low, r.high, r.n) for r in equi_width_histogram(self.table(name), field).collect()))

    def knownHistogram(self, name: str, field: str) -> list[tuple[float, float, int]] | None:  # noqa: N802
        return self._stats.get((name.lower(), self.state(name), f"histogram {field.lower()}"))

    def estimatedRows(self, name: str) -> float:  # noqa: N802
        """Rows without running anything: the count if it is known, Spark's statistics, Parquet footers, or bytes by the width of a row."""
        known = self._stats.get((name.lower(), self.state(name), "rows"))
        if known is not None:
            return float(known["rows"])

        def guess() -> float:
            df = self.table(name)
            stats = df._jdf.queryExecution().optimizedPlan().stats()
            if stats.rowCount().isDefined():
                return float(str(stats.rowCount().get()))
            counted = rows_by_footers(df)
            if counted is not None:
                return counted
            size = int(str(stats.sizeInBytes()))
            return max(1.0, size / df._jdf.schema().defaultSize()) if size < 1 << 60 else UNKNOWN_ROWS

        return self._known(name, "guess", guess)

    def type_of(self, name: str, field: str):
        return parse_type(dict(self.relationSchema(name).schema())[field])
