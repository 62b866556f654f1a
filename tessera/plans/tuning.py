"""Tuning modes: statistics, tables in memory, parallelism, indexes, materialised views."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame

from tessera.plans.builder import Operator, Plan
from tessera.plans.statistics import analyze


class Tuning:
    def __init__(self, database):
        self.database = database
        self.plain: dict[str, DataFrame] = {}

    def compute_statistics(self, *names: str) -> list[str]:
        """Analysed catalog tables, and Spark's cost-based join order for SQL over them."""
        self.database.spark.conf.set("spark.sql.cbo.enabled", "true")
        self.database.spark.conf.set("spark.sql.cbo.joinReorder.enabled", "true")
        return [analyze(self.database, n) for n in names]

    def in_memory(self, *names: str) -> None:
        """Keep relations cached, partition by partition, spilling to disk where memory ends."""
        for n in names:
            key = n.lower()
            if key not in self.plain:
                self.plain[key] = self.database.views.get(key)
                self.database.register(key, self.database.table(n).persist())

    def on_disk(self, *names: str) -> None:
        for n in names:
            key = n.lower()
            if key in self.plain:
                self.database.table(key).unpersist()
                if (old := self.plain.pop(key)) is not None:
                    self.database.register(key, old)
                else:
                    self.database.unregister(key)

    def parallelism(self, degree: int) -> None:
        """Shuffle partitions of the queries that follow."""
        self.database.spark.conf.set("spark.sql.shuffle.partitions", str(degree))

    def bloom_filters(self, on: bool = True) -> None:
        """Let Spark filter the large side of a join by a Bloom filter of the small side's keys."""
        self.database.spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", str(on).lower())

    def index(self, name: str, *fields: str) -> int:
        return self.database.createIndex(name, list(fields))

    def key_of(self, query: str | Plan) -> str:
        """What a query's result is kept under: its exact plan, or its text and the files that it reads."""
        if isinstance(query, Plan):
            return query.getPlanKey()
        files = sorted(self.database.spark.sql(query).inputFiles())
        text = re.sub(r"\s+", " ", query.strip().rstrip(";")).lower()
        return f"{text} {hashlib.sha256(chr(10).join(files).encode()).hexdigest()}"

    def materialize(self, query: str | Plan, name: str) -> DataFrame:
        """Write the result of a query, to answer that query, and plans that contain it, from there.

        A view holds for the relations as they are; after a change it answers nothing until
        it is materialised again.
        """
        df = query.df if isinstance(query, Plan) else self.database.spark.sql(query)
        key, path = self.key_of(query), f"{self.database.folder}/view-{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.database.materialized[key] = self.database.spark.read.schema(df.schema).parquet(path)
        return self.database.materialized[key]

    def answer(self, query: str | Plan) -> DataFrame:
        """The query's rows, with every part of it that is materialised read from its view."""
        if isinstance(query, Plan):
            return self._rewritten(query.root).df
        known = self.database.materialized.get(self.key_of(query)) if self.database.materialized else None
        return self.database.spark.sql(query) if known is None else known

    def _rewritten(self, op: Operator) -> Operator:
        known = self.database.materialized.get(op.key())
        if known is not None:
            return Operator("TableScan", [], known, "materialised view")
        return op.over([self._rewritten(i) for i in op.inputs])
