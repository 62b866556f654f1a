"""Relation schemas: ordered, named, typed with descriptors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import FieldType, of_spark, parse_type


class Schema:
    """``Schema(name, [(field, descriptor), ...])``; invalid descriptors raise ValueError."""

    def __init__(self, name: str, fields: list[tuple[str, str]]):
        self.name = name
        self._fields = [(n, str(d)) for n, d in fields]
        self._types: dict[str, FieldType | None] = {}
        for n, d in self._fields:
            self._types[n] = None if d == "any" else parse_type(d)
            if d != "any" and self._types[n] is None:
                raise ValueError(f"invalid type {d!r} of {n}")
        if len({n.lower() for n, _ in self._fields}) != len(self._fields):
            raise ValueError("repeated field name")

    @classmethod
    def of(cls, name: str, df: DataFrame) -> Schema:
        """The schema of a DataFrame; types without a descriptor are called any."""
        return cls(name, [(f.name, str(of_spark(f.dataType) or "any")) for f in df.schema])

    def schema(self) -> list[tuple[str, str]]:
        return list(self._fields)

    @property
    def fields(self) -> list[str]:
        return [n for n, _ in self._fields]

    def type_of(self, field: str) -> FieldType | None:
        return self._types[field]

    def rename(self, name: str, names: dict[str, str]) -> Schema:
        """names must cover every field, else KeyError."""
        return Schema(name, [(names[n], d) for n, d in self._fields])

    def match(self, other: Schema) -> bool:
        """Equal names and types in order; relation names do not count."""
        return self._fields == other._fields

    def project(self, row, other: Schema) -> Row:
        values = row.asDict() if isinstance(row, Row) else dict(zip(self.fields, row, strict=True))
        unknown = [f for f in other.fields if f not in values]
        if unknown:
            raise ValueError(f"unknown fields {unknown}")
        return Row(*other.fields)(*[values[f] for f in other.fields])

    def instantiate(self, *values) -> Row:
        if len(values) != len(self._fields):
            raise ValueError(f"{len(self._fields)} values needed")
        return Row(*self.fields)(*[v if t is None else t.check(v) for v, t in zip(values, self._types.values(), strict=True)])

    def default(self) -> Row:
        return Row(*self.fields)(*[None if t is None else t.default for t in self._types.values()])

    def values_from_strings(self, texts: list[str]) -> list:
        return [x if t is None else t.parse(x) for x, t in zip(texts, self._types.values(), strict=True)]

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark if t else T.StringType(), True, {"descriptor": str(t)}) for n, t in self._types.items()])

    def conform(self, df: DataFrame) -> DataFrame:
        """df's columns by position in this schema's names and types: cut, trimmed, cast; NULL fails when it is read."""
        if len(df.columns) != len(self._fields):
            raise ValueError(f"{len(self._fields)} columns needed")
        out = []
        for old, (name, t) in zip(df.columns, self._types.items(), strict=True):
            c = F.col(f"`{old}`") if t is None else t.cast(F.col(f"`{old}`"))
            out.append(F.coalesce(c, F.raise_error(F.lit(f"NULL in {self.name}.{name}")).cast(df.schema[old].dataType if t is None else t.spark)).alias(name))
        return df.select(*out)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": self._fields})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        x = json.loads(text)
        return cls(x["name"], [tuple(f) for f in x["fields"]])

    def toString(self) -> str:  # noqa: N802 - the builder API of the engine is in camel case
        return f"{self.name}[{','.join(f'({n},{d})' for n, d in self._fields)}]"

    def __eq__(self, other) -> bool:
        return isinstance(other, Schema) and self.name == other.name and self.match(other)

    def __hash__(self):
        return hash((self.name, tuple(self._fields)))

    __repr__ = toString
