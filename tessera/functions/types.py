"""Type descriptors such as ``int`` or ``char(25)`` and their Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Descriptor, Spark type, default value; sized ones need a length.  Fixed values.
PLAIN = {
    "byte": (T.ShortType(), 0),
    "short": (T.ShortType(), 0),
    "int": (T.IntegerType(), 0),
    "float": (T.FloatType(), 0.0),
    "double": (T.DoubleType(), 0.0),
}
SIZED = {"char": T.StringType(), "text": T.StringType()}
PADDING = "\0 \n"


@dataclass(frozen=True)
class FieldType:
    name: str
    size: int | None = None

    @property
    def spark(self) -> T.DataType:
        return SIZED[self.name] if self.size is not None else PLAIN[self.name][0]

    @property
    def default(self):
        return "" if self.size is not None else PLAIN[self.name][1]

    def __str__(self) -> str:
        return f"{self.name}({self.size})" if self.size is not None else self.name

    def parse(self, text: str):
        """A value from its text: numbers are read, strings padded to their size."""
        if self.size is not None:
            return text[: self.size].ljust(self.size, "\0")
        return float(text) if self.name in ("float", "double") else int(text)

    def check(self, value):
        """value if the type can hold it, else ValueError."""
        if value is None:
            raise ValueError(f"{self} holds no NULL")
        low, high = {"byte": (0, 255), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1)}.get(self.name, (None, None))
        if low is not None and not low <= value <= high:
            raise ValueError(f"{value} is out of range for {self}")
        return value[: self.size].rstrip(PADDING) if self.size is not None else value

    def cast(self, column: Column) -> Column:
        """column in this type: strings are cut to size and lose their padding, numbers out of range fail."""
        if self.size is not None:
            return F.regexp_replace(F.substring(column.cast("string"), 1, self.size), "[\\x00 \\n]+$", "")
        if self.name == "byte":
            value = column.cast("short")
            return F.when((value < 0) | (value > 255), F.raise_error(F.lit("out of range for byte"))).otherwise(value).cast("short")
        return column.cast(self.spark)


def parse_type(text: str) -> FieldType | None:
    """The type of a descriptor; None for unknown names, a missing or needless size, or trailing text."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*\))?\s*", text)
    if not m:
        return None
    name, size = m[1], m[2]
    if name in SIZED and size is not None:
        return FieldType(name, int(size))
    return FieldType(name) if name in PLAIN and size is None else None


def of_spark(kind: T.DataType) -> FieldType | None:
    """The descriptor type that a Spark column can be declared as; None where there is none."""
    if isinstance(kind, T.StringType):
        return FieldType("text", 65535)
    names = {"tinyint": "short", "smallint": "short", "int": "int", "bigint": None, "float": "float", "double": "double"}
    name = names.get(kind.simpleString())
    return FieldType(name) if name else None
