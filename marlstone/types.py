"""Logical column types, and table schemas as Spark schemas with metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Row expiry in epoch seconds, kept beside the declared columns; 0 is never.
EXPIRES = "_expires_at"

SPARK_TYPES: dict[str, T.DataType] = {
    "INT": T.LongType(),
    "DECIMAL": T.DecimalType(28, 10),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "DATETIME": T.TimestampType(),
}


@dataclass(frozen=True)
class Column:
    """A declared column; `length` is that of VARCHAR(n), which is recorded and not enforced."""

    name: str
    type: str
    primary_key: bool = False
    not_null: bool = False
    length: int | None = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]


@dataclass(frozen=True)
class Schema:
    """A table's name and columns. At most one column is the primary key."""

    name: str
    columns: tuple[Column, ...] = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> Column | None:
        return next((c for c in self.columns if c.primary_key), None)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name.upper()), None)

    def spark(self) -> T.StructType:
        """The stored columns: the declared ones, and the expiry."""
        fields = [
            T.StructField(c.name, c.spark_type, True, {"type": c.type, "primary_key": c.primary_key, "not_null": c.not_null, "length": c.length or 0})
            for c in self.columns
        ]
        return T.StructType([*fields, T.StructField(EXPIRES, T.LongType(), True)])

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [[c.name, c.type, c.primary_key, c.not_null, c.length] for c in self.columns]}

    @classmethod
    def from_json(cls, data: dict) -> Schema:
        return cls(data["name"], tuple(Column(*c) for c in data["columns"]))


def describe(columns: Sequence[Column]) -> list[tuple[str, str, str, str]]:
    """Rows of DESCRIBE: Field, Type, Key, Null."""
    return [(c.name, c.type, "PRI" if c.primary_key else "-", "NO" if c.not_null else "YES") for c in columns]
