"""INSERT, UPDATE, DELETE and TRUNCATE as functions from DataFrame to DataFrame; nothing is written here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def arrange(rows: DataFrame, columns: Sequence[str], like: DataFrame) -> DataFrame:
    """Rows with a column list, in the order and types of `like`; columns that aren't listed are NULL."""
    given = dict(zip(columns, rows.columns, strict=True))
    return rows.select(*[(F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that `rows` holds twice."""
    return rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)


def duplicate_keys(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys that `rows` holds twice, or that `table` has already. The join's sides are alike, so the smaller one may be broadcast."""
    return repeated_keys(rows, key).union(table.select(key).join(rows.select(key), key).select(key))


def new_keys_only(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key the table doesn't have; of rows with the same key, one."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def update(table: DataFrame, assignments: Mapping[str, Column | object], condition: Column | None = None) -> DataFrame:
    """Assigns values, or expressions over the old row, to columns of the rows for which the condition is true."""
    unknown = [c for c in assignments if c not in table.columns]
    if unknown:
        raise EngineError(f"unknown column: {unknown[0]}")
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    out = []
    for f in table.schema:
        if f.name in assignments:
            value = assignments[f.name]
            value = value if isinstance(value, Column) else F.lit(value)
            out.append(F.when(hit, value.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return table.select(*out)


def delete(table: DataFrame, condition: Column | None = None) -> DataFrame:
    """Rows for which the condition is not true; without one, none."""
    return table.limit(0) if condition is None else table.where(~F.coalesce(condition, F.lit(False)))


def truncate(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))
