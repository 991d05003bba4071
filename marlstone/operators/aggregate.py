"""Global and grouped aggregates, and HAVING."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def aggregate(df: DataFrame, **outputs: Column) -> DataFrame:
    """One row, on empty input too; partial results are made where the rows are."""
    return df.agg(*[c.alias(name) for name, c in outputs.items()])


def group(df: DataFrame, keys: Sequence[str], having: Column | None = None, **outputs: Column) -> DataFrame:
    """A row for each key (NULL is one), with the named aggregates; `having` may use keys and outputs."""
    out = df.groupBy(*keys).agg(*[c.alias(name) for name, c in outputs.items()]) if outputs else df.select(*keys).distinct()
    return out if having is None else out.where(having)
