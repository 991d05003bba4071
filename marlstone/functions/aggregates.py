"""The five aggregates, with SQL's rules for NULL and for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def count_rows() -> Column:
    return F.count(F.lit(1))


def count(column: str) -> Column:
    return F.count(column)


def total(column: str) -> Column:
    return F.sum(column)


def mean(column: str) -> Column:
    return F.avg(column)


def least(column: str) -> Column:
    return F.min(column)


def most(column: str) -> Column:
    return F.max(column)


def exact_total(column: str, kind: str = MONEY) -> Column:
    """The sum of a double column with few decimals, exact and so the same in any task order."""
    return F.sum(F.col(column).cast(kind)).cast("double")


def exact_mean(column: str, kind: str = MONEY) -> Column:
    return exact_total(column, kind) / F.count(column)
