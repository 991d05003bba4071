"""WHERE conditions as Column expressions; all of them follow SQL's three-valued logic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"=": "__eq__", "!=": "__ne__", "<>": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def compare(column: str | Column, op: str, value: object) -> Column:
    """One of the six comparisons with a literal or another column."""
    column = F.col(column) if isinstance(column, str) else column
    return getattr(column, COMPARISONS[op])(value)


def between(column: str, low: object, high: object) -> Column:
    """Both ends belong to it."""
    return F.col(column).between(low, high)


def not_between(column: str, low: object, high: object) -> Column:
    return ~between(column, low, high)


def one_of(column: str, values: Sequence[object]) -> Column:
    if not values:
        raise ValueError("IN needs a value")
    return F.col(column).isin(list(values))


def none_of(column: str, values: Sequence[object]) -> Column:
    return ~one_of(column, values)


def like(column: str, pattern: str) -> Column:
    """`%` is any text, `_` any character; there is no escape character."""
    free = next(c for c in "~^@#!|$&" if c not in pattern)
    return F.like(F.col(column), F.lit(pattern), F.lit(free))


def is_null(column: str) -> Column:
    return F.col(column).isNull()


def is_not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(Column.__or__, conditions)
