"""Equi-joins of two tables.

Which side is broadcast, if any, is left to Spark's size estimates and to its run-time plan, which also splits skewed keys;
no side is ever broadcast by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", on: Column | None = None) -> DataFrame:
    """Rows whose keys are equal (NULL equals nothing); columns of the left side, then of the right one.

    `on` is a further condition on matches; a condition on the result is a filter behind the join.
    """
    if how not in HOW:
        raise ValueError(f"unknown join: {how}")
    condition = left[left_key] == right[right_key]
    return left.join(right, condition if on is None else condition & on, how)


def inner(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: Column | None = None) -> DataFrame:
    return equi_join(left, right, left_key, right_key, "inner", on)


def left_outer(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: Column | None = None) -> DataFrame:
    return equi_join(left, right, left_key, right_key, "left", on)


def qualified(df: DataFrame, name: str) -> DataFrame:
    """Columns renamed to TABLE.COLUMN, as SELECT * of a join shows them."""
    return df.toDF(*[f"{name}.{c}" for c in df.columns])
