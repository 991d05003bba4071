"""Scan, projection, filter, distinct, order, limit and offset.

Each function adds to the logical plan and nothing more; Catalyst prunes columns, pushes filters into the Parquet scan and turns
ORDER BY with LIMIT into a top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def project(df: DataFrame, *columns: str | tuple[str, str]) -> DataFrame:
    """Named columns, each as it is or as (name, alias); without names all of them."""
    return df.select(*[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns]) if columns else df.select("*")


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return project(df, *columns).distinct()


def order(df: DataFrame, *keys: str | tuple[str, str]) -> DataFrame:
    """By keys, ascending unless (name, "DESC"); NULLs come first ascending and last descending."""
    pairs = [(k, "ASC") if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.desc(k) if way.upper() == "DESC" else F.asc(k) for k, way in pairs])


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """n rows after `offset`; a negative n is no limit."""
    df = df.offset(offset) if offset else df
    return df.limit(n) if n >= 0 else df


def top(df: DataFrame, keys: Sequence[str | tuple[str, str]], n: int, offset: int = 0) -> DataFrame:
    return limit(order(df, *keys), n, offset)
