"""Row expiry: a column of epoch seconds, 0 or NULL for never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import EXPIRES


def alive(column: str = EXPIRES, now: int | Column | None = None) -> Column:
    """Not expired at `now` (epoch seconds; the query's start if not given). A row that expires at `now` is gone."""
    now = F.unix_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    expires = F.coalesce(F.col(column), F.lit(0))
    return (expires == 0) | (expires > now)


def live_rows(df: DataFrame, column: str = EXPIRES, now: int | Column | None = None) -> DataFrame:
    return df.where(alive(column, now))


def with_lifetime(df: DataFrame, start: str, seconds: int, column: str = EXPIRES) -> DataFrame:
    """Adds the expiry of rows that live for a while from a timestamp on; none where that is NULL.

    Part of a second counts as a whole one, so a row is alive at each second that its lifetime reaches beyond. As 0 means never, a lifetime that ends at 0 ends at -1.
    """
    at = F.col(start).cast("timestamp")
    ends = F.unix_seconds(at) + F.when(F.pmod(F.unix_micros(at), F.lit(1_000_000)) > 0, 1).otherwise(0) + F.lit(seconds)
    return df.withColumn(column, F.when(ends == 0, -1).otherwise(ends))
