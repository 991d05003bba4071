"""Bulk loading from, and saving to, the file formats that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A DataFrame over files; CSV and JSON need a schema, so that nothing is read just to infer one."""
    if kind not in FORMATS:
        raise EngineError(f"unknown format: {kind}")
    if kind in ("csv", "json") and schema is None:
        raise EngineError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    if kind not in FORMATS:
        raise EngineError(f"unknown format: {kind}")
    writer = df.write.format(kind).options(**options).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
