"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: What operators keep in a worker from batch to batch, by operator; each can be cleared.
CACHES: dict[str, object] = {}
_last: list[str] = []


def forget_others(name: str) -> None:
    """Drops what other operators keep in this worker and gives free memory back: workers are reused from one to the next, and their memory would add up."""
    if _last == [name]:
        return
    _last[:] = [name]
    for other, kept in CACHES.items():
        if other != name:
            kept.clear()
    give_back()


def give_back() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bounds an Arrow batch by rows and by bytes, so that long texts don't pile up in a worker.

    A setting of the session, the same for every operator; a caller's own smaller bounds stay.
    """
    for name, most in ((ARROW_ROWS, rows), (ARROW_BYTES, size)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a local session (tests) gets a temporary one; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, as in splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def key_bits(keys: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bit set of 2**log2_bits over the keys of a long column, as uint64 words.

    Its size depends on log2_bits alone, whatever the number of keys: a bounded semi-join filter
    that lets every key of `column` pass. The bits are gathered by word, at most
    2**(log2_bits - 6) rows. Other keys pass with a chance that grows with the number of keys,
    so an exact join must follow.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - log2_bits)
    words = (
        keys.where(F.col(column).isNotNull())
        .select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray, log2_bits: int) -> np.ndarray:
    """Which hashes the bit set lets pass."""
    slot = hashes >> np.uint64(64 - log2_bits)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def marked_few(df: DataFrame, few: DataFrame, on: list[str], log2_bits: int) -> DataFrame:
    """`df` with `__may`: whether a row's key can be in `few`, by a bit set of fixed size."""
    bits = key_bits(few.select(F.xxhash64(*on).alias("h")), "h", log2_bits)
    may = F.arrow_udf(lambda h: pa.array(passes(bits, h.to_numpy().view(np.uint64), log2_bits)), "boolean")
    return df.withColumn("__may", may(F.xxhash64(*on)))


def join_few(df: DataFrame, few: DataFrame, on: list[str], log2_bits: int = 22) -> DataFrame:
    """df.join(few, on, "left") that moves few rows of `df`; `few` has one row for each key, and is read twice.

    Rows whose key can't be in `few` get nulls where they are; the others are joined. A null in a key matches nothing.
    """
    marked = marked_few(df, few, on, log2_bits)
    alone = marked.where("not __may").withColumns({f.name: F.lit(None).cast(f.dataType) for f in few.schema if f.name not in on})
    return marked.where("__may").join(few, on, "left").unionByName(alone).drop("__may")


def without_few(df: DataFrame, few: DataFrame, on: list[str], log2_bits: int = 22) -> DataFrame:
    """df.join(few, on, "left_anti") that moves few rows of `df`; `few` is read twice. A null in a key matches nothing."""
    marked = marked_few(df, few, on, log2_bits)
    return marked.where("__may").join(few, on, "left_anti").unionByName(marked.where("not __may")).drop("__may")
