"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are cut into pieces of a sequence's length and a rest. A full piece is a sequence by itself. The documents' rests go to randomised groups (by a
hash) of a bounded expected size, and each group is packed by itself: in order of decreasing length, a rest goes to the first bin with
room, which a tournament tree over the capacities finds in log time. Pieces are written once, before they are grouped; only their lengths are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import encoder

LENGTH = 2048
GROUP = 4096  # documents with a rest in a group, about
EOS = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Bins:
    """Capacities of bins 0 .. n - 1 under a tournament tree of maxima; all of them start empty."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """Puts a piece into the first bin with room for it; returns the bin and what room it had."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        room = tree[node]
        tree[node] = room - length
        leaf = node - self.size
        node >>= 1
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node >>= 1
        return leaf, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; no length exceeds the capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = Bins(len(lengths), capacity)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        bins[i], room = tree.put(n)
        at[i] = capacity - room
    return bins, at


def pieces(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and the end id, cut every `length`; with keep_ids also the ids themselves. Null texts have the end id alone."""

    def run(batches):
        enc, end = encoder(), np.array([EOS], "<u4").tobytes()
        for batch in batches:
            ids_of = enc.encode(batch.column(1).to_pylist())
            doc, start, size, crc, total, ids = [], [], [], [], [], []
            for d, raw in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                raw += end
                for a in range(0, len(raw), 4 * length):
                    part = raw[a : a + 4 * length]
                    doc.append(d)
                    start.append(a // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(raw) // 4)
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids, PIECE_NAMES + ["ids"] * keep_ids)

    return df.select(df[id_column].cast("long").alias("doc_id"), df[text].cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pack(cut: DataFrame, *, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces, which are read more than once.

    Sequences of packed rests have the group's number times 2**32 plus the bin's; those of full pieces are numbered downwards from -1. A rest's group is a hash of
    its row and of its number among equal rows, so neither rows that are repeated nor rows without an id swell a group.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)  # the same bins in every run
        bins, at = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=rows["_group"].to_numpy() * (1 << 32) + bins, offset=at).drop(columns="_group")

    names = PIECE_NAMES + ["ids"] * ("ids" in cut.columns)
    full = cut.where(F.col("length") == length).withColumns({"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    equal = rest.groupBy(*names).agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    number = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "k"), F.lit(groups))
    packed = equal.withColumn("_group", number).select(*names, "_group").groupBy("_group").applyInPandas(fill, PIECES + ", ids array<int>" * ("ids" in cut.columns) + ", sequence_id long, offset long")
    return packed.union(full.select(*packed.columns))


def pack_documents(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Packs all documents: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset for each piece.

    Sequences that are not full are padded to `length`, except those at a power of two. Null ids stay null; null texts have the end id alone; other columns are left out.
    """
    return pack(checkpointed(pieces(df, id_column=id_column, text=text, length=length, keep_ids=keep_ids)), length=length, group=group)
