"""Appends a stream to a table; the manifest remembers the last batch, so a batch that is run again counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Session


def append_stream(session: Session, stream: DataFrame, table: str, checkpoint: str, *, name: str | None = None, once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Starts a query that appends each micro-batch in one commit. `checkpoint` is a shared folder that belongs to this stream alone.

    Its name is kept in the table's manifest; it is the checkpoint's path unless given. `once` takes all that is there and ends.
    """
    source = name or checkpoint

    def take(batch: DataFrame, number: int) -> None:
        session.catalog.append(table, batch, (source, number))

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
