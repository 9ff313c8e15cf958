"""Streams into tables: each micro-batch is one snapshot, written once even if it is tried again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import REJECT, Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, query: str, policy: str = REJECT, **trigger):
    """Start a query that appends every micro-batch; ``query`` names it across restarts."""

    def write(batch: DataFrame, epoch: int) -> None:
        table.refresh()
        done = table.snapshots().where((F.col("summary")["stream-query"] == query) & (F.col("summary")["stream-epoch"].cast("bigint") >= epoch))
        if done.limit(1).count():
            return  # this batch was committed before its progress was
        from ..types import Schema

        table.evolve(Schema.of(batch.schema), policy)
        files = table.write_files(batch)
        if files.limit(1).count():
            table.transaction().append(files).commit(summary={"stream-query": query, "stream-epoch": str(epoch)})

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
