"""Continuous ingest: each micro-batch becomes one commit of the table, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.view import visible
from ..sources import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, positions: list[str], available_now: bool = True) -> StreamingQuery:
    """Starts a query that loads micro-batches of (k, deleted, v, positions) into the store.

    A batch is one manifest version, so readers see it whole or not at all. Its id is noted in a
    file named before the load and after it with the sequence that the table then
    has: a batch that runs again after a failure is loaded only if the table hasn't moved past it. An error ends
    the query; it goes on from the checkpoint when started again.
    """
    name = "ingest.txt"

    def load(batch: DataFrame, batch_id: int) -> None:
        done, before = (int(x) for x in store.files.read(name).split()) if store.files.exists(name) else (-1, 0)
        if batch_id < done or (batch_id == done and store.manifest.last_sequence > before):
            return
        store.files.replace(name, f"{batch_id} {store.manifest.last_sequence}")
        store.load(batch.select("k", "deleted", "v", *positions), positions)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(load)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def replay(ops: DataFrame, boundary: int) -> DataFrame:
    """The live view of a log cut at a commit boundary: rows of (k, seq, deleted, v, batch_id) of whole batches only."""
    return visible(ops.filter(F.col("batch_id") <= boundary))
