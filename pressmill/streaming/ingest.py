"""The same fold over a stream: an extension, as the batch run has no notion of time.

Arriving entries are folded into the store one micro-batch at a time. Order is that of arrival, then of the entries;
published times play no part, so nothing is ever late and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import commit, publish_waiting
from ..plans.sinks import QueueSink
from ..plans.store import SnapshotStore


def fold_batch(store: SnapshotStore, sink: QueueSink | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. A batch that is run again finds its keys stored and publishes what is still waiting."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            commit(store, batch, F.current_timestamp())
            if sink is not None:
                publish_waiting(store, sink)
        finally:
            batch.unpersist()

    return run


def start(entries: DataFrame, store: SnapshotStore, checkpoint: str, sink: QueueSink | None = None) -> StreamingQuery:
    """entries: a streaming DataFrame with the columns of normalised entries. Takes what has arrived, then stops."""
    return entries.writeStream.foreachBatch(fold_batch(store, sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
