"""``first_events`` as a Structured Streaming job.

The stream keeps no state: each micro-batch is reduced to its own first events and added
under its batch id and the stream's checkpoint. Late events need no watermark because a minimum does not depend on order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.first_events import add_first_events


def stream_first_events(
    events: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the job; ``trigger`` goes to ``DataStreamWriter.trigger`` (default availableNow)."""

    # batch ids belong to the checkpoint: a stream begun anew with another one is another producer
    producer = f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def add(batch: DataFrame, batch_id: int) -> None:
        add_first_events(batch, path, batch_id, producer)

    return (
        events.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
