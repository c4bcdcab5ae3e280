"""Score a stream of documents with any batch model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Apply ``score`` to each micro-batch and write it as Parquet below ``sink``.

    Scoring keeps no state between documents, so micro-batches are independent. Each one
    overwrites its own ``batch=`` folder, so a replay after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
