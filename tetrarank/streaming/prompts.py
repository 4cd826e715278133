"""Micro-batch scoring of a stream of prompts against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(prompts: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Apply a batch scorer (for example a hybrid query) to every micro-batch and write it under its batch id.

    Each batch owns one directory that is overwritten on a retry, so a batch that is run again after a
    failure leaves no duplicates.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = prompts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
