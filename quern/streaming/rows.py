"""Operators on streams.

Every operator that works row by row (boxes, sizes, images, audio, text, CTC on arrays, maps) is stateless and takes a streaming
DataFrame as it is. Operators that need all rows of a group run per micro-batch, where a batch holds whole groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that applies a grouped operator to each micro-batch and hands the result to the sink, which gets the
    batch's number so that it can write each batch once."""

    def step(batch: DataFrame, number: int) -> None:
        sink(operator(batch), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
