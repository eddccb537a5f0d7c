"""Incremental block append: each micro-batch becomes further blocks of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slabscan.sources.blocks import append_blocks
from slabscan.types import BLOCK_CAPACITY


def append_stream(stream: DataFrame, path: str, checkpoint: str, capacity: int = BLOCK_CAPACITY):
    """Append a stream's rows to the block files at ``path`` until its input ends."""

    def one(batch: DataFrame, epoch: int) -> None:
        append_blocks(batch, f"{path}/epoch={epoch}", capacity=capacity, mode="overwrite")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
