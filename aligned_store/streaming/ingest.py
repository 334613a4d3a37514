"""Structured Streaming into a lake: each micro-batch is one upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..lake import FeatureLake


def stream_features(lake: FeatureLake, stream: DataFrame, checkpoint: str, owner: str = "missing_owner", overlap_mode: str = "merge", **trigger) -> StreamingQuery:
    """Add a stream's rows as dense features. Late rows are backfills; a batch that is replayed replaces itself."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            lake.add_features(batch, owner=owner, overlap_mode=overlap_mode)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
