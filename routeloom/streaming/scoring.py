"""Routing of a stream of requests. A decision needs its request only, so there is no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from routeloom.learning.artifact import RoutingArtifact


def route_stream(requests: DataFrame, artifact: RoutingArtifact, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append decisions for a streaming DataFrame with a query column to Parquet files, each request once."""
    if not requests.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use RoutingArtifact.decide for a table")
    decided = artifact.decide(requests)
    writer = decided.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
