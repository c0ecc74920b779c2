"""Continuous ingestion: a stream of pairs appended to a stored database, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_stream(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pairs (key, ord, record) go to the Parquet folder ``path`` exactly once, as far as the input has come."""
    return pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
