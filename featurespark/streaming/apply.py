"""Fitted transformations on a stream: the same projections, without state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from featurespark.errors import DataAccessError
from featurespark.operators.transforms import Fitted, apply_fitted


def transform_stream(stream: DataFrame, fitted: Sequence[Fitted]) -> DataFrame:
    """Apply steps fitted on a table to a stream with the same columns."""
    if not stream.isStreaming:
        raise DataAccessError("a streaming DataFrame is needed")
    return apply_fitted(stream, *fitted)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows available now as Parquet; a restart goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
