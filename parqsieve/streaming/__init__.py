"""The exact filter of a predicate on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parqsieve.operators.ir import Predicate
from parqsieve.operators.rows import row_filter


def filter_stream(stream: DataFrame, predicate: Predicate) -> DataFrame:
    """A streaming DataFrame with the rows that match; stateless, so it needs no watermark."""
    if not stream.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return stream.where(row_filter(predicate, stream.schema))
