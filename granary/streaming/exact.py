"""Exact reduction of a stream: the first row of each sequence within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reduce_stream(stream: DataFrame, sequence_col: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """stream without rows whose sequence came before, as far back as the watermark holds state."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([sequence_col])
