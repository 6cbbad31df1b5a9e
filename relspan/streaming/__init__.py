"""What pipelines can do on streams.

where, select, joins with static tables, and groups with aggregates that need no order work on a streaming DataFrame as
they do on a static one. Operators that need the order of all rows raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """The rows with their event-time windows (columns _start and _end), and a watermark that bounds the state."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, late).withColumn("_window", w).withColumns({"_start": F.col("_window.start"), "_end": F.col("_window.end")})
