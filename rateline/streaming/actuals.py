"""Actuals as a stream: totals by window with late rows dropped, kept beside the batch tables.

The batch engine needs no stream; this feeds its learning loop as rows arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Sums by window and key; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def write_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows, appended once each; the query goes on from its checkpoint after a failure."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
