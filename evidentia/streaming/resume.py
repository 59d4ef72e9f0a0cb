"""Streams that write each key once and count the load of a rolling minute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.sources.tables import append_new


def append_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Every micro-batch appends the keys that the table lacks; a batch that runs again adds nothing."""
    write = lambda batch, _: append_new(batch, path, keys)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minute_load(stream: DataFrame, ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    """Requests by event type in one-minute windows; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 minute"), "event_type").agg(F.count("*").alias("requests"))
