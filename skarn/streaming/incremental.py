"""Streams: new documents once each, windows of activity, matches of subscriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(df: DataFrame, time_col: str, late: str | None) -> DataFrame:
    """df with a watermark; a time without zone is read in the session's zone, as watermarks ask."""
    if dict(df.dtypes)[time_col] == "timestamp_ntz":
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return df.withWatermark(time_col, late) if late else df


def once_each(stream: DataFrame, id_col: str = "doc_id", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each id within the watermark."""
    return timed(stream, time_col, late).dropDuplicatesWithinWatermark([id_col])


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, time_col: str = "ts", by: str = "event_type", late: str | None = None) -> DataFrame:
    """(start, end, key, n) of tumbling or sliding windows, of a stream or a table."""
    events = timed(events, time_col, late) if late else events
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return events.groupBy(w.alias("w"), F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "key", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", by: str = "user_id", late: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events without a gap."""
    events = timed(events, time_col, late) if late else events
    return events.groupBy(F.session_window(time_col, gap).alias("w"), F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("key", "w.start", "w.end", "n")


def matched(facts: DataFrame, subscribed: DataFrame) -> DataFrame:
    """Facts of a stream that meet a subscription (user, canon): a stream-static equi-join."""
    return facts.join(subscribed, "canon")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch transformation on what has arrived and append its rows; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
