"""Streams beside the reference's batch work: regions of speech as sessions, and an index refreshed as files land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def activity_sessions(events: DataFrame, *, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(key, begin, finish, n): stretches of events of one key without a longer pause; works on a stream and on a table.

    Sessions are of points in time: unlike regions of speech, an event has no length here. On a stream, events that come
    more than ``late`` behind the latest are left out; without it none are, and all sessions stay open.
    """
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming and late else events
    by = rows.groupBy(key, F.session_window(at, gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def refresh_on_landing(landed: DataFrame, refresh, checkpoint: str) -> StreamingQuery:
    """Run ``refresh(batch, batch_id)`` for every batch of newly landed transcripts until none is left."""
    return landed.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions_so_far(events: DataFrame, path: str, checkpoint: str, **more) -> StreamingQuery:
    """Keep ``path`` at the sessions of all events that have arrived on a stream, whatever batches they came in, until none is left."""
    kept = activity_sessions(events, late=None, **more).writeStream.outputMode("complete")
    write = kept.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
