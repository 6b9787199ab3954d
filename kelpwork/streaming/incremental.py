"""Incremental forms: only new keys are processed, progress goes to a sink of frames.

The reference data flows have no event time; windows over events are an extension of this engine.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_pages(pages: DataFrame, delay: str = "1 day", time: str = "fetched_at") -> DataFrame:
    """A stream of pages without those of a url and hash seen within ``delay``."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def windowed(events: DataFrame, size: str = "1 hour", delay: str = "2 hours", time: str = "ts") -> DataFrame:
    """Counts and means of events by window and type; late events count until the watermark passes."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def frame(kind: str, **fields: object) -> str:
    """One progress frame as server-sent events have it."""
    return f"event: {kind}\ndata: {json.dumps(fields, ensure_ascii=False)}\n\n"


def frames(rows: DataFrame, kind: str, *columns: str, name: str = "frame") -> DataFrame:
    """``rows`` with a progress frame of ``columns`` each."""
    return rows.withColumn(name, F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n")))


def run_incremental(stream: DataFrame, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, send: Callable[[str], None] = lambda f: None) -> StreamingQuery:
    """Process what is available in batches, append the result to ``target`` and send a frame a batch. A batch that is run
    again after a failure overwrites its own partition, so nothing is written twice."""

    def one(batch: DataFrame, number: int) -> None:
        send(frame("start", batch=number))
        try:
            process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        except Exception as e:
            send(frame("error", batch=number, message=str(e)[:500]))
            raise
        send(frame("progress", batch=number, rows=batch.sparkSession.read.parquet(f"{target}/batch={number}").count()))

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return query
