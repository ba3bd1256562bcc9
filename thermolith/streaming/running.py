"""Starting, draining and stopping streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import storage
from ..constants import IDLE_SECONDS


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the input at hand, written as Parquet below the shared folder and read again.

    With its checkpoint the file sink keeps each row once, also across a lost
    executor or a restart.
    """
    spark = stream.sparkSession
    out = storage.fresh_dir(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stop_when_idle(query: StreamingQuery, seconds: float = IDLE_SECONDS, poll: float = 0.2) -> None:
    """Stop a query once no input came for so many seconds."""
    last, seen = time.monotonic(), -1
    while query.isActive:
        progress = query.lastProgress
        batch = progress["batchId"] if progress and progress["numInputRows"] > 0 else seen
        if batch != seen:
            last, seen = time.monotonic(), batch
        if time.monotonic() - last > seconds and not query.status["isTriggerActive"]:
            query.stop()
            return
        time.sleep(poll)
