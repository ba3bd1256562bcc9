"""Topics: message streams by name, on Kafka where its connector is installed, or on folders of files.

A topic folder holds Parquet files with a binary ``value`` column, so tests and
single machines need no broker; both forms give a DataFrame with ``value``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Names of the topics.
BATCHES, BENCH, RESULTS = "gc-batches", "gc-bench", ("query1-results", "query2-results", "query3-results")


def query_of(topic: str) -> str | None:
    """The query whose results a topic holds, by what its name contains."""
    return next((q.removesuffix("-results") for q in RESULTS if q.removesuffix("-results") in topic), None)


def query_of_column(topic: Column) -> Column:
    """The same for a column of topic names."""
    names = [q.removesuffix("-results") for q in RESULTS]
    return F.coalesce(*(F.when(topic.contains(q), q) for q in names))


def first_messages(messages: DataFrame, limit: int | None) -> DataFrame:
    """So many of the messages at hand, or all."""
    return messages if limit is None else messages.limit(limit)


@dataclass(frozen=True)
class Topics:
    """``servers`` names Kafka brokers; without them topics are folders below ``folder``."""

    folder: str | None = None
    servers: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def _kafka(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.servers or "", **self.options}

    def read_stream(self, spark: SparkSession, topic: str) -> DataFrame:
        """All messages from the earliest on; a new checkpoint reads everything again."""
        if self.servers:
            return spark.readStream.format("kafka").options(**self._kafka(), subscribe=topic, startingOffsets="earliest").load().select("value")
        return spark.readStream.schema("value binary").parquet(f"{self.folder}/{topic}")

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        if self.servers:
            return spark.read.format("kafka").options(**self._kafka(), subscribe=topic, startingOffsets="earliest").load()
        return spark.read.schema("value binary").option("recursiveFileLookup", "true").parquet(f"{self.folder}/{topic}")

    def write(self, messages: DataFrame, topic: str, batch: str | None = None) -> None:
        """Append messages (column value); in a folder, a batch that is written again replaces itself."""
        rows = messages.select(F.col("value").cast("binary").alias("value"))
        if self.servers:
            rows.write.format("kafka").options(**self._kafka(), topic=topic).save()
        elif batch is not None:
            rows.write.mode("overwrite").parquet(f"{self.folder}/{topic}/{batch}")
        else:
            rows.write.mode("append").parquet(f"{self.folder}/{topic}")

    def write_stream(self, messages: DataFrame, topic: str, checkpoint: str, once: bool = True) -> StreamingQuery:
        """With a checkpoint, a folder holds each message once and Kafka at least once."""
        rows = messages.select(F.col("value").cast("binary").alias("value"))
        out = rows.writeStream.option("checkpointLocation", checkpoint)
        out = out.format("kafka").options(**self._kafka(), topic=topic) if self.servers else out.format("parquet").option("path", f"{self.folder}/{topic}")
        return (out.trigger(availableNow=True) if once else out).start()


def latest_bench_id(messages: DataFrame) -> DataFrame:
    """The last message of the last partition that has any, from Kafka rows (partition, offset, value)."""
    last = messages.groupBy("partition").agg(F.max_by("value", "offset").alias("value"))
    return last.agg(F.max_by("value", "partition").cast("string").alias("bench_id"))
