"""The three chained queries over tiles: saturation, outliers, clusters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..constants import EPS, MIN_POINTS
from ..functions import formats
from ..operators.clusters import clusters_of, label_outliers
from ..operators.saturation import with_saturation
from ..operators.stencil import outliers
from ..sources.topics import RESULTS, Topics
from ..streaming.windows import stream_outliers

QUERIES = ("q1", "q2", "q3")


def clusters(found: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """Outlier rows with ``clusters``, centroids and sizes in order of label."""
    labelled = label_outliers(found, eps, min_points)
    return labelled.withColumn("clusters", clusters_of(F.col("outliers"), F.col("labels"))).drop("labels")


def q1_lines(tiles: DataFrame) -> DataFrame:
    return tiles.select(formats.saturation_line(F.col("batch_id"), F.col("print_id"), F.col("tile_id"), F.col("saturated")).alias("value"))


def q2_lines(found: DataFrame) -> DataFrame:
    return found.select(formats.outlier_line(F.col("batch_id"), F.col("print_id"), F.col("tile_id"), F.col("outliers")).alias("value"))


def q3_lines(found: DataFrame) -> DataFrame:
    return found.select(formats.cluster_line(F.col("batch_id"), F.col("print_id"), F.col("tile_id"), F.col("saturated"), F.col("clusters")).alias("value"))


def run_batch(packed: DataFrame, topics: Topics, queries: tuple[str, ...] = QUERIES) -> None:
    """All results of a table of packed tiles, as lines of the result topics. The stencil runs once for q2 and q3."""
    tiles = with_saturation(packed)
    if "q1" in queries:
        topics.write(q1_lines(tiles), RESULTS[0])
    if "q2" in queries or "q3" in queries:
        found = storage.saved(outliers(tiles), "outliers")
        if "q2" in queries:
            topics.write(q2_lines(found), RESULTS[1])
        if "q3" in queries:
            topics.write(q3_lines(clusters(found)), RESULTS[2])


def run_stream(packed: DataFrame, topics: Topics, checkpoint: str, queries: tuple[str, ...] = QUERIES, once: bool = True):
    """The same on a stream: q1 has no exchange and its own query; q2 and q3 share one stateful exchange and one pass.

    A micro-batch that is written again after a failure replaces what it wrote
    to a folder; to Kafka it writes once more, and ``first_wins`` on the batch
    id removes what repeats. A batch is told by the checkpoint and its number.
    """
    tiles, running = with_saturation(packed), []
    run = re.sub(r"\W+", "-", checkpoint).strip("-")
    if "q1" in queries:
        running.append(topics.write_stream(q1_lines(tiles), RESULTS[0], f"{checkpoint}/q1", once))
    if "q2" in queries or "q3" in queries:

        def publish(found: DataFrame, batch: int) -> None:
            found = found.persist()
            try:
                if "q2" in queries:
                    topics.write(q2_lines(found), RESULTS[1], f"{run}-{batch}")
                if "q3" in queries:
                    topics.write(q3_lines(clusters(found)), RESULTS[2], f"{run}-{batch}")
            finally:
                found.unpersist()

        out = stream_outliers(tiles).writeStream.foreachBatch(publish).option("checkpointLocation", f"{checkpoint}/q23")
        running.append((out.trigger(availableNow=True) if once else out).start())
    return running

