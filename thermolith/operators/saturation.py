"""Saturated pixels of each tile, in three forms with one result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SATURATED
from ..functions.predicates import is_saturated
from .tiles import KEYS, pixels


def saturation_relational(tiles: DataFrame) -> DataFrame:
    counts = pixels(tiles).groupBy("batch_id", *KEYS).agg(F.count_if(is_saturated(F.col("t"))).alias("saturated"))
    return counts.select("batch_id", *KEYS, F.col("saturated").cast("int").alias("saturated"))


def saturation(tiles: DataFrame) -> DataFrame:
    """The form to use: one projection, no shuffle and no Python."""
    return tiles.withColumn("saturated", F.size(F.filter("temperature", is_saturated)))


def with_saturation(packed: DataFrame) -> DataFrame:
    """Packed tiles with ``saturated``, counted from the bytes where they stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(np.count_nonzero(np.frombuffer(p.as_buffer(), "<u2") > SATURATED)) for p in batch.column("pixels")]
            yield batch.append_column("saturated", pa.array(found, pa.int32()))

    return packed.mapInArrow(count, ", ".join(f"{c} {t}" for c, t in packed.dtypes) + ", saturated int")


def saturation_arrow(packed: DataFrame) -> DataFrame:
    return with_saturation(packed.select("batch_id", *KEYS, "pixels")).drop("pixels")
