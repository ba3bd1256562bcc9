"""Tiles: one row per printed tile of a layer.

Columns: batch_id, print_id, tile_id, layer, height, width, temperature (an
array of ints, row by row). ``packed`` carries the same pixels as two
little-endian bytes each, which shuffles and state hold in a sixth of the space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["print_id", "tile_id"]
SIDE = 8
TILES_PER_LAYER = 16
#: All test vectors are tiles of print 0; a computed number, unlike a literal, stays a key that exchanges can share.
TILES_PER_PRINT = 1 << 40


def tiles_from_embeddings(vectors: DataFrame) -> DataFrame:
    """Read each 64-component vector as an 8 by 8 tile; sixteen tiles make a layer."""
    t = F.transform("embedding", lambda e: F.least(F.lit(65535), F.greatest(F.lit(0), F.floor(F.lit(32768.0) + e.cast("double") * 200000.0).cast("int"))))
    return vectors.select(
        F.col("vec_id").alias("batch_id"),
        F.concat(F.lit("P"), F.expr(f"vec_id div {TILES_PER_PRINT}").cast("string")).alias("print_id"),
        (F.col("vec_id") % TILES_PER_LAYER).alias("tile_id"),
        F.expr(f"vec_id div {TILES_PER_LAYER}").alias("layer"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        t.alias("temperature"),
    )


def read_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def pixels(tiles: DataFrame) -> DataFrame:
    """One row per pixel: the tile's columns with y, x and t."""
    rows = tiles.select("batch_id", *KEYS, "layer", "width", F.posexplode("temperature").alias("i", "t"))
    return rows.select("batch_id", *KEYS, "layer", F.expr("i div width").cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "t")


def matrix(tiles: DataFrame) -> DataFrame:
    """The temperatures as rows of a matrix, ``temperature[y][x]``."""
    ys = F.sequence(F.lit(0), F.col("height") - 1)
    return tiles.withColumn("temperature", F.transform(ys, lambda y: F.slice("temperature", y * F.col("width") + 1, F.col("width"))))


def packed(tiles: DataFrame) -> DataFrame:
    """The temperatures as ``pixels``, unsigned 16-bit little-endian bytes."""
    kept = [c for c in tiles.columns if c != "temperature"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column("temperature")
            flat, cuts = arrays.flatten().to_numpy().astype("<u2"), arrays.value_lengths().to_numpy().cumsum()[:-1]
            data = [a.tobytes() for a in np.split(flat, cuts)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(data, pa.binary())], [*kept, "pixels"])

    types = dict(tiles.dtypes)
    return tiles.mapInArrow(pack, ", ".join(f"{c} {types[c]}" for c in kept) + ", pixels binary")


def cube(pixels: list[bytes], height: int, width: int) -> np.ndarray:
    """Tiles of equal size as an array of (tile, row, column)."""
    return np.frombuffer(b"".join(pixels), "<u2").reshape(len(pixels), height, width)
