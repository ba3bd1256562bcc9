"""Deviation of each pixel's close neighbours from its distant ones, over three layers.

Neighbours lie on the current layer and the two before it in the window, at
Manhattan distance up to 2 (close: 19 of them) or 3 to 4 (distant: 60).
Neighbours outside the tile read 0 and count, so both denominators are fixed.
Sums are whole numbers and divided once, so every form gives the same doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import CLOSE_RADIUS, EMPTY, FAR_RADIUS, OUTLIER, SATURATED, WINDOW_LAYERS
from ..functions.predicates import is_centre, is_outlier
from .tiles import KEYS, cube, pixels
from .windows import current, is_full, tile_windows


def _ball(radius: int) -> int:
    """Points of a three-layer half ball of a Manhattan radius."""
    return sum(2 * r * r + 2 * r + 1 for r in range(radius, max(-1, radius - WINDOW_LAYERS), -1))


CLOSE_COUNT = _ball(CLOSE_RADIUS)
FAR_COUNT = _ball(FAR_RADIUS) - CLOSE_COUNT


def guarded_mean(total: Column, count: int) -> Column:
    return (total.cast("double") / F.lit(float(count))) if count else F.lit(0.0)


def deviation(close: Column, far: Column) -> Column:
    return F.abs(close - far)


def offsets(spark: SparkSession) -> DataFrame:
    """The stencil as a table: dl layers back, dy, dx, close (or distant)."""
    side, back = [spark.range(-FAR_RADIUS, FAR_RADIUS + 1).select(F.col("id").cast("int").alias(n)) for n in ("dy", "dx")], spark.range(WINDOW_LAYERS)
    # 9 x 9 x 3 constant rows.
    table = side[0].join(side[1], F.lit(True)).join(back.select(F.col("id").cast("int").alias("dl")), F.lit(True))
    far = F.abs("dy") + F.abs("dx") + F.col("dl")
    return table.where(far <= FAR_RADIUS).select("dl", "dy", "dx", (far <= CLOSE_RADIUS).alias("close"))


def _with_rank(tiles: DataFrame) -> DataFrame:
    order = Window.partitionBy(*KEYS).orderBy("layer", "batch_id")
    return tiles.withColumn("at", F.row_number().over(order))


def means_relational(tiles: DataFrame) -> DataFrame:
    """batch_id, y, x, close_mean, far_mean of centre pixels of full windows: a join with the 79 offsets.

    For tiles that arrive in order of layer. It multiplies rows by 79 and is
    here to check the other forms.
    """
    ranked = _with_rank(tiles)
    px = pixels(ranked).join(ranked.select("batch_id", "at"), "batch_id")
    centres = px.where(is_centre(F.col("t")) & (F.col("at") >= WINDOW_LAYERS)).select("batch_id", *KEYS, "at", "y", "x")
    wanted = centres.join(F.broadcast(offsets(tiles.sparkSession)), F.lit(True)).select(
        "batch_id", *KEYS, "y", "x", "close", (F.col("at") - F.col("dl")).alias("at"), (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx")
    )
    near = px.select(*KEYS, "at", F.col("y").alias("ny"), F.col("x").alias("nx"), "t")
    joined = wanted.join(near, [*KEYS, "at", "ny", "nx"], "left")
    t = F.coalesce("t", F.lit(0)).cast("long")
    sums = joined.groupBy("batch_id", "y", "x").agg(F.sum(F.when(F.col("close"), t).otherwise(0)).alias("c"), F.sum(F.when(F.col("close"), 0).otherwise(t)).alias("f"))
    return sums.select("batch_id", "y", "x", guarded_mean(F.col("c"), CLOSE_COUNT).alias("close_mean"), guarded_mean(F.col("f"), FAR_COUNT).alias("far_mean"))


def means_windowed(tiles: DataFrame) -> DataFrame:
    """The same by sums over window frames: sums along rows, then of rows at growing distance, then of layers.

    All three windows share one exchange on the tile key. Tiles must arrive in
    order of layer and be dense, so that the row before is the neighbour.
    """
    px = pixels(_with_rank(tiles).drop("at")).repartition(*KEYS)
    row = Window.partitionBy(*KEYS, "layer", "batch_id", "y").orderBy("x")
    px = px.withColumns({f"s{r}": F.sum("t").over(row.rowsBetween(-r, r)) for r in range(FAR_RADIUS + 1)})
    column = Window.partitionBy(*KEYS, "layer", "batch_id", "x").orderBy("y")

    def diamond(radius: int) -> Column:
        total = F.col(f"s{radius}")
        for j in range(1, radius + 1):
            for step in (F.lag, F.lead):
                total = total + F.coalesce(step(f"s{radius - j}", j).over(column), F.lit(0))
        return total

    px = px.withColumns({f"d{r}": diamond(r) for r in range(FAR_RADIUS + 1)})
    layers = Window.partitionBy(*KEYS, "y", "x").orderBy("layer", "batch_id")

    def half_ball(radius: int) -> Column:
        total = F.col(f"d{radius}")
        for back in range(1, WINDOW_LAYERS):
            total = total + F.coalesce(F.lag(f"d{radius - back}", back).over(layers), F.lit(0))
        return total

    px = px.withColumns({"at": F.row_number().over(layers), "c": half_ball(CLOSE_RADIUS), "all": half_ball(FAR_RADIUS)})
    px = px.where(is_centre(F.col("t")) & (F.col("at") >= WINDOW_LAYERS))
    return px.select(
        "batch_id", *KEYS, "y", "x", guarded_mean(F.col("c"), CLOSE_COUNT).alias("close_mean"), guarded_mean(F.col("all") - F.col("c"), FAR_COUNT).alias("far_mean")
    )


def outliers_of(means: DataFrame) -> DataFrame:
    dev = deviation(F.col("close_mean"), F.col("far_mean"))
    return means.select("batch_id", "y", "x", dev.alias("deviation")).where(is_outlier(F.col("deviation")))


def window_deviations(layers: np.ndarray) -> np.ndarray:
    """Deviations of the newest layer of windows shaped (window, layer, row, column), oldest layer first."""
    n, depth, h, w = layers.shape
    wide = np.zeros((n, depth, h + 2 * FAR_RADIUS, w + 2 * FAR_RADIUS), np.int64)
    wide[:, :, FAR_RADIUS:-FAR_RADIUS, FAR_RADIUS:-FAR_RADIUS] = layers
    sums = np.concatenate([np.zeros((n, depth, h + 2 * FAR_RADIUS, 1), np.int64), wide.cumsum(axis=3)], axis=3)

    def diamond(back: int, radius: int) -> np.ndarray:
        total = np.zeros((n, h, w), np.int64)
        for dy in range(-radius, radius + 1):
            r, rows = radius - abs(dy), slice(FAR_RADIUS + dy, FAR_RADIUS + dy + h)
            own = sums[:, depth - 1 - back, rows]
            total += own[:, :, FAR_RADIUS + r + 1 : FAR_RADIUS + r + 1 + w] - own[:, :, FAR_RADIUS - r : FAR_RADIUS - r + w]
        return total

    close = sum(diamond(back, CLOSE_RADIUS - back) for back in range(WINDOW_LAYERS))
    far = sum(diamond(back, FAR_RADIUS - back) for back in range(WINDOW_LAYERS)) - close
    return np.abs(close / float(CLOSE_COUNT) - far / float(FAR_COUNT))


def outliers_in(layers: list[bytes], height: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x and deviation of a window's outliers, largest deviation first, equal ones in order of row and column."""
    window = cube(layers, height, width)
    dev, t = window_deviations(window[None])[0], window[-1]
    y, x = np.nonzero((t > EMPTY) & (t < SATURATED) & (dev > OUTLIER))
    found = dev[y, x]
    order = np.argsort(-found, kind="stable")
    return y[order], x[order], found[order]


OUTLIERS = "array<struct<y:int,x:int,deviation:double>>"


def _listed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.ListArray:
    """Outliers of tiles as an Arrow list of structs, without Python objects for points."""
    cuts = np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32)
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
    types = (pa.int32(), pa.int32(), pa.float64())
    points = pa.StructArray.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], ["y", "x", "deviation"])
    return pa.ListArray.from_arrays(pa.array(cuts), points)


def window_outliers(windows: DataFrame) -> DataFrame:
    """print_id, tile_id, seq, batch_id, layer, saturated (if carried) and all outliers of each window's current tile.

    The form to use: one Arrow batch of windows at a time. A window of fewer
    than three tiles has no outliers. Layers count by their place in the
    window, so gaps between layer numbers don't matter.
    """
    kept = ["batch_id", "layer", *(["saturated"] if "saturated" in windows.schema["window"].dataType.elementType.names else [])]
    flat = windows.select(
        *KEYS,
        "seq",
        *(current(F.col("window"))[c].alias(c) for c in kept),
        current(F.col("window"))["height"].alias("height"),
        current(F.col("window"))["width"].alias("width"),
        F.when(is_full(F.col("window")), F.col("window.pixels")).alias("pixels"),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            sides = batch.column("height").to_pylist(), batch.column("width").to_pylist()
            found = [outliers_in(layers, h, w) if layers else none for layers, h, w in zip(batch.column("pixels").to_pylist(), *sides, strict=True)]
            columns = [*KEYS, "seq", *kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), _listed(found)], [*columns, "outliers"])

    types = dict(flat.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*KEYS, "seq", *kept)) + f", outliers {OUTLIERS}"
    return flat.mapInArrow(find, schema)


def outliers(packed: DataFrame, arrival: str = "batch_id") -> DataFrame:
    """Windows of packed tiles and their outliers."""
    return window_outliers(tile_windows(packed, "pixels", arrival))
