"""Count windows: the last three tiles of a key, sliding by one, fired by every arrival.

The window is in order of arrival; its current tile is the one with the highest
layer, not the newest arrival, and of equal layers the latest arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import WINDOW_LAYERS
from .tiles import KEYS


def count_window(rows: DataFrame, content: Column, keys: list[str], arrival: list[str], size: int = WINDOW_LAYERS) -> DataFrame:
    """``rows`` with ``window``, the last ``size`` contents of the key in their own order.

    ``content`` should be a struct that begins with the layer and the arrival,
    so that sorting is by layer and stable in arrival.
    """
    last = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(1 - size, Window.currentRow)
    return rows.withColumn("window", F.array_sort(F.collect_list(content).over(last)))


def current(window: Column) -> Column:
    return F.element_at(window, -1)


def is_full(window: Column, size: int = WINDOW_LAYERS) -> Column:
    return F.size(window) >= size


def tile_windows(tiles: DataFrame, pixels_col: str, arrival: str = "batch_id") -> DataFrame:
    """One row per arrival: the window of (layer, seq, tile's columns, pixels) structs."""
    content = F.struct("layer", F.col(arrival).alias("seq"), "batch_id", *(c for c in ("saturated",) if c in tiles.columns), "height", "width", pixels_col)
    return count_window(tiles, content, KEYS, [arrival]).select(*KEYS, F.col(arrival).alias("seq"), "window")
