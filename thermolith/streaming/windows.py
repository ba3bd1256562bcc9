"""The count window as keyed state: the last two tiles of each key, packed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import WINDOW_LAYERS
from ..operators.stencil import outliers_in
from ..operators.tiles import KEYS

#: Provider that keeps the state of keys in RocksDB, compressed, on the executors' disks.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_TILE = ("layer", "seq", "batch_id", "saturated", "height", "width", "pixels")
_NOTHING = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
_STATE = "layer array<bigint>, seq array<bigint>, batch_id array<bigint>, saturated array<int>, height array<int>, width array<int>, pixels array<binary>"
_OUT = "print_id string, tile_id bigint, seq bigint, batch_id bigint, layer bigint, saturated int, y array<int>, x array<int>, deviation array<double>"


def _arrivals(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: list[dict[str, Any]] = [dict(zip(_TILE, values, strict=True)) for values in zip(*state.get, strict=True)] if state.exists else []
    # Rows of one micro-batch come in any order; the source's number restores theirs.
    new = pd.concat(list(frames)).sort_values("seq", kind="stable")
    rows = []
    for values in new[list(_TILE)].itertuples(index=False, name=None):
        tile = dict(zip(_TILE, values, strict=True))
        held = [*held[1 - WINDOW_LAYERS :], tile]
        window = sorted(held, key=lambda t: (t["layer"], t["seq"]))
        last = window[-1]
        found = _NOTHING
        if len(window) == WINDOW_LAYERS:
            found = outliers_in([t["pixels"] for t in window], int(last["height"]), int(last["width"]))
        rows.append((*key, tile["seq"], last["batch_id"], last["layer"], last["saturated"], *found))
    state.update(tuple([t[c] for t in held[1 - WINDOW_LAYERS :]] for c in _TILE))
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in _OUT.split(", ")])


def stream_outliers(tiles: DataFrame, arrival: str = "batch_id") -> DataFrame:
    """Outliers of every arrival of a stream of packed tiles with ``saturated``, as the batch form gives them.

    There is no watermark and no time to live: count windows take whatever
    arrives, and keys stay.
    """
    rows = tiles.select(
        F.col("print_id"),
        F.col("tile_id").cast("bigint").alias("tile_id"),
        *(F.col(c).cast("bigint").alias(c) for c in ("layer", "batch_id")),
        F.col(arrival).cast("bigint").alias("seq"),
        "saturated",
        "height",
        "width",
        "pixels",
    )
    found = rows.groupBy(*KEYS).applyInPandasWithState(_arrivals, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    zipped = F.arrays_zip("y", "x", "deviation")
    return found.select(*KEYS, "seq", "batch_id", "layer", "saturated", zipped.cast("array<struct<y:int,x:int,deviation:double>>").alias("outliers"))
