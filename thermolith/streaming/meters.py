"""Meters that elements drive: throughput since the last reset, per key, as keyed state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESET_MS = 1000


def fold(times: Iterable[int], began: int | None, count: int) -> tuple[list[tuple[int, float]], int | None, int]:
    """Readings (time, elements a second) that elements at these milliseconds give, and the meter after them.

    An element that comes a second or more after the last reset gives a reading
    and resets the meter; seconds are not aligned to a clock.
    """
    readings = []
    for t in times:
        if began is None:
            began = t
        count += 1
        if t - began >= RESET_MS:
            readings.append((t, count / ((t - began) / 1000)))
            began, count = t, 0
    return readings, began, count


def _metered(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    began, count = state.get if state.exists else (None, 0)
    times = pd.concat(list(frames))["ms"].sort_values().tolist()
    readings, began, count = fold(times, began, count)
    state.update((began, count))
    yield pd.DataFrame([(str(key[0]), *r) for r in readings], columns=["key", "ms", "per_second"])


def stream_throughput(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """key, ms and elements per second at each reset of the key's meter."""
    timed = rows.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    schema, state = "key string, ms bigint, per_second double", "began bigint, count bigint"
    return timed.groupBy("key").applyInPandasWithState(_metered, schema, state, "append", GroupStateTimeout.NoTimeout)


def throughput_windows(rows: DataFrame, ts: str) -> DataFrame:
    """Elements in each second of event time, for streams and tables."""
    return rows.groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("elements")).select(F.col("w.start").alias("second"), "elements")
