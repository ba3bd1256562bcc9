"""Statistics of runs, running meters and look-ups over events."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import duration_ms

RESERVOIR = 100


def run_statistics(runs: DataFrame, group: str, measures: list[str], digits: int = 6) -> DataFrame:
    """Mean, sample deviation, largest and smallest of each measure and group, rounded."""
    kinds = {"mean": F.avg, "stdev": F.stddev_samp, "max": F.max, "min": F.min}
    return runs.groupBy(group).agg(F.count("*").alias("runs"), *(F.round(f(m), digits).alias(f"{m}_{k}") for m in measures for k, f in kinds.items()))


def parsed_run_log(log: DataFrame) -> DataFrame:
    """Run records with their latencies as milliseconds."""
    wanted = [c for c in log.columns if c.startswith("latency_")]
    return log.withColumns({c: duration_ms(F.col(c)) for c in wanted})


def average_by(rows: DataFrame, group: str, measure: str) -> DataFrame:
    """One average per group, as a dashboard panel shows it."""
    return rows.groupBy(group).agg(F.avg(measure).alias(f"avg_{measure}"))


def running_count(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Elements of the key so far, in order of arrival."""
    return rows.withColumn("elements", F.count("*").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


class LastSamples:
    """The last ``size`` samples, also in order of value; nulls take a place but don't count, and NaN is the largest."""

    def __init__(self, size: int):
        self._arrived: deque[float | None] = deque(maxlen=size)
        self._ordered: list[float] = []
        self._nans = 0

    def add(self, value: float | None) -> float | None:
        """Take a sample and give the median of those held; of an even number, the mean of the middle two."""
        if len(self._arrived) == self._arrived.maxlen and (old := self._arrived[0]) is not None:
            if old != old:
                self._nans -= 1
            else:
                del self._ordered[bisect_left(self._ordered, old)]
        self._arrived.append(value)
        if value is not None:
            if value != value:
                self._nans += 1
            else:
                insort(self._ordered, value)
        n = len(self._ordered) + self._nans
        return (self._at((n - 1) // 2) + self._at(n // 2)) / 2 if n else None

    def _at(self, i: int) -> float:
        return self._ordered[i] if i < len(self._ordered) else math.nan


def sliding_median(rows: DataFrame, measure: str, keys: list[str], order: list[str], size: int = RESERVOIR) -> DataFrame:
    """Median of the last ``size`` samples of the key, in a sorted window that each sample enters and leaves once."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, window = None, LastSamples(size)
        for batch in batches:
            medians, at = [], batch.schema.get_field_index("median")
            key_of = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)
            for key, value in zip(key_of, batch.column(at).to_pylist(), strict=True):
                if key != own:
                    own, window = key, LastSamples(size)
                medians.append(window.add(value))
            yield batch.set_column(at, "median", pa.array(medians, pa.float64()))

    sorted_rows = rows.withColumn("median", F.col(measure).cast("double")).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(fold, sorted_rows.schema)


def throughput_by_second(rows: DataFrame, ts: str) -> DataFrame:
    """Elements in each second of event time."""
    return rows.groupBy(F.date_trunc("second", F.col(ts)).alias("second")).agg(F.count("*").alias("elements"))


def stamped(rows: DataFrame, name: str) -> DataFrame:
    """Rows with the time at which their query, or their micro-batch, began."""
    return rows.withColumn(name, F.current_timestamp())


def latency_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, with or without a zone."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """The value of the key's last row in order; one partial result per task and key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order, with all its columns; the limit runs before the exchange too."""
    name = "rank"
    while name in (c.lower() for c in rows.columns):
        name = "_" + name
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, rank).where(F.col(name) == 1).drop(name)
