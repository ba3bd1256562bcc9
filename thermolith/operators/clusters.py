"""Density clusters of a tile's outliers, and their centroids.

A point is a core if at least ``min_points`` points, itself included, lie
within ``eps``. Clusters are numbered by their first core in the order of the
outliers; a border point goes to the lowest number among the cores it can
reach; the rest is noise, -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EPS, MIN_POINTS
from ..functions.predicates import is_clustered

_NEAR = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if abs(dy) + abs(dx) < 4]


def density_labels(y: np.ndarray, x: np.ndarray, eps: float = EPS, min_points: int = MIN_POINTS) -> np.ndarray:
    """Labels of points in their order.

    Points are dealt to square cells whose diagonal is eps: points of one cell
    are all within reach, so its cores are one cluster, and clusters join where
    cores of two near cells reach each other. Work follows the points of near
    cells, and no distance matrix of all points exists.
    """
    n = len(y)
    labels = np.full(n, -1, np.int64)
    if not n:
        return labels
    at = np.stack([y, x], axis=1).astype(np.float64)
    cell = np.floor(at / (eps / np.sqrt(2.0))).astype(np.int64)
    order = np.lexsort((np.arange(n), cell[:, 1], cell[:, 0]))
    cuts = np.flatnonzero((np.diff(cell[order], axis=0) != 0).any(axis=1)) + 1
    members = np.split(order, cuts)
    number = {tuple(cell[m[0]]): i for i, m in enumerate(members)}
    near = [[j for dy, dx in _NEAR if (j := number.get((c[0] + dy, c[1] + dx))) is not None] for c in (cell[m[0]] for m in members)]

    def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((at[a, None] - at[None, b]) ** 2).sum(axis=2) <= eps * eps

    core = np.zeros(n, bool)
    for m, others in zip(members, near, strict=True):
        core[m] = len(m) >= min_points or sum(reach(m, members[j]).sum(axis=1) for j in others) >= min_points
    cores = [m[core[m]] for m in members]
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, others in enumerate(near):
        for j in others:
            if j > i and len(cores[i]) and len(cores[j]) and find(i) != find(j) and reach(cores[i], cores[j]).any():
                root[find(j)] = find(i)
    first: dict[int, int] = {}
    for i, c in enumerate(cores):
        if len(c):
            first[find(i)] = min(first.get(find(i), n), int(c.min()))
    ids = {r: k for k, (_, r) in enumerate(sorted((f, r) for r, f in first.items()))}
    for i, (m, others) in enumerate(zip(members, near, strict=True)):
        if len(cores[i]):
            labels[cores[i]] = ids[find(i)]
        border = m[~core[m]]
        for j in others if len(border) else ():
            if len(cores[j]):
                hit = border[reach(border, cores[j]).any(axis=1)]
                k = ids[find(j)]
                labels[hit] = np.where((labels[hit] < 0) | (labels[hit] > k), k, labels[hit])
    return labels


def label_outliers(tiles: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """``tiles`` with ``labels``, one for each of the sorted ``outliers`` of a row."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("outliers")
            points, cuts = lists.flatten(), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            y, x = (points.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
            found = [density_labels(y[i:j], x[i:j], eps, min_points) for i, j in zip(cuts, cuts[1:], strict=False)]
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield batch.append_column("labels", pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)))

    schema = ", ".join(f"{c} {t}" for c, t in tiles.dtypes) + ", labels array<int>"
    return tiles.mapInArrow(label, schema)


def labelled_points(labelled: DataFrame) -> DataFrame:
    """batch_id, y, x, label of every outlier."""
    rows = labelled.select("batch_id", F.explode(F.arrays_zip("outliers", "labels")).alias("p"))
    return rows.select("batch_id", F.col("p.outliers.y").alias("y"), F.col("p.outliers.x").alias("x"), F.col("p.labels").alias("label"))


def centroids(points: DataFrame) -> DataFrame:
    """batch_id, label, x (mean row), y (mean column), count of every cluster; sums are whole and divided once."""
    sums = points.where(is_clustered(F.col("label"))).groupBy("batch_id", "label").agg(F.sum("y").alias("sy"), F.sum("x").alias("sx"), F.count("*").alias("count"))
    return sums.select("batch_id", "label", (F.col("sy") / F.col("count")).alias("x"), (F.col("sx") / F.col("count")).alias("y"), F.col("count").cast("int").alias("count"))


def clusters_of(outliers: Column, labels: Column) -> Column:
    """The clusters of a row as an array in order of label; empty where there are no outliers."""
    pairs = F.arrays_zip(outliers.alias("o"), labels.alias("l"))
    names = F.sequence(F.lit(0), F.greatest(F.coalesce(F.array_max(labels), F.lit(0)), F.lit(0)))

    def cluster(k: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["l"] == k), lambda p: p["o"])
        n = F.size(own)

        def mean(c: str) -> Column:
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a + p[c]) / n

        return F.struct(mean("y").alias("x"), mean("x").alias("y"), n.alias("count"))

    empty = F.array().cast("array<struct<x:double,y:double,count:int>>")
    return F.when(F.coalesce(F.array_max(labels), F.lit(-1)) < 0, empty).otherwise(F.transform(names, cluster))
