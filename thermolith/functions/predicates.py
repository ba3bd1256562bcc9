"""Predicates on temperatures, deviations and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY, OUTLIER, SATURATED


def is_saturated(t: Column) -> Column:
    """Strictly above the threshold: a pixel of exactly 65000 is not saturated."""
    return t > SATURATED


def is_centre(t: Column) -> Column:
    """A pixel that may be an outlier: neither empty nor at the saturated threshold."""
    return (t > EMPTY) & (t < SATURATED)


def is_outlier(deviation: Column, threshold: float = OUTLIER) -> Column:
    return deviation > threshold


def is_clustered(label: Column) -> Column:
    """Labels of noise are negative."""
    return label >= 0


def tile_key(print_id: Column, tile_id: Column) -> Column:
    return F.concat_ws("_", print_id, tile_id.cast("string"))


def present(*columns: Column) -> Column:
    """True where no column is null."""
    found = F.lit(True)
    for c in columns:
        found = found & c.isNotNull()
    return found
