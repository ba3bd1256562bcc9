"""Text forms of results, and their parsers.

``%.2f`` here is the JVM's formatter, which rounds halves up: 98.125 is 98.13.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TOP

# Empty forms, column names of the written result files, and the written form of a cluster.
NO_POINT, NO_DEVIATION = "()", ""
HEADERS = {
    "query1": ["seq_id", "print_id", "tile_id", "saturated"],
    "query2": ["seq_id", "print_id", "tile_id", *(f"{p}{i}" for i in range(1, TOP + 1) for p in ("P", "dP"))],
    "query3": ["batch_id", "print_id", "tile_id", "saturated", "centroids"],
}
CLUSTER_PATTERN = r"\{'x': ([\d.]+); 'y': ([\d.]+); 'count': (\d+)\}"


def point_text(y: Column, x: Column) -> Column:
    """``(row;column)``."""
    return F.format_string("(%d;%d)", y, x)


def deviation_text(deviation: Column) -> Column:
    return F.format_string("%.2f", deviation)


def saturation_line(batch_id: Column, print_id: Column, tile_id: Column, saturated: Column) -> Column:
    return F.format_string("%d,%s,%d,%d", batch_id, print_id, tile_id, saturated)


def top_columns(outliers: Column, n: int = TOP) -> dict[str, Column]:
    """P1, dP1 and so on from a sorted array of outliers; what is missing has the empty forms."""
    out = {}
    for i in range(n):
        o = F.get(outliers, F.lit(i))
        out[f"P{i + 1}"] = F.when(o.isNull(), NO_POINT).otherwise(point_text(o["y"], o["x"]))
        out[f"dP{i + 1}"] = F.when(o.isNull(), NO_DEVIATION).otherwise(deviation_text(o["deviation"]))
    return out


def outlier_line(batch_id: Column, print_id: Column, tile_id: Column, outliers: Column) -> Column:
    return F.concat_ws(",", batch_id.cast("string"), print_id, tile_id.cast("string"), *top_columns(outliers).values())


def cluster_text(cluster: Column) -> Column:
    return F.format_string("{'x': %.2f; 'y': %.2f; 'count': %d}", cluster["x"], cluster["y"], cluster["count"])


def clusters_text(clusters: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(clusters, cluster_text), ", "), F.lit("]"))


def cluster_line(batch_id: Column, print_id: Column, tile_id: Column, saturated: Column, clusters: Column) -> Column:
    return F.concat_ws(",", saturation_line(batch_id, print_id, tile_id, saturated), clusters_text(clusters))


def line_bytes(line: Column) -> Column:
    """UTF-8 bytes of a line; none for a missing row."""
    return F.coalesce(line, F.lit("")).cast("binary")


def parse_clusters(text: Column) -> Column:
    """All clusters written in a text, as an array of x, y and count."""
    xs, ys, counts = (F.regexp_extract_all(text, F.lit(CLUSTER_PATTERN), F.lit(i)) for i in (1, 2, 3))
    zipped = F.arrays_zip(xs.alias("x"), ys.alias("y"), counts.alias("count"))
    return F.transform(zipped, lambda c: F.struct(c["x"].cast("double").alias("x"), c["y"].cast("double").alias("y"), c["count"].cast("int").alias("count")))


def trim_brackets(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^\[|\]$", "")


def fields(line: Column) -> Column:
    return F.split(F.trim(line), ",", -1)


def outlier_debug_text(outlier: Column) -> Column:
    """``(column,row):deviation``, the column first."""
    return F.concat(F.lit("("), outlier["x"].cast("string"), F.lit(","), outlier["y"].cast("string"), F.lit("):"), outlier["deviation"].cast("string"))


def tile_debug_text(batch_id: Column, print_id: Column, tile_id: Column, layer: Column, saturated: Column) -> Column:
    return F.format_string("tile %d of print %s, layer %d, batch %d: %d saturated", tile_id, print_id, layer, batch_id, saturated)
