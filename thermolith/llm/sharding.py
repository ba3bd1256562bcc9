"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit positions; a document belongs
to the first point at or after the hash of its id. A shard takes its own
documents up to its capacity, and what is over continues clockwise to the next
point whose shard has room. Capacities are the row count divided by the number
of shards, one more for as many shards as the remainder says, so every shard
ends exactly full: counts differ by one at most (law ``rows``). Only what
overflows leaves its home.

The walk sees arcs, not documents: the documents between two points are alike
to it, so their number is enough, and a table of shards times points rows
decides everything. A document then needs only its rank in its arc, taken in
sub-groups of bounded size, and a look-up in that table.

Where one shard is added, its capacity comes out of all others', which are full;
so besides the new shard's own rows some move between old ones. Of rows dealt
to 24 shards 6.5 to 7 in a hundred move for a 25th, where 4 would have to.

Cases: a null text has size 8 and the checksum of nothing; null ids share one
position; repeated rows are placed as often as they occur, and ties in position
in row order; texts of any length count whole; an empty table gives no rows; fewer rows than shards leave some shards empty; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
POINTS = 64
#: Documents of an arc that are ranked together, about.
RANKED_TOGETHER = 100_000


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all points in ascending order, and the shard of each."""
    found = sorted(
        (int.from_bytes(hashlib.sha256(f"shard {s} point {p}".encode()).digest()[:8], "little"), s)
        for s in range(shards)
        for p in range(points)
    )
    return np.array([p for p, _ in found], np.uint64), np.array([s for _, s in found], np.int64)


def position(ids: np.ndarray) -> np.ndarray:
    """A well-mixed unsigned 64-bit position of each id."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard) that the documents of each arc go to."""
    room, out, over = list(room), [], []
    for arc, (n, shard) in enumerate(zip(counts, owners, strict=True)):
        own = min(n, room[shard])
        room[shard] -= own
        if own:
            out.append((arc, 0, own, shard))
        if own < n:
            over.append((arc, own, n))
    for arc, at, end in over:
        for step in range(1, len(owners) + 1):
            shard = owners[(arc + step) % len(owners)]
            if take := min(end - at, room[shard]):
                out.append((arc, at, at + take, shard))
                room[shard] -= take
                at += take
            if at == end:
                break
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, home (the ring's choice without bounds) and slot of each row."""
    spark = docs.sparkSession
    positions, owners = ring(shards, points)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = position(batch.column("doc_id").fill_null(-1).to_numpy())
            arcs = np.searchsorted(positions, where) % len(positions)
            yield batch.append_column("arc", pa.array(arcs.astype(np.int32))).append_column("where", pa.array(where.view(np.int64)))

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = common.saved(rows.mapInArrow(locate, "doc_id long, size long, text_crc32 long, row long, arc int, where long"), "ring")

    arcs = {r["arc"]: r["count"] for r in placed.groupBy("arc").count().collect()}  # shards times points rows at most
    total = sum(arcs.values())
    segments, filled = [], [0] * shards
    for arc, first, end, shard in walk([arcs.get(a, 0) for a in range(len(owners))], owners.tolist(), capacities(total, shards)):
        segments.append((arc, first, end, shard, int(owners[arc]), filled[shard]))
        filled[shard] += end - first
    table = spark.createDataFrame(segments, "arc int, first long, end long, shard int, home int, base long")

    # As many sub-groups as an arc's own number of rows asks for, so an id that many rows share is split too. One row per arc.
    salts = spark.createDataFrame([(a, max(1, -(-n // RANKED_TOGETHER))) for a, n in arcs.items()], "arc int, salts int")
    sub = placed.join(F.broadcast(salts), "arc").withColumn("sub", F.pmod(F.col("row"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sub.groupBy("arc", "sub").count().select("arc", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("arc", "sub").orderBy("where", "row")
    ranked = sub.withColumn("own", F.row_number().over(order) - 1).join(starts, ["arc", "sub"]).withColumn("rank", F.col("start") + F.col("own"))
    # The table has at most two segments for each arc and one more for each shard that fills up.
    hit = (ranked["arc"] == table["arc"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["end"])
    return ranked.join(F.broadcast(table), hit).select(
        "doc_id", "size", "text_crc32", "shard", "home", (F.col("base") + F.col("rank") - F.col("first")).alias("slot")
    )


def op6_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home"
    )
