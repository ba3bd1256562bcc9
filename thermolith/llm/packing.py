"""Best-fit packing whose bin counts are certified by dual-feasible functions.

Each stretch (a partition, or a stretch of a mixture where one is given) packs
its own pieces with best-fit decreasing and computes a lower bound on the
sequences that its pieces need. Where the count meets the bound the stretch is
done. Where it does not, it gives up the pieces of its emptiest sequences; the
pieces of eight neighbouring stretches meet, are packed again, and so on until
one stretch is left. Only pieces of the gap travel, never tokens. Sequence
numbers rise with the stretches; what several stretches pack together stands
at the end of the last of them.

Cases: a null text is an empty one and gives a piece of the separator alone; a
null doc_id stays null; repeated rows are packed as often as they occur; texts
of any length are encoded whole and cut into full sequences; ties in length are
taken in row order; an empty table gives no rows; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
#: Stretches whose open pieces meet in the next round.
MERGE = 8
#: Sequences given up for each one above the bound, and at least.
OPEN_FOR_EACH, OPEN_LEAST = 4, 8
#: Pieces that a first partition holds at least, so that what it wastes at its end is a small share.
PIECES_EACH = 20_000
#: Pieces that a stretch without a given number holds at most; what a partition has beyond is a stretch of its own.
PIECES_MOST = 1_000_000
#: Documents of a mixture that a stretch holds.
STRETCH_DOCS = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", stretch long, sequence_id long, offset long, open boolean, bins long, bound long"


def tokenized_pieces(
    docs: DataFrame,
    vocabulary: str | None = None,
    separator_id: int = 0,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str | None = None,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, its ids followed by the separator; with a source column, beside its source."""
    vocabulary = vocabulary or tokens.default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(vocabulary)
        end = np.uint32(separator_id).astype("<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            sources = batch.column(2).to_pylist() if source_col else [None] * batch.num_rows
            for doc_id, text, source in zip(batch.column(0).to_pylist(), batch.column(1), sources, strict=True):
                data = enc.encode(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), *((source,) if source_col else ())))
            yield _rows(out, schema)
        enc.clear()

    schema = PIECES + (", source string" if source_col else "")
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    return docs.select(*columns, *([F.col(source_col).cast("string").alias("source")] if source_col else ())).mapInArrow(common.tidy(cut), schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin.

    ``rooms`` has a bit for each amount of room that some bin has, so the
    tightest bin that fits is one shift and one lowest bit away.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        if room > n:
            with_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound that three families of dual-feasible functions give, in whole numbers.

    A dual-feasible f has sum f(x) <= 1 for all sizes that fit one bin, so the
    sum of f over the pieces, rounded up, is a bound on bins. The families: f
    is 1 above capacity - t, 0 below t, x / capacity between; f rounds
    (k + 1) x / capacity down to multiples of 1 / k; and f counts how many
    sizes of at least t fit, giving halves their due.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity) if len(lengths) else 0


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same from the number of pieces of each length."""
    sizes, count = np.arange(capacity + 1, dtype=np.int64), count.astype(np.int64)
    best = -(-int((sizes * count).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(sizes * count)
    for t in (np.flatnonzero(count[: capacity // 2 + 1])).tolist():
        if t == 0:
            continue
        large = int(number[-1] - number[capacity - t])
        between = int(total[capacity - t] - total[t - 1])
        best = max(best, large + -(-between // capacity))
        whole = capacity // t
        half = np.where(2 * sizes > capacity, 2 * whole - 2 * ((capacity - sizes) // t), np.where(2 * sizes == capacity, whole, 2 * (sizes // t)))
        best = max(best, -(-int((half * count).sum()) // (2 * whole)))
    for k in range(1, 33):
        up = (k + 1) * sizes
        scaled = np.where(up % capacity == 0, k * sizes, capacity * (up // capacity))
        best = max(best, -(-int((scaled * count).sum()) // (k * capacity)))
    return best


def _pack_stretch(table: pa.Table, number: int, last: bool, capacity: int) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, offsets, left = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    free = np.zeros(len(left), bool)
    gap = len(left) - bound
    if gap and not last:
        n = min(len(left), max(OPEN_LEAST, OPEN_FOR_EACH * gap))
        free[np.argsort(-left, kind="stable")[:n]] = True
        free &= left > 0
    for name, values in (
        ("sequence_id", bins + number),
        ("offset", offsets),
        ("open", free[bins]),
        ("bins", np.full(len(bins), len(left))),
        ("bound", np.full(len(bins), bound)),
    ):
        table = table.append_column(name, pa.array(values))
    return table


def _by_stretch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, pa.Table]]:
    """Runs of rows whose stretches are of the same ``width`` successive ones, with the run's number."""
    held, own = [], None
    for batch in batches:
        runs = batch.column(batch.schema.get_field_index("stretch")).to_numpy() // width
        borders = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
        for a, b in zip(borders, borders[1:], strict=False):
            if a == b:
                continue
            if held and runs[a] != own:
                yield own, pa.Table.from_batches(held)
                held = []
            own = int(runs[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield own, pa.Table.from_batches(held)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns PIECES, and ``stretch`` where the order of stretches counts) a sequence and a place in it.

    Without stretches the partitions of ``pieces`` are the first round's, so
    pieces that stand near each other share sequences. A task holds the numbers
    of one stretch only, about fifty bytes a piece. ``bins`` and ``bound`` tell
    the count and the bound of the round that closed the piece's sequence.
    """
    columns = [c.split()[0] for c in PIECES.split(", ")]
    spark, ordered = pieces.sparkSession, "stretch" in pieces.columns
    if ordered:
        pieces = pieces.select(*columns, F.col("stretch").cast("long"))
        many = (pieces.agg(F.max("stretch")).first()[0] or 0) + 1
        todo = pieces.repartition(common.shuffle_width(spark), "stretch").sortWithinPartitions("stretch", *columns)
    else:
        split = max(1, -(-pieces.count() // PIECES_MOST))
        many = max(1, pieces.rdd.getNumPartitions()) * split
        row = F.monotonically_increasing_id()  # the partition's number, then the row's in 33 bits
        part = F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / PIECES_MOST)
        todo = pieces.select(*columns, (F.spark_partition_id().cast("long") * split + part).alias("stretch"))
    closed, level, width = [], 0, 1
    while True:
        last = width >= many

        def step(batches, level=level, width=width, last=last):
            for run, table in _by_stretch(batches, width):
                end = min((run + 1) * width, many) - 1
                yield from _pack_stretch(table, (end << 32) + (level << 28), last, capacity).to_batches(max_chunksize=10_000)

        done = common.saved(todo.mapInArrow(step, PACKED), f"packed-{level}")
        closed.append(done.where("not open"))
        if last:
            break
        level, width = level + 1, width * MERGE
        run = F.floor(F.col("stretch") / width)
        todo = done.where("open").select(*columns, "stretch").repartition(min(common.shuffle_width(spark), -(-many // width)), run).sortWithinPartitions("stretch", *columns)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop("open") if ordered else out.drop("open", "stretch")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences of a whole packing, and the bound on how few there could be, from one row per length."""
    count = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return packed.where("offset = 0").count(), bound_of_counts(count, capacity)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, stretches: DataFrame | None = None) -> DataFrame:
    """Tokenize and pack whole documents. Encoding runs once: its pieces are a written table.

    ``stretches`` (doc_id, source, stretch) tells which documents belong together, in which order.
    """
    if stretches is not None:
        pieces = common.saved(tokenized_pieces(docs, vocabulary, capacity=capacity, source_col="source"), "pieces")
        of = stretches.withColumnsRenamed({"doc_id": "__id", "source": "__source"})
        placed = common.saved(pieces.join(of, pieces["doc_id"].eqNullSafe(of["__id"]) & pieces["source"].eqNullSafe(of["__source"])), "placed")
        packed = pack(placed, capacity)
        common.forget(pieces, placed)
        return packed
    pieces = common.saved(tokenized_pieces(docs, vocabulary, capacity=capacity), "pieces")
    packed = pack(pieces.coalesce(max(1, -(-pieces.count() // PIECES_EACH))), capacity)
    common.forget(pieces)
    return packed


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
