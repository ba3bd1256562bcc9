"""Mixing sources to target weights as a Pfair schedule, in DataFrame operations only.

The documents of a source are cut into blocks; a slot of the mixture takes one
block. In the fluid mixture every source advances in proportion to its weight
until it ends, after which the others share its part. A block is released in
the slot where the fluid mixture begins it and due in the slot where it ends
it; taking in every slot the released block that is due first keeps each source
less than one block away from its fluid share. All documents are placed.

Time is cut into epochs that are scheduled on their own. At an epoch's border
each source stands at its fluid share rounded down or up, the largest
remainders up, so that the sum is the slot's number. Blocks whose window lies
inside any stretch of slots then never outnumber the slots, whichever border
they touch, so earliest deadline first succeeds in every epoch by itself. An
epoch is long enough for the slowest source to advance by one block, and takes
work in proportion to its slots and to the number of sources.

An epoch is one row: its borders, its blocks with their windows and the
schedule are array expressions over the list of sources, which the plan holds
as one literal, so that it has as many nodes for ten sources as for ten
thousand. One row per source is the only thing that reaches the driver; an
epoch takes work in proportion to its slots times the sources.

Weights hold until the first source ends; its part then goes to the others, and
the end of the mixture is the last source alone. ``whole=False`` leaves out
what comes after the first end, as a choice of the caller.

Cases: a null source is a source of its own and a null doc_id is placed like
any other (rows without id, or of one id, are ranked in one task); texts are not
read; repeated rows are placed as often as they occur; a source without a given
weight has the mean of the given ones, and weights of absent sources are left
out; weights must be positive; ties in deadline go to the first source by name;
an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS = 64
EPOCH_SLOTS = 64
STRETCH = 64
#: Power of a source's size that its weight follows where none are given.
TEMPERATURE = 0.5
#: Documents ranked together, about, and parts of a source whose sizes are summed together.
RANKED_TOGETHER, PARTS_TOGETHER = 2000, 4096

_EPS = 1e-6
_SOURCES = "array<struct<i:int,n:bigint,w:double>>"
_PIECES = "array<struct<t:double,g:double,r:double>>"
_SHORT = "array<struct<slot:bigint,rows:bigint>>"
_NAMES = "array<struct<name:string,at:int>>"
_WINDOW = "struct<due:bigint,release:bigint,source:int,block:bigint>"


def _table(rows: list[dict], schema: str) -> Column:
    """A list of rows as one literal, which the optimiser reads once."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbered(docs: DataFrame, id_col: str, source_col: str) -> tuple[DataFrame, list]:
    """Rows with their number in their source and its place (``at``) among the sources, and (source, rows) of all sources in order of name."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    rows = rows.withColumn("hash", F.xxhash64("doc_id"))
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()]  # one row per source
    sizes.sort(key=lambda x: (x[0] is not None, x[0]))
    parts = max(1, -(-sum(n for _, n in sizes) // RANKED_TOGETHER))
    rows = rows.withColumn("part", F.pmod("hash", F.lit(parts)))
    # Starts of parts by sums within runs of parts, and sums of runs, so that no task sees all parts of a source.
    sizes_of = rows.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("part") / PARTS_TOGETHER))
    runs = sizes_of.groupBy("source", "run").agg(F.sum("n").alias("n"))

    def earlier(keys: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    runs = runs.select(F.col("source").alias("of"), F.col("run").alias("r"), earlier(["source"], "run").alias("run_start"))
    starts = sizes_of.withColumn("start", earlier(["source", "run"], "part")).join(runs, F.col("source").eqNullSafe(F.col("of")) & (F.col("run") == F.col("r")))
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), (F.col("run_start") + F.col("start")).alias("start"))
    places = docs.sparkSession.range(1).select(F.inline(_table([{"name": s, "at": i} for i, (s, _) in enumerate(sizes)], _NAMES)))
    starts = starts.join(places, F.col("s").eqNullSafe(F.col("name")))
    own = F.row_number().over(Window.partitionBy("source", "part").orderBy("hash", "doc_id")) - 1
    ranked = rows.withColumn("own", own).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return ranked.select("doc_id", "source", "at", (F.col("start") + F.col("own")).alias("number")), sizes


def fluid_segments(blocks: list[int], weights: list[float]) -> list[tuple[float, float, float]]:
    """Pieces (time, slots, slots per time) of the slots that the fluid mixture has filled by a time.

    At time t a source has done min(its blocks, t times its weight), so pieces end where a source does.
    """
    segments, time, done = [], 0.0, 0.0
    rate = sum(weights)
    for n, w in sorted(zip(blocks, weights, strict=True), key=lambda x: x[0] / x[1]):
        if n / w > time:
            segments.append((time, done, rate))
            done += (n / w - time) * rate
            time = n / w
        rate -= w
    return segments


def schedule(spark: SparkSession, blocks: list[int], weights: list[float], epoch_slots: int = EPOCH_SLOTS) -> DataFrame:
    """Slot of every block: columns source (place in the lists), block, slot, release, due."""
    total = sum(blocks)
    share = min((w / sum(weights) for w in weights), default=1.0)
    length = max(epoch_slots, math.ceil(1 / share) + 1)
    sources = _table([{"i": i, "n": n, "w": w} for i, (n, w) in enumerate(zip(blocks, weights, strict=True))], _SOURCES)
    pieces = _table([{"t": t, "g": g, "r": r} for t, g, r in fluid_segments(blocks, weights)], _PIECES)

    def time_at(slot: Column) -> Column:
        piece = F.element_at(F.filter(pieces, lambda p: p["g"] <= slot), -1)
        return piece["t"] + (slot - piece["g"]) / piece["r"]

    def slots_at(time: Column) -> Column:
        piece = F.element_at(F.filter(pieces, lambda p: p["t"] <= time), -1)
        return F.least(piece["g"] + (time - piece["t"]) * piece["r"], F.lit(float(total)))

    def borders(slot: Column, time: Column) -> Column:
        """Blocks that each source has done by a border: fluid shares rounded, the largest remainders up."""
        shares = F.transform(sources, lambda s: F.least(s["n"].cast("double"), s["w"] * time))
        floors = F.transform(shares, lambda x: F.floor(x + _EPS))
        short = slot - F.aggregate(floors, F.lit(0).cast("long"), lambda a, x: a + x)
        order = F.array_sort(F.transform(F.zip_with(shares, floors, lambda x, f: f - x), lambda d, i: F.struct(d.alias("d"), i.alias("i"))))
        up = F.transform(F.slice(order, F.lit(1), short.cast("int")), lambda o: o["i"])
        return _bound(F.struct(floors.alias("floors"), up.alias("up")), lambda x: F.transform(x["floors"], lambda f, i: F.when(F.array_contains(x["up"], i), f + 1).otherwise(f)))

    def windows(source: Column, first: Column, end: Column) -> Column:
        def window(b: Column) -> Column:
            release = F.floor(slots_at(b / source["w"]) + _EPS)
            due = F.ceil(slots_at((b + 1) / source["w"]) - _EPS)
            return F.struct(due.alias("due"), release.alias("release"), source["i"].alias("source"), b.alias("block"))

        return F.when(end > first, F.transform(F.sequence(first, F.greatest(first, end - 1)), window)).otherwise(F.array().cast(f"array<{_WINDOW}>"))

    epochs = spark.range(-(-total // length)).select((F.col("id") * length).alias("from"), F.least((F.col("id") + 1) * length, F.lit(total)).alias("to"))
    epochs = epochs.withColumns({"t0": time_at(F.col("from")), "t1": time_at(F.col("to"))})
    epochs = epochs.withColumns({"q0": borders(F.col("from"), F.col("t0")), "q1": borders(F.col("to"), F.col("t1"))})
    # Written twice, as the optimiser would else put these lists into the loops over sources and slots that read them.
    borders_of = common.saved(epochs.select("from", "to", "q0", "q1"), "borders")
    epochs = borders_of.withColumn("todo", F.transform(sources, lambda s, i: windows(s, F.get("q0", i), F.get("q1", i))))
    epochs = common.saved(epochs.select("from", "to", "todo"), "epochs")
    common.forget(borders_of)

    def place(state: Column, slot: Column) -> Column:
        """Take the released block that is due first among each source's next one."""
        heads = F.filter(F.transform(state["next"], lambda n, i: F.get(F.get(F.col("todo"), i), n)), lambda b: b.isNotNull())
        picked = _bound(heads, lambda h: F.coalesce(F.array_min(F.filter(h, lambda b: b["release"] <= slot)), F.array_min(h)))

        def taken(pick: Column) -> Column:
            after = F.transform(state["next"], lambda n, i: n + F.when(i == pick["source"], 1).otherwise(0))
            return F.struct(after.alias("next"), F.array_append(state["done"], pick).alias("done"))

        return _bound(picked, taken)

    none = F.array().cast(f"array<{_WINDOW}>")

    def stretch(state: Column, first: Column) -> Column:
        """Slots from ``first`` on, kept as a list of their own so that no long list is copied for every slot."""
        slots = F.sequence(first, F.least(first + (STRETCH - 1), F.col("to") - 1))
        run = F.aggregate(slots, F.struct(state["next"].alias("next"), none.alias("done")), place)
        return _bound(run, lambda r: F.struct(r["next"].alias("next"), F.array_append(state["done"], r["done"]).alias("done")))

    start = F.struct(F.transform(sources, lambda s: F.lit(0)).alias("next"), F.array().cast(f"array<array<{_WINDOW}>>").alias("done"))
    order = F.flatten(F.aggregate(F.sequence(F.col("from"), F.col("to") - 1, F.lit(STRETCH).cast("long")), start, stretch)["done"])
    return epochs.select("from", F.posexplode(order).alias("at", "b")).select("b.source", "b.block", (F.col("from") + F.col("at")).alias("slot"), "b.release", "b.due")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    epoch_slots: int = EPOCH_SLOTS,
    id_col: str = "doc_id",
    source_col: str = "source",
    whole: bool = True,
) -> DataFrame:
    """One row per document: doc_id, source, block of its source, slot of the mixture, position in the mixture (gapless from 0).

    With ``whole`` false, documents after the end of the first source to end are left out.
    """
    spark = docs.sparkSession
    ranked, sizes = _numbered(docs, id_col, source_col)
    out = "doc_id", "source", "block", "slot", "position"
    if not sizes:
        return ranked.select("doc_id", "source", *(F.col("number").alias(c) for c in out[2:]))
    if weights is None:
        target = [n**TEMPERATURE for _, n in sizes]
    else:
        given = [weights[s] for s, _ in sizes if s in weights]
        if any(w <= 0 for w in given):
            raise ValueError("weights must be positive")
        target = [weights.get(s, sum(given) / len(given) if given else 1.0) for s, _ in sizes]
    blocks = [-(-n // block_rows) for _, n in sizes]
    slots = common.saved(schedule(spark, blocks, target, epoch_slots).select("source", "block", "slot"), "slots")
    if not whole:
        ends = [g for _, g, _ in fluid_segments(blocks, target)[1:]]
        slots = slots.where(F.col("slot") < math.floor(min(ends, default=sum(blocks)) + _EPS))

    # A source's last block may be short; later positions move up by what it lacks. One row per source.
    lacking = {i: b * block_rows - n for i, (b, (_, n)) in enumerate(zip(blocks, sizes, strict=True))}
    last = _table([{"i": i, "n": b - 1, "w": 0.0} for i, b in enumerate(blocks)], _SOURCES)
    last = slots.where(F.col("block") == F.get(last, F.col("source"))["n"]).collect()
    short = _table([{"slot": r["slot"], "rows": lacking[r["source"]]} for r in last if lacking[r["source"]]], _SHORT)
    moved = F.aggregate(F.filter(short, lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda a, x: a + x["rows"])
    slots = slots.select(F.col("source").alias("s"), "block", "slot", (F.col("slot") * block_rows - moved).alias("from"))
    rows = ranked.select("doc_id", "source", "at", F.floor(F.col("number") / block_rows).alias("b"), (F.col("number") % block_rows).alias("in_block"))
    placed = rows.join(slots, (F.col("at") == F.col("s")) & (F.col("b") == F.col("block")))
    return placed.select("doc_id", "source", "block", "slot", (F.col("from") + F.col("in_block")).alias("position"))


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` in the order of the mixture: partitions are its successive stretches. Repeated rows stand together."""
    of_id, of_source, position = (common.free(c, docs) for c in ("id", "of", "position"))
    places = mix(docs, weights, id_col=id_col, source_col=source_col).groupBy("doc_id", "source").agg(F.min("position").alias(position))
    places = common.saved(places.withColumnsRenamed({"doc_id": of_id, "source": of_source}), "places")
    end = (places.agg(F.max(position)).first()[0] or 0) + 1
    match = docs[id_col].eqNullSafe(places[of_id]) & docs[source_col].cast("string").eqNullSafe(places[of_source])
    placed = docs.join(places, match).select(*(docs[c] for c in docs.columns), places[position])
    width = common.shuffle_width(docs.sparkSession)
    # Positions are even, so they deal rows by themselves; no pass over the texts looks for borders.
    dealt = placed.repartitionById(width, F.floor(F.col(position) * width / end).cast("int"))
    return dealt.sortWithinPartitions(position).drop(position)


def stretches(docs: DataFrame, docs_each: int, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source and number of the stretch of ``docs_each`` places of the mixture. Repeated rows stand together."""
    places = mix(docs, weights, id_col=id_col, source_col=source_col).groupBy(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return places.agg(F.floor(F.min("position") / docs_each).alias("stretch"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
