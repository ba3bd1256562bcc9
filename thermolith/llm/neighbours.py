"""Approximate nearest neighbours by a hash-prefix forest.

In every tree a vector has a long hash string. A symbol of it names the largest
in size of sixteen random projections of the vector (seen from the rows' mean)
and its sign, so that a tree's next symbol splits rows in 32 and near vectors
agree far oftener than by signs alone. The strings of a tree stand in sorted
arrays, dealt by prefix: a range holds the rows of one prefix, or a part of
them where a prefix has very many. A query goes to its own range of each tree
and finds there, between two binary searches, the rows that share a prefix.

All trees ascend together, symbol by symbol, from the longest matches: the
query takes the level at which its matches in all trees first reach the asked
number, in as many trees as that needs, and the level below in the others. It
asks for ASKED times the POWER of the number of rows, so the share of rows that
it looks at falls as the table grows. How many rows match at which level is
read from the strings of a bounded sample of rows (all of them, up to
SAMPLE_ROWS); every row is indexed. Distances to the rows found are exact, in
tasks of one block of rows each, to which candidates travel as ids. A query for
which the forest finds fewer than asked to return ascends to the root: it is
compared with all rows.

Of equal vectors, which a third of the table may hold, the k + 1 smallest ids are
all that any answer can hold; their vector is indexed once, and equal queries
are searched once.

Cases: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part; a null id takes no part; ties go to the
smaller id; rows that repeat id and vector count once; a query with fewer than
k candidates gets them all; vectors of any length are read whole; an empty
table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .sharding import position

TREES, GROVE = 192, 8
#: Projections that a symbol chooses from, bits of a symbol, and symbols of a string at most.
PROJECTED, BITS, SYMBOLS = 16, 5, 12
#: Matches in all trees that a query asks for: this times this power of the number of rows, and so many for each row to return.
ASKED, POWER, ASKED_EACH = 3.0, 0.75, 10
#: Rows, and numbers in all, of the sample whose strings tell the level of a query.
SAMPLE_ROWS, SAMPLE_NUMBERS = 16_384, 1 << 20
#: Rows of one sorted array, about; rows that a task hashes at once; rows of a block that distances are taken in; ids of candidates that meet there, about.
RANGE_ROWS, CHUNK_ROWS, BLOCK_ROWS, PAIRS_EACH = 131_072, 65_536, 16_384, 4_000_000
SEED = 2

RANGES = "tree int, prefix long, part int, codes binary, reps binary"
ASKS = "tree int, prefix long, part int, rep long, code long, level int"
CANDIDATES = "rep long, block int, ids binary"
FOUND = "rep long, near long, score double"


class Hashes:
    """The hash strings of vectors in every tree, as numbers whose highest bits are the first symbol."""

    def __init__(self, mean: np.ndarray, symbols: int, trees: int = TREES, seed: int = SEED):
        self.symbols, self.trees, self._mean = symbols, trees, mean
        self._shape = len(mean), symbols * PROJECTED
        self._seed, self._planes = seed, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_planes": {}}

    def of_tree(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        if tree not in self._planes:
            self._planes[tree] = np.random.default_rng([self._seed, tree]).normal(size=self._shape).astype(np.float32)
        seen = ((vectors - self._mean).astype(np.float32) @ self._planes[tree]).reshape(len(vectors), self.symbols, PROJECTED)
        largest = np.abs(seen).argmax(axis=2)
        symbols = 2 * largest + (np.take_along_axis(seen, largest[:, :, None], axis=2)[:, :, 0] > 0)
        return symbols @ (1 << BITS * np.arange(self.symbols - 1, -1, -1, dtype=np.int64))

    def drop(self, level: np.ndarray | int) -> np.ndarray | int:
        """Bits behind a prefix of so many symbols."""
        return BITS * (self.symbols - level)

    def matches(self, ordered: np.ndarray, codes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where in a sorted array the strings stand that share a prefix with each code."""
        drop = self.drop(level)
        first = (codes >> drop) << drop
        return np.searchsorted(ordered, first), np.searchsorted(ordered, first + (1 << drop))


def ascended(counts: np.ndarray, asked: float) -> np.ndarray:
    """The level that each tree (last axis) takes, from matches by level and tree, so that trees ascend together to the asked number."""
    totals = counts.sum(axis=1)
    enough = np.flatnonzero(totals >= asked)
    level = int(enough[-1]) if len(enough) else 0
    levels = np.full(counts.shape[1], level, np.int32)
    if level + 1 < len(counts) and len(enough):
        gained = np.cumsum(counts[level] - counts[level + 1])
        levels[int(np.searchsorted(gained, asked - totals[level + 1])) + 1 :] = level + 1
    return levels


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def sound(embedding: Column) -> Column:
    """True for vectors that take part."""
    real = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(embedding.isNotNull() & real & F.exists(embedding, lambda x: x != 0), F.lit(False))


def candidates(vectors: DataFrame, queries: DataFrame, n: int, least: int, asked: float | None = None, blocks: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each query (rep, v) the ids of the rows of ``vectors`` (rep, v; n distinct ones) that the forest finds, by block; an id may come from several trees."""
    spark = vectors.sparkSession
    asked = max(ASKED_EACH * least, ASKED * n**POWER) if asked is None else asked
    symbols = min(SYMBOLS, 1 + math.ceil(math.log(max(n, 2)) / math.log(1 << BITS)))
    depth = 0
    while n >> (BITS * depth) > range_rows and depth < symbols:
        depth += 1

    # A bounded sample: the mean, the sizes of ranges, and how many strings share a prefix with a query's.
    width = len(vectors.first()["v"])
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // width))
    few = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(n)) < rows) if n > rows else vectors
    sample = np.array([r["v"] for r in few.select("v").collect()]).reshape(-1, width)
    hashes = Hashes(sample.mean(axis=0) if len(sample) else np.zeros(width), symbols)
    scale, whole = n / max(1, len(sample)), len(sample) == n
    ordered = [np.sort(hashes.of_tree(sample, t)) for t in range(TREES)]
    shared = spark.sparkContext.broadcast(ordered)
    parts = {}
    if depth:
        for t, codes in enumerate(ordered):
            for prefix, c in Counter((codes >> hashes.drop(depth)).tolist()).items():
                if c * scale > 2 * range_rows:
                    parts[t, prefix] = math.ceil(c * scale / range_rows)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, count = TaskContext.get().partitionId(), 0, [], 0

        def chunk(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(tables)
            reps, matrix = table.column("rep").to_numpy(), _matrix(table.column("v"))
            for tree in range(hashes.trees):
                codes = hashes.of_tree(matrix, tree)
                order = np.argsort(codes, kind="stable")
                prefixes = codes[order] >> hashes.drop(depth)
                cuts = [0, *(np.flatnonzero(np.diff(prefixes)) + 1).tolist(), len(order)]
                spans = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                own = [int(prefixes[a]) for a in cuts[:-1]]
                part = [(task + number) % parts.get((tree, x), 1) for x in own]
                columns = [[tree] * len(own), own, part, [codes[x].tobytes() for x in spans], [reps[x].tobytes() for x in spans]]
                kinds = pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "prefix", "part", "codes", "reps"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= CHUNK_ROWS:
                yield from chunk(held)
                number, held, count = number + 1, [], 0
        if held:
            yield from chunk(held)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps, matrix, strings = batch.column("rep").to_numpy(), _matrix(batch.column("v")), shared.value
            codes = np.array([hashes.of_tree(matrix, t) for t in range(hashes.trees)])
            counts = np.empty((symbols + 1 - depth, hashes.trees, len(reps)))
            for level in range(depth, symbols + 1):
                for t in range(hashes.trees):
                    low, high = hashes.matches(strings[t], codes[t], level)
                    counts[level - depth, t] = (high - low - whole) * scale
            levels = np.array([ascended(counts[:, :, q], asked) + depth for q in range(len(reps))])
            out = []
            for q, rep in enumerate(reps.tolist()):
                for t in range(hashes.trees):
                    code = int(codes[t, q])
                    prefix = code >> hashes.drop(depth)
                    out += [(t, prefix, part, rep, code, int(levels[q, t])) for part in range(parts.get((t, prefix), 1))]
            kinds = pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in ASKS.split(", ")])

    def find(own: pa.Table, asking: pa.Table) -> pa.Table:
        found: dict[int, list[np.ndarray]] = {}
        if own.num_rows and asking.num_rows:
            trees, asked_trees = own.column("tree").to_numpy(), asking.column("tree").to_numpy()
            all_codes, all_reps = own.column("codes").to_pylist(), own.column("reps").to_pylist()
            askers, code, level = (asking.column(c).to_numpy() for c in ("rep", "code", "level"))
            for tree in np.unique(asked_trees).tolist():
                chunks, at = np.flatnonzero(trees == tree), asked_trees == tree
                codes = np.frombuffer(b"".join(all_codes[i] for i in chunks), np.int64)
                order = np.argsort(codes, kind="stable")
                reps = np.frombuffer(b"".join(all_reps[i] for i in chunks), np.int64)[order]
                low, high = hashes.matches(codes[order], code[at], level[at].astype(np.int64))
                for rep, a, b in zip(askers[at].tolist(), low.tolist(), high.tolist(), strict=True):
                    if a < b:
                        found.setdefault(rep, []).append(reps[a:b])
        out: list[tuple[int, int, bytes]] = []
        for rep, lists in found.items():
            ids = np.unique(np.concatenate(lists))
            ids = ids[ids != rep]
            block = _block(ids, blocks)
            by_block = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by_block])) + 1
            out += [(rep, int(block[x[0]]), ids[x].tobytes()) for x in np.split(by_block, cuts) if len(x)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["rep", "block", "ids"])

    # Some trees meet in a task, so that a row that several of them find travels on once.
    index, asking = (x.withColumn("grove", F.floor(F.col("tree") / GROVE)) for x in (vectors.mapInArrow(common.tidy(ranges), RANGES), queries.mapInArrow(asks, ASKS)))
    at = ["grove", "prefix", "part"]
    return index.groupBy(*at).cogroup(asking.groupBy(*at)).applyInArrow(find, CANDIDATES)


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (position(ids) % np.uint64(blocks)).astype(np.int32)


def _distances(vectors: DataFrame, asked: DataFrame, blocks: int, sets: int, k: int) -> DataFrame:
    """The k nearest of the rows that ``asked`` names (rep, block, and either wanted, a vector, or ids; null ids beside null wanted: all rows)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("block", pa.array(_block(batch.column("rep").to_numpy(), blocks), pa.int32()))

    left = vectors.mapInArrow(place, "rep long, v array<double>, block int").withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("set", F.pmod(F.xxhash64("rep"), F.lit(sets)).cast("int"))

    def search(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and asking.num_rows:
            reps, base = own.column("rep").to_numpy(), _matrix(own.column("v"))
            order = np.argsort(reps)
            reps, base = reps[order], base[order]
            wanted: dict[int, np.ndarray] = {}
            named: dict[int, list[bytes] | None] = {}
            for rep, vector, ids in zip(asking.column("rep").to_pylist(), asking.column("wanted"), asking.column("ids").to_pylist(), strict=True):
                if vector.is_valid:
                    wanted[rep] = vector.values.to_numpy()
                elif ids is None:
                    named[rep] = None
                else:
                    named.setdefault(rep, []).append(ids)
            for rep in sorted(named):
                ids = named[rep]
                at = np.flatnonzero(reps != rep) if ids is None else np.searchsorted(reps, np.unique(np.frombuffer(b"".join(ids), np.int64)))
                far = np.sqrt(((base[at] - wanted[rep]) ** 2).sum(axis=1))
                best = np.lexsort((reps[at], far))[:k]
                out.append((np.full(len(best), rep), reps[at][best], far[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("rep", "near", "score"), columns, strict=True)))

    found = left.groupBy("block", "set").cogroup(right.groupBy("block", "set")).applyInArrow(search, FOUND)
    best = Window.partitionBy("rep").orderBy("score", "near")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    asked: float | None = None,
    range_rows: int = RANGE_ROWS,
    block_rows: int = BLOCK_ROWS,
    pairs_each: int = PAIRS_EACH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and Euclidean distance of the k nearest rows found for each row that ``is_query`` (over vec_id) names.

    ``asked`` is the number of matches in all trees that a query asks for, if not the default by the number of rows.
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double") + 0.0).alias("v"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & sound(F.col("v"))).withColumn("dim", F.size("v"))
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = dims["dim"] if dims else 0
    vectors = vectors.where(F.col("dim") == dim).drop("dim")

    # The smallest ids of each distinct vector; limits within tasks keep copies from meeting in one.
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    few = few.withColumn("rep", F.min("vec_id").over(Window.partitionBy("v")))
    index = common.saved(few.drop("nth"), "index")
    distinct = index.where(F.col("vec_id") == F.col("rep")).select("rep", "v")
    asking = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("own")).dropDuplicates(["query_id", "own"])
    asking = common.saved(asking.join(distinct, F.col("own") == F.col("v")).select("query_id", "rep"), "asking")
    queries = common.saved(distinct.join(asking.select("rep").distinct(), "rep", "left_semi"), "queries")
    n, n_queries = distinct.count(), queries.count()

    found = asking.select("rep", F.col("rep").alias("near"), F.lit(0.0).alias("score")).distinct()  # copies of a query are its nearest
    if n_queries and n > 1:
        blocks = -(-n // block_rows)
        matches = min(TREES * n, max(ASKED_EACH * k, ASKED * n**POWER) if asked is None else asked)
        sets = max(1, math.ceil(n_queries * matches / (blocks * pairs_each)))
        named = common.saved(candidates(distinct, queries, n, k, asked, blocks, range_rows), "candidates")
        wanted = queries.join(named.select("rep", "block").distinct(), "rep").select("rep", "block", F.col("v").alias("wanted"), F.lit(None).cast("binary").alias("ids"))
        near = common.saved(_distances(distinct, wanted.unionByName(named, allowMissingColumns=True), blocks, sets, k + 1), "near")
        common.forget(named)
        # To the root: whoever the forest finds too few for.
        enough = near.groupBy("rep").count().where(F.col("count") >= min(k, n - 1))
        short = common.saved(queries.join(enough, "rep", "left_anti"), "short")
        if n_short := short.count():
            everywhere = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            wanted = everywhere.select("rep", "block", F.col("v").alias("wanted"), F.lit(None).cast("binary").alias("ids"))
            both = wanted.unionByName(everywhere.select("rep", "block"), allowMissingColumns=True)
            rest = _distances(distinct, both, blocks, max(1, math.ceil(n_short * block_rows / pairs_each)), k + 1)
            near = near.join(short.select("rep"), "rep", "left_anti").unionByName(rest)
        found = found.unionByName(near)
    pairs = asking.join(found, "rep").join(index.select(F.col("rep").alias("near"), "vec_id"), "near").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
