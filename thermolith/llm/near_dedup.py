"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents are sets of hashed word five-grams. Equal sets are one node with a
count. Nodes that share a band of their MinHash signature are candidates, in
the first band that they share. A bucket's candidates are compared some values
at a time: a pair is dropped as soon as the posterior probability that its
similarity reaches the threshold, given the matches so far, is below the
tolerance. The pairs that stay, and no others, are verified exactly on the
whole sets.

Nothing emits pairs. A bucket larger than a block is dealt as pairs of blocks
to many tasks; blocks have bounded rows and n-grams. Tasks see signatures
first and say which nodes have a pair that stays; only those nodes' sets travel,
and only to those tasks, which find the same pairs again and give each node's
number of links and a forest of links, one row per node. A chain of many texts
thus costs in proportion to its buckets and to the pairs that stay. Texts of
which all are alike cost the square of their number, as exact numbers of links
do: of n such texts a set travels n / BLOCK_ROWS times. Copies cost nothing.

A pair at similarity 0.8 misses every one of the 25 bands of five values with
probability 5e-5, and less above it; pruning loses it with less than 1.3e-5 in
all eight steps together. No candidate is cut off by number.

Cases: a null text is an empty one; texts without words have no n-grams, link
to nothing and stay by themselves; a text of one to four words is one n-gram;
texts of any length give all their n-grams; a pair that ties with the threshold
is a link; a null doc_id takes part and names a class only if no other id does;
repeated rows count as copies; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
VALUES = 128
#: Values compared before pairs are dropped again, and the posterior probability below which they are.
STEP, TOLERANCE = 16, 1e-6
#: Nodes, and n-grams of them, that a block of a bucket holds, about; a task compares a block with itself or with another.
BLOCK_ROWS, BLOCK_GRAMS = 512, 4_000_000
#: Pairs looked at together, and nodes from which a task's n-grams are counted by matrix products.
PAIRS_EACH, DENSE = 1 << 18, 64
SEED = 4

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_COLUMNS = 4096


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _MIX, strict=True):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashed n-grams of a text's white-space words, in ascending order."""
    found = text.split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = min(words, len(found))
    total = np.zeros(len(found) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[i : i + len(total)]
    return np.unique(_mixed(total + np.uint64(n)))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def minhash(grams: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """VALUES minima of hashed n-grams, taken in blocks so that long texts need no more memory."""
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(grams), 2048):
        values = ((grams[at : at + 2048, None] * factors + shifts) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, values.min(axis=0))
    return low


def sketched(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash of the text, key of the n-gram set (null where empty), n-grams and signature of each row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations()
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column(2):
                grams = shingles(text.as_py() or "", words)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                sizes.append(len(grams))
                signatures.append(minhash(grams, factors, shifts).tobytes() if len(grams) else None)
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "key", "size", "signature"])

    return _texts(docs, id_col, text_col).mapInArrow(common.tidy(sketch), "doc_id long, text_hash long, key binary, size long, signature binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def least_matches(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> dict[int, int]:
    """After n values, the fewest matches with which a pair's posterior probability still reaches the tolerance.

    With a uniform prior, P(s >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    Signatures keep eight bits of a value, so values of different n-grams match
    once in 256, and t stands for the chance of a match at the threshold.
    """
    t, found = threshold + (1 - threshold) / 256, {}
    for n in range(step, values + 1, step):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= tolerance:
                found[n] = m
                break
    return found


def surviving(marks: np.ndarray, first: np.ndarray, second: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows of a matrix of marks that pruning leaves."""
    matches = np.zeros(len(first), np.int16)
    for n, m in least.items():
        part = slice(n - STEP, n)
        matches = matches + (marks[first, part] == marks[second, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= m
        first, second, matches = first[keep], second[keep], matches[keep]
    return first, second


def candidates(task: np.ndarray, crossed: np.ndarray, right: np.ndarray, band: np.ndarray, bands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same task whose first shared band is the task's, some at a time.

    Rows stand in order of task, and those of a task's second block (``right``)
    behind those of its first; a task of two blocks is ``crossed``, others pair all their rows.
    """
    n = len(task)
    ends = np.searchsorted(task, task, side="right")
    rights = np.searchsorted(2 * task + right, 2 * task + 1)  # where a task's second block begins
    low = np.where(crossed, np.where(right, ends, rights), np.arange(1, n + 1))
    counts = ends - low
    total = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_EACH, side="right")) - 1)
        own = counts[at:end]
        first = np.repeat(np.arange(at, end), own)
        second = np.arange(len(first)) - np.repeat(total[at:end] - total[at], own) + np.repeat(low[at:end], own)
        for b in range(bands.shape[1]):
            if not len(first):
                break
            new = (bands[first, b] != bands[second, b]) | (band[first] <= b)
            first, second = first[new], second[new]
        if len(first):
            yield first, second
        at = end


def forest(n: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[first], root[second])
        new = root.copy()
        np.minimum.at(new, first, low)
        np.minimum.at(new, second, low)
        np.minimum.at(new, root[first], low)
        np.minimum.at(new, root[second], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _blocks(rows: Column, grams: Column, own: Column) -> Column:
    """The pairs of blocks (a <= b) of a bucket that a row belongs to, and whether it stands in the second of two."""
    count = F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(grams / BLOCK_GRAMS)).cast("int")
    mine = F.pmod(F.xxhash64(own), count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda x: F.struct(F.least(x, mine).alias("a"), F.greatest(x, mine).alias("b"), (mine > x).cast("int").alias("right"))
    )


TASK, TOGETHER = ["bucket", "a", "b"], 2000


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tasks, about TOGETHER rows of them, from batches in order of TASK and ``right``, with the number of each row's task."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for c in TASK:
            values = table.column(c).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return new

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        new = starts(table)
        cuts, at = np.flatnonzero(new).tolist(), 0
        for i, cut in enumerate(cuts):  # the last task may go on in the next batch
            if i + 1 == len(cuts) or cuts[i + 1] - at > TOGETHER:
                yield table.slice(at, cut - at), np.cumsum(new[at:cut]) - new[at]
                at = cut
        held = table.slice(at).combine_chunks().to_batches() if at else held
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.cumsum(starts(table))


def _pairs(table: pa.Table, task: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same task that pruning leaves."""
    crossed = table.column("a").to_numpy() != table.column("b").to_numpy()
    right, band = table.column("right").to_numpy().astype(bool), table.column("band").to_numpy()
    bands, marks = _fixed(table.column("bands"), np.uint32, BANDS), _fixed(table.column("marks"), np.uint8, VALUES)
    found = [surviving(marks, *pairs, least) for pairs in candidates(task, crossed, right, band, bands)]
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return tuple(np.concatenate(x) for x in zip(*(found or none), strict=True))


def _fixed(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _bands(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each signature in every band."""
    out = np.empty((len(signatures), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signatures), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, i])
        out[:, b] = key
    return out


def _overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many n-grams the sets of each pair have in common."""
    rows, places = np.unique(np.concatenate([first, second]), return_inverse=True)
    first, second = places[: len(first)], places[len(first) :]
    sizes = np.array([len(sets[r]) for r in rows])
    grams, number = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    owned = np.repeat(np.arange(len(rows)), sizes) * len(grams) + number  # ascending: sets are
    start = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(len(first), np.int64)
    small, large = np.where(sizes[first] <= sizes[second], (first, second), (second, first))
    steps = np.cumsum(sizes[small])
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(steps, (steps[at - 1] if at else 0) + 2 * PAIRS_EACH)))
        own = sizes[small[at:end]]
        index = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[small[at:end]], own)
        wanted = np.repeat(large[at:end], own) * len(grams) + number[index]
        hit = owned[np.minimum(np.searchsorted(owned, wanted), len(owned) - 1)] == wanted
        out[at:end] = np.add.reduceat(hit, np.cumsum(own) - own)
        at = end
    return out


def verified(sets: list[np.ndarray], task: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose Jaccard similarity reaches the threshold, exactly."""
    keep = np.zeros(len(first), bool)
    rows_of = np.bincount(task)
    dense = rows_of[task[first]] >= DENSE
    few = np.flatnonzero(~dense)
    if len(few):
        both = _overlaps(sets, first[few], second[few])
        sizes = np.array([len(x) for x in sets])
        keep[few] = both >= threshold * (sizes[first[few]] + sizes[second[few]] - both) - 1e-6
    for t in np.unique(task[first[dense]]).tolist():
        own = np.flatnonzero(dense & (task[first] == t))
        left, left_at = np.unique(first[own], return_inverse=True)
        right, right_at = np.unique(second[own], return_inverse=True)
        keep[own] = linked(sets, left, right, threshold)[left_at, right_at]
    return first[keep], second[keep]


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """A matrix that tells for n-gram sets on two sides whether their Jaccard similarity reaches the threshold, exactly.

    Common n-grams are counted by products of 0/1 matrices over a few thousand
    n-grams at a time, of those n-grams only that two rows or more hold.
    """
    rows = np.concatenate([left, right])
    sizes = np.array([len(sets[i]) for i in rows], np.int64)
    _, inverse, times = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    keep = times[inverse] > 1
    rank = np.cumsum(times > 1) - 1
    owner, column = owner[keep], rank[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    n_left = len(left)
    common_grams = np.zeros((n_left, len(right)), np.float32)
    for at in range(0, int((times > 1).sum()), _COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + _COLUMNS)))
        dense = np.zeros((len(rows), _COLUMNS), np.float32)
        dense[owner[part], column[part] - at] = 1
        common_grams += dense[:n_left] @ dense[n_left:].T
    return common_grams >= threshold * (sizes[:n_left, None] + sizes[n_left:][None, :] - common_grams) - 1e-6


def _first(none: Column, doc_id: Column, text_hash: Column) -> Column:
    """The first document of some: the smallest id, null only if all are."""
    return F.min(F.struct(none.alias("none"), doc_id.alias("id"), text_hash.alias("hash")))


def _classed(docs: DataFrame, threshold: float, words: int, tolerance: float, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, text_hash, key, first (of its class) and n_links."""
    spark = docs.sparkSession
    least = least_matches(threshold, tolerance)
    sketches = common.saved(sketched(docs, words, id_col, text_col), "sketches")
    first = _first(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    nodes = sketches.where("key is not null").groupBy("key")
    nodes = common.saved(nodes.agg(F.count("*").alias("n"), first.alias("first"), F.min("size").alias("size"), F.min("signature").alias("signature")), "nodes")

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = _bands(_fixed(batch.column("signature"), np.uint32, VALUES)).view(np.int64)
            for b in range(BANDS):
                number = pa.array(np.full(batch.num_rows, b, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), number, pa.array(buckets[:, b])], ["key", "size", "band", "bucket"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures by eight bits of a value and 32 bits of a band."""
        for batch in batches:
            values = _fixed(batch.column("signature"), np.uint32, VALUES)
            columns = [[row.tobytes() for row in x] for x in (_bands(values).astype(np.uint32), values.astype(np.uint8))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.binary()) for c in columns)], ["key", "bands", "marks"])

    marked = nodes.select("key", "signature").mapInArrow(mark, "key binary, bands binary, marks binary")
    banded = common.saved(nodes.select("key", "size", "signature").mapInArrow(band, "key binary, size long, band int, bucket long"), "bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("grams")).where("rows > 1")
    parts = F.explode(_blocks(F.col("rows"), F.col("grams"), F.col("key"))).alias("p")
    rows = banded.join(shared, "bucket").select("key", "bucket", "band", parts).select("key", "bucket", "band", "p.a", "p.b", "p.right")

    def dealt(table: DataFrame) -> DataFrame:
        return table.repartition(common.shuffle_width(spark), *TASK).sortWithinPartitions(*TASK, "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, task in _tasks(batches):
            staying = np.unique(np.concatenate(_pairs(table, task, least)))
            if len(staying):
                yield from table.select(["key", *TASK, "band", "right"]).take(pa.array(staying)).combine_chunks().to_batches(max_chunksize=10_000)

    asked = dealt(rows.join(marked, "key")).mapInArrow(common.tidy(compare), "key binary, bucket long, a int, b int, band int, right int")
    asked = common.saved(asked, "asked")

    # Nodes with pairs are a share of the documents, so their list is never broadcast: small tables then cost as large ones do.
    wanted = nodes.join(asked.select("key").distinct(), "key").select("key", "n", "first")
    match = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.hash"))
    sent = _texts(docs, id_col, text_col).join(wanted.hint("merge"), match).select("key", "n", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(t.as_py() or "", words).tobytes() for t in batch.column("text")]
            same = [hashlib.blake2b(g, digest_size=16).digest() == k for g, k in zip(grams, batch.column("key").to_pylist(), strict=True)]
            # Should texts with one id share a hash, only those with the node's set count.
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(grams, pa.binary())], ["key", "n", "grams"]).filter(pa.array(same, pa.bool_()))

    sets = sent.mapInArrow(common.tidy(gather), "key binary, n long, grams binary").dropDuplicates(["key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, task in _tasks(batches):
            sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            first, second = verified(sets, task, *_pairs(table, task, least), threshold)
            if not len(first):
                continue
            n, key = table.column("n").to_numpy(), table.column("key")
            links = np.bincount(first, n[second], len(n)) + np.bincount(second, n[first], len(n))
            used = np.flatnonzero(links)
            root = forest(len(n), first, second)[used]
            columns = [key.take(pa.array(used)), pa.chunked_array([pa.array(links[used].astype(np.int64))]), key.take(pa.array(root))]
            yield from pa.table(columns, ["key", "links", "to"]).combine_chunks().to_batches(max_chunksize=10_000)

    sets = common.saved(sets, "sets")
    found = common.saved(dealt(asked.join(sets.join(marked, "key"), "key")).mapInArrow(common.tidy(verify), "key binary, links long, to binary"), "links")
    common.forget(banded, asked, sets)
    totals = found.groupBy("key").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("to").alias("u"), F.col("key").alias("v")))
    named = nodes.select("key", "n", "first").join(totals, "key", "left").join(tied.withColumnRenamed("node", "key"), "key", "left")
    named = common.saved(named.select("key", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "key").alias("root")), "named")
    common.forget(nodes, found)
    classes = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("class_first"))
    by_key = named.join(classes, F.col("root") == F.col("r")).select(F.col("key").alias("k"), "class_first", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = sketches.select("doc_id", "text_hash", "key").join(common.saved(by_key, "classes"), F.col("key") == F.col("k"), "left")
    return out.select("doc_id", "text_hash", "key", "class_first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class) and n_links (other documents at the threshold or above)."""
    rows = _classed(docs, threshold, words, tolerance, id_col, text_col)
    return rows.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_first.id")).alias("class_id"), "n_links")


def keep_one_of_each(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The first document of each class and all documents without words, with all their columns; rows that repeat id and text count once."""
    rows = common.saved(_classed(docs, threshold, words, tolerance, id_col, text_col), "near")
    is_first = F.col("key").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_first.id")) & (F.col("text_hash") == F.col("class_first.hash")))
    gone = rows.where(~is_first).select(F.col("doc_id").alias(common.free("id", docs)), F.col("text_hash").alias(common.free("hash", docs))).distinct()
    match = docs[id_col].cast("long").eqNullSafe(gone[gone.columns[0]]) & (F.xxhash64(docs[text_col]) == gone[gone.columns[1]])
    kept = docs.join(gone.hint("merge"), match, "left_anti")
    repeated = rows.where(is_first).groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept.dropDuplicates([id_col, text_col]) if repeated.limit(1).count() else kept


def op4_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
