"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Each text becomes a few dozen statistics (sizes, shares of character classes,
repetition, lines). Cosines of random projections of them approximate a
Gaussian kernel. The ridge solution needs only X'X and X'y, which every
partition sums for itself, so all labelled rows take part, however many; one
sum per fold gives out-of-fold scores too. Those are counted in a fixed number
of bins, and pooling adjacent violators over the bins turns a ridge score into
a chance of label 1, joined by lines so that order is kept between steps.

Labels, language, source and id are never inputs of a score.

Cases: a null text is an empty one, and empty texts are scored like any other;
a null doc_id never finds a label and is scored; repeated rows are scored alike;
several labels of one document count as their mean; labels other than 0 and 1
and null labels are left out; without any label the score is 0.5; texts of any
length are measured whole; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FEATURES = 384
FOLDS = 5
RIDGE = 1e-3
WIDTH = 4.0
BINS = 512
SEED = 20
#: Labelled rows that one partial sum covers, at least.
ROWS_EACH = 50_000
#: Labelled documents, about, that ``keep_quality`` learns from; those with the smallest hashes of their ids.
FIT_ROWS = 50_000

#: Texts are measured whole; only the share that deflate saves is taken in blocks of this many bytes.
BLOCK = 1 << 20

STATISTICS = (
    "chars words word_mean word_sd short_words long_words distinct_words repeated_next lines line_mean same_lines "
    "upper lower digits blanks stops commas marks exclaims bars other bytes_each saved marked_words upper_words"
).split()


def _ascii(characters: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[ord(c) for c in characters]] = True
    return mask


_UPPER, _LOWER = _ascii("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _ascii("abcdefghijklmnopqrstuvwxyz")
_DIGITS, _BLANKS = _ascii("0123456789"), _ascii(" \t\n\r\x0b\x0c")
_MARKS = _ascii("\"#$%&'()*+-/:;<=>?@[\\]^_`{}~")
_MARK_ENDS = tuple("#$%&*+=~^@!|")


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    data = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, words, lines = max(1, len(data)), text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    w = max(1, len(words))
    saved = sum(len(zlib.compress(data[i : i + BLOCK], 1)) for i in range(0, len(data), BLOCK))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        min(float(lengths.mean()), 50.0),
        min(float(lengths.std()), 50.0),
        float((lengths <= 3).mean()),
        float((lengths > 12).mean()),
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        np.log1p(len(lines)),
        np.log1p(len(text) / len(lines)),
        1 - len(set(lines)) / len(lines),
        count[_UPPER].sum() / n,
        count[_LOWER].sum() / n,
        count[_DIGITS].sum() / n,
        count[_BLANKS].sum() / n,
        count[ord(".")] / w,
        count[ord(",")] / w,
        count[_MARKS].sum() / n,
        count[ord("!")] / w,
        count[ord("|")] / w,
        count[128:].sum() / n,
        len(data) / max(1, len(text)),
        saved / n,
        sum([x.endswith(_MARK_ENDS) for x in words]) / w,
        sum(map(str.isupper, words)) / w,
    ]


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs; its size depends on FEATURES alone."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    chance: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), 0.5)
        return np.clip(np.interp(fourier(rows, self) @ self.weights, self.raw, self.chance), 0.0, 1.0)


def fourier(rows: np.ndarray, model: Model) -> np.ndarray:
    """Random Fourier features of statistics, and a one for the intercept."""
    z = np.clip((rows - model.mean) / model.scale, -6.0, 6.0)
    waves = np.sqrt(2.0 / len(model.phase)) * np.cos(z @ model.projection + model.phase)
    return np.hstack([waves, np.ones((len(rows), 1))])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(common.tidy(measure), "doc_id long, stats array<double>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _stats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


SUMS = "fold int, part int, data binary"


def _matrices(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's sums, one row per fold, with the task's number to deal them by."""
    if total:
        part = TaskContext.get().partitionId()
        columns = [pa.array(list(total), pa.int32()), pa.array([part] * len(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "part", "data"])


def isotonic(score: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the pooled steps' mean scores and chances, for interpolation."""
    pools: list[list[float]] = []
    for s, k, y in zip(score, n, ones, strict=True):
        pools.append([s * k, k, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], a, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH) -> Model:
    """Learn from the rows of ``stats`` that ``labels`` (doc_id, quality) covers and the split does not hold out."""
    spark, d = stats.sparkSession, len(STATISTICS)
    clean = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    rows = stats.where(remainder(F.col("doc_id")) != 1).join(clean, "doc_id")
    rows = common.saved(rows.select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")
    spread = rows.select(F.count("*").alias("n"), *(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    got = spread.first()
    rng = np.random.default_rng(SEED)
    projection, phase = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features)
    none = np.zeros(0)
    if got["m0"] is None:
        return Model(np.zeros(d), np.ones(d), projection, phase, none, none, none)
    mean, scale = np.array([got[f"m{i}"] for i in range(d)]), np.array([got[f"s{i}"] for i in range(d)])
    base = Model(mean, np.where(scale > 1e-9, scale, 1.0), projection, phase, none, none, none)
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, fold = fourier(_stats(batch, "stats"), base), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                own, right = x[fold == k], y[fold == k]
                total[k] = total.get(k, 0) + own.T @ np.column_stack([own, right])
        yield from _matrices(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("fold").to_pylist(), batch.column("data"), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(data.as_buffer())
        yield from _matrices(total)

    # A task sums ROWS_EACH rows or more, and sums meet in fewer and fewer tasks: one matrix for each fold and task.
    few = rows.coalesce(max(1, -(-got["n"] // ROWS_EACH)))
    partial = few.mapInArrow(sums, SUMS)
    while (n := partial.rdd.getNumPartitions()) > FOLDS:
        partial = partial.repartition(max(1, n // 8), "part").mapInArrow(added, SUMS)
    fold_sums: dict[int, np.ndarray] = {}
    for r in partial.collect():  # at most FOLDS matrices for each of FOLDS tasks
        fold_sums[r["fold"]] = fold_sums.get(r["fold"], 0) + np.frombuffer(r["data"]).reshape(size, size + 1)
    everything = sum(fold_sums.values())

    def solved(s: np.ndarray) -> np.ndarray:
        n = max(1.0, s[-1, size - 1])
        return np.linalg.solve(s[:, :size] + ridge * n * np.diag([*np.ones(features), 0.0]) / features + 1e-9 * np.eye(size), s[:, size])

    others = {k: solved(everything - s) if len(fold_sums) > 1 else solved(s) for k, s in fold_sums.items()}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BINS, 3))
        for batch in batches:
            x, y, fold = fourier(_stats(batch, "stats"), base), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            raw = np.einsum("ij,ij->i", x, np.array([others[k] for k in fold.tolist()]))
            at = np.clip(((raw + 1) / 3 * BINS).astype(int), 0, BINS - 1)
            for i, v in enumerate((np.ones(len(raw)), raw, y)):
                out[:, i] += np.bincount(at, v, BINS)
        used = np.flatnonzero(out[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(out[used, i]) for i in range(3))], ["bin", "n", "raw", "ones"])

    bins = rows.mapInArrow(binned, "bin int, n double, raw double, ones double").groupBy("bin")
    table = sorted(bins.agg(F.sum("n").alias("n"), F.sum("raw").alias("raw"), F.sum("ones").alias("ones")).collect())  # BINS rows at most
    n = np.array([r["n"] for r in table])
    raw, chance = isotonic(np.array([r["raw"] for r in table]) / n, n, np.array([r["ones"] for r in table]))
    common.forget(rows)
    return Model(base.mean, base.scale, projection, phase, solved(everything), raw, chance)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each measured row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch, "stats")))], ["doc_id", "score"])

    return stats.mapInArrow(score, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns and without a shuffle of texts.

    It learns from a sample of about ``fit_rows`` labelled documents, whose ids
    alone are sent to every task, so that only these are measured twice.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("known")).where("known is not null").distinct()
    share = min(1.0, fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("known"), F.lit(1 << 30)) < int(share * (1 << 30)))
    text_id = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = text_id.join(F.broadcast(known), F.col("doc_id") == F.col("known"), "left_semi")  # fit_rows ids, about
    stats = common.saved(measured(sample), "statistics")
    model = fit(stats, labels)
    common.forget(stats)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py() or "") for t in batch.column(text_col)]
            if stats:
                yield batch.filter(pa.array(model.score(np.array(stats)) >= threshold))

    return docs.mapInArrow(common.tidy(keep), docs.schema)


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.saved(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "statistics")
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(stats, model).select(
        "doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
