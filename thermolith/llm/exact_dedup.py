"""Exact duplicates through a cuckoo-filter index of live digests.

A text's key is the SHA-256 of it without ASCII white space. The index keeps a
16-bit fingerprint of each live key in one of two buckets of four slots, and
beside it, in the same bucket and slot, the whole key. A fingerprint that hits
is only a candidate: the hit counts when the stored key is equal too. A key
leaves the index when its document is deleted. Where an insertion finds no slot
after a chain of moves, the index is rebuilt at twice the size from its stored
keys.

The index runs twice: each task folds its own rows, so a text that fills a
third of the table leaves one row per task; then the tasks' rows meet by key.
Documents learn their class by a join on the key that adaptive execution may
split.

Cases: a null text is an empty one, and all empty texts form one group; a null
doc_id takes part and stays only in a group that has no other id; repeated rows
count as often as they occur; equal lengths go to the smallest doc_id; texts of
any length are read whole; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOTS = 4
MAX_MOVES = 200
#: Keys that a task's own index holds before it hands them on.
LOCAL_KEYS = 200_000
#: Rows that meet in one partition of the shared index.
ROWS_EACH = 500_000

_BLANKS = " \t\n\x0b\x0c\r"
CLASSES = "key binary, n long, chars long, keep_id long"


class CuckooIndex:
    """Keys (bytes, evenly spread) to values, with insertion, look-up and deletion."""

    def __init__(self, buckets: int = 256):
        self._clear(1 << max(1, (buckets - 1).bit_length()))

    def _clear(self, buckets: int) -> None:
        self._mask = buckets - 1
        self._marks = [0] * (buckets * SLOTS)
        self._content: list[tuple[bytes, Any] | None] = [None] * (buckets * SLOTS)
        self._size = 0

    def __len__(self) -> int:
        return self._size

    @staticmethod
    def _mark(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x9E3779B1 >> 7) & self._mask)

    def _slot(self, key: bytes) -> int:
        mark = self._mark(key)
        first = int.from_bytes(key[2:10], "little") & self._mask
        for bucket in (first, self._other(first, mark)):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self._marks[slot] == mark and self._content[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes) -> Any | None:
        slot = self._slot(key)
        return self._content[slot][1] if slot >= 0 else None

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self._marks[slot], self._content[slot] = 0, None
        self._size -= 1
        return True

    def insert(self, key: bytes, value: Any) -> None:
        """Add a key, or give a live one another value."""
        slot = self._slot(key)
        if slot >= 0:
            self._content[slot] = (key, value)
            return
        entry = (key, value)
        while entry is not None:
            entry = self._place(entry)
            if entry is not None:
                self._grow()
        self._size += 1

    def _place(self, entry: tuple[bytes, Any]) -> tuple[bytes, Any] | None:
        """Put an entry in one of its buckets, moving others on; the entry left over when no slot is found."""
        mark = self._mark(entry[0])
        bucket = int.from_bytes(entry[0][2:10], "little") & self._mask
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self._marks[slot]:
                    self._marks[slot], self._content[slot] = mark, entry
                    return None
        for move in range(MAX_MOVES):
            slot = bucket * SLOTS + (move + entry[0][10]) % SLOTS
            mark, self._marks[slot] = self._marks[slot], mark
            entry, self._content[slot] = self._content[slot], entry
            bucket = self._other(bucket, mark)
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self._marks[free]:
                    self._marks[free], self._content[free] = mark, entry
                    return None
        return entry

    def _grow(self) -> None:
        stored, buckets, size = list(self.items()), self._mask + 1, self._size
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(entry) is None for entry in stored):
                self._size = size
                return

    def items(self) -> Iterator[tuple[bytes, Any]]:
        return (c for c in self._content if c is not None)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key and code points of each row. The JVM reads, cuts and hashes the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, _BLANKS, ""), 256)).alias("key"),
        F.char_length(text).cast("long").alias("chars"),
    )


def _folded(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, chars, keep_id) to one row for each key; with a limit, to one or more of each."""
    index = CuckooIndex()
    for batch in batches:
        for key, n, chars, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = index.get(key)
            if seen is None:
                index.insert(key, [n, chars, doc_id])
                continue
            seen[0] += n
            if doc_id is not None and (seen[2] is None or (chars, -doc_id) > (seen[1], -seen[2])):
                seen[1:] = chars, doc_id
            elif doc_id is None and seen[2] is None:
                seen[1] = max(seen[1], chars)
        if limit and len(index) > limit:
            yield from _rows(index)
            index = CuckooIndex()
    yield from _rows(index)


def _rows(index: CuckooIndex, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = [(k, *v) for k, v in index.items()]
    for at in range(0, len(rows), size):
        key, n, chars, keep = zip(*rows[at : at + size], strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, chars, keep))], ["key", "n", "chars", "keep_id"]
        )


def classes(keys: DataFrame) -> DataFrame:
    """One row per distinct key: how many rows have it, and the doc_id that stays."""
    ones = keys.select("key", F.lit(1).cast("long").alias("n"), "chars", F.col("doc_id").alias("keep_id"))
    local = common.saved(ones.mapInArrow(common.tidy(lambda b: _folded(b, LOCAL_KEYS)), CLASSES), "local-keys")
    width = max(common.shuffle_width(keys.sparkSession), -(-local.count() // ROWS_EACH))
    return local.repartition(width, "key").mapInArrow(common.tidy(lambda b: _folded(b, None)), CLASSES)


def live(changes: DataFrame) -> DataFrame:
    """Replay a log of changes (seq, action ``insert`` or ``delete``, doc_id, text) and return the keys alive at its end.

    A change reaches the partition of its key and document, so the log of a
    text that many documents share is spread; within it the index applies
    changes in order of seq. A deletion of what is not alive does nothing.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for action, own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if action == "delete":
                    index.delete(own)
                elif action == "insert":
                    index.insert(own, row)
        rows = [v for _, v in index.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["doc_id", "key", "chars"]
        )

    rows = keyed(changes.select("doc_id", "text")).columns
    text = F.coalesce(F.col("text"), F.lit(""))
    log = changes.select(
        "seq",
        "action",
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, _BLANKS, ""), 256)).alias("key"),
        F.char_length(text).cast("long").alias("chars"),
    ).withColumn("own", F.unhex(F.sha2(F.concat(F.col("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 256)))
    width = common.shuffle_width(changes.sparkSession)
    dealt = log.repartition(width, "own").sortWithinPartitions("seq").select("action", "own", *rows)
    return dealt.mapInArrow(replay, "doc_id long, key binary, chars long")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = common.saved(keyed(docs, id_col, text_col), "keys")
    found = common.saved(classes(keys).select("key", "keep_id", F.col("n").alias("group_size")), "classes")
    return keys.join(found, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    keys = common.saved(keyed(docs, id_col, text_col), "keys")
    stay = common.saved(classes(keys).select("keep_id", "key", "chars"), "classes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_id, of_key, of_chars = (common.free(c, docs) for c in ("id", "key", "chars"))
    own = docs.withColumns({of_id: F.col(id_col).cast("long"), of_key: F.unhex(F.sha2(F.translate(text, _BLANKS, ""), 256)), of_chars: F.char_length(text).cast("long")})
    match = own[of_id].eqNullSafe(stay["keep_id"]) & (own[of_key] == stay["key"]) & (own[of_chars] == stay["chars"])
    kept = own.join(stay, match, "left_semi")
    # Rows that repeat id, key and length are copies of each other, but for the kind of white space. Texts travel once more only if there are any.
    again = keys.groupBy("doc_id", "key").count().where("count > 1")
    return (kept.dropDuplicates([of_id, of_key]) if again.limit(1).count() else kept).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT body, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -chars, b := doc_id)) AS keep_id
  FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g USING (body)
"""
