"""Length-delimited binary token records with a separate offset index.

A record file holds, for each document in ascending id order::

    length      unsigned 64 bit, bytes of the payload
    masked crc  unsigned 32 bit, of the eight length bytes
    payload     has_id (1 byte), doc_id (signed 64 bit), width (1 byte), the ids
    masked crc  unsigned 32 bit, of the payload

All numbers are little-endian. Ids take two bytes each where the vocabulary
allows, else four. A checksum is masked by rotating it right by 15 bits and
adding a constant, so that a checksum of data that holds checksums stays
sound. Beside ``part-N.rec`` lies ``part-N.idx`` with one fixed-size entry for
each record (offset, payload bytes, ids), for readers that shuffle.

Cases: a null text is an empty one (its record holds the end id alone); a null
doc_id sorts first and is kept as null; repeated rows give repeated records;
texts of any length are encoded whole; an empty table gives no files and no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

_MASK_DELTA = 0xA282EAD8
_HEAD, _BODY, _TAIL, _ENTRY = "<QI", "<BqB", "<I", "<QQQ"
_HEAD_BYTES, _TAIL_BYTES, _ENTRY_BYTES = 12, 4, 24

FILES = "file int, path string, docs long, tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One document's record."""
    payload = struct.pack(_BODY, doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(_TAIL, masked_crc(size)) + payload + struct.pack(_TAIL, masked_crc(payload))


def unframe(read) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a file, from a function that returns its next n bytes. Raises ValueError on damage."""
    while head := read(_HEAD_BYTES):
        if len(head) < _HEAD_BYTES:
            raise ValueError("record file ends inside a length")
        size, crc = struct.unpack(_HEAD, head)
        if masked_crc(head[:8]) != crc:
            raise ValueError("damaged record length")
        payload = read(size)
        tail = read(_TAIL_BYTES)
        if len(payload) < size or len(tail) < _TAIL_BYTES:
            raise ValueError("record file ends inside a record")
        if masked_crc(payload) != struct.unpack(_TAIL, tail)[0]:
            raise ValueError("damaged record")
        has_id, doc_id, width = struct.unpack_from(_BODY, payload)
        yield (doc_id if has_id else None), np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(_BODY))


def _filesystem(uri: str):
    """Any store that pyarrow knows: file, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _moved(store, scratch: str, final: str) -> None:
    """Give a file its final name, also where an earlier attempt of the same task has left one."""
    from pyarrow import fs

    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(scratch, final)


def read_entry(path: str, at: int) -> tuple[int | None, np.ndarray]:
    """The record number ``at`` of a file, found through its index without reading what stands before it."""
    store, where = _filesystem(path)
    with store.open_input_file(where.removesuffix(".rec") + ".idx") as f:
        f.seek(at * _ENTRY_BYTES)
        offset, _, _ = struct.unpack(_ENTRY, f.read(_ENTRY_BYTES))
    with store.open_input_file(where) as f:
        f.seek(offset)
        return next(unframe(f.read))


def write_records(
    docs: DataFrame,
    out_dir: str,
    vocabulary: str | None = None,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every text, append ``end_id`` and write record files in ascending id order; one row per file.

    Raw texts are dealt by range of id first and encoded after, so that the
    sampling pass of the range exchange reads two columns and encodes nothing.
    A task writes under a name of its own attempt and renames at its end: a
    lost executor or a second attempt leaves no half file under a final name.
    """
    vocabulary = vocabulary or tokens.default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, store, final, scratch = task.partitionId(), None, "", ""
        rec = idx = None
        n_docs = n_tokens = at = 0
        enc = tokens.encoder(vocabulary)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if rec is None:
                    store, folder = _filesystem(out_dir)
                    store.create_dir(folder, recursive=True)
                    final = f"{folder}/part-{number:05d}"
                    scratch = f"{folder}/_attempt-{task.taskAttemptId()}-{number:05d}"
                    rec, idx = store.open_output_stream(scratch + ".rec"), store.open_output_stream(scratch + ".idx")
                ids = np.append(np.frombuffer(enc.encode(text.as_py() or ""), dtype="<u4"), np.uint32(end_id))
                data = frame(doc_id, ids, width)
                rec.write(data)
                idx.write(struct.pack(_ENTRY, at, len(data) - _HEAD_BYTES - _TAIL_BYTES, len(ids)))
                at += len(data)
                n_docs += 1
                n_tokens += len(ids)
        if rec is not None:
            rec.close()
            idx.close()
            for kind in (".idx", ".rec"):
                _moved(store, scratch + kind, final + kind)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([number], pa.int32()),
                    "path": [f"{out_dir}/part-{number:05d}.rec"],
                    "docs": [n_docs],
                    "tokens": [n_tokens],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(common.shuffle_width(docs.sparkSession), "id").sortWithinPartitions("id")
    return common.saved(dealt.mapInArrow(common.tidy(write), FILES), "record-files")


def read_records(files: DataFrame) -> DataFrame:
    """One row per document from the files that ``write_records`` lists: id, ids before it, ids, crc32 of the ids."""
    # One row per file, so the running total over files is small however many documents there are.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = _filesystem(path)
                out: list[tuple] = []
                with store.open_input_stream(where, buffer_size=1 << 20) as f:
                    for doc_id, ids in unframe(f.read):
                        out.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(out) == 10_000:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    spread = files.withColumn("base", before).select("path", "base").repartition(common.shuffle_width(files.sparkSession), "path")
    return spread.mapInArrow(read, DOCS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_records(write_records(docs, common.fresh_dir(spark, "records")))
