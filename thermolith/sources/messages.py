"""Messages with one tile each, to tiles.

``FAILFAST`` raises on the first malformed message; ``DROPMALFORMED`` leaves
malformed messages out. Empty and null payloads are malformed.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import msgpack, tiff

FIELDS = ("batch_id", "print_id", "tile_id", "layer", "tif")
TILES = "batch_id int, print_id string, tile_id int, layer int, height int, width int, pixels binary"
MODES = ("FAILFAST", "DROPMALFORMED")


class MessageError(ValueError):
    """A message that is no tile."""


def _integer(value: Any) -> int:
    """Whole numbers and their texts, within 32 bits; ``1.0`` is neither."""
    try:
        number = int(str(value))
    except ValueError as e:
        raise MessageError(f"{value!r} is no whole number") from e
    if not -(1 << 31) <= number < 1 << 31 or str(value).strip() != str(value) or "_" in str(value):
        raise MessageError(f"{value!r} is no 32-bit number")
    return number


def payload(value: Any) -> bytes:
    """Image bytes, or the bytes that a Base64 text stands for."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, str):
        try:
            return base64.b64decode(value, validate=True)
        except binascii.Error as e:
            raise MessageError("image is no Base64") from e
    raise MessageError(f"image of type {type(value).__name__}")


def read_message(data: bytes | None) -> tuple[int, str, int, int, np.ndarray]:
    """batch_id, print_id, tile_id, layer and the temperatures of a message. Other keys are ignored."""
    if not data:
        raise MessageError("empty message")
    try:
        record = msgpack.unpack(data)
    except msgpack.MessagePackError as e:
        raise MessageError(f"no MessagePack: {e}") from e
    if not isinstance(record, dict):
        raise MessageError("message is no map")
    for f in FIELDS:
        if record.get(f) is None:
            raise MessageError(f"no field {f}")
    try:
        matrix = tiff.decode(payload(record["tif"]))
    except tiff.TiffError as e:
        raise MessageError(f"no TIFF: {e}") from e
    return _integer(record["batch_id"]), str(record["print_id"]), _integer(record["tile_id"]), _integer(record["layer"]), matrix


def write_message(batch_id: Any, print_id: str, tile_id: Any, layer: Any, matrix: np.ndarray, as_text: bool = False) -> bytes:
    image = tiff.encode(matrix)
    return msgpack.pack({"batch_id": batch_id, "print_id": print_id, "tile_id": tile_id, "layer": layer, "tif": base64.b64encode(image).decode() if as_text else image})


def decode_messages(messages: DataFrame, value_col: str = "value", mode: str = "FAILFAST") -> DataFrame:
    """Tiles with packed pixels from a column of messages; works on streams too."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(0):
                try:
                    b, p, t, layer, m = read_message(value.as_py())
                except MessageError:
                    if mode == "FAILFAST":
                        raise
                    continue
                rows.append((b, p, t, layer, *m.shape, m.tobytes()))
            names = [f.split()[0] for f in TILES.split(", ")]
            kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
            types = [kinds[f.split()[1]] for f in TILES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return messages.select(value_col).mapInArrow(decode, TILES)


def encode_messages(packed: DataFrame, as_text: bool = False) -> DataFrame:
    """Messages from packed tiles."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                write_message(r["batch_id"], r["print_id"], r["tile_id"], r["layer"], np.frombuffer(r["pixels"], "<u2").reshape(r["height"], r["width"]), as_text)
                for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return packed.select("batch_id", "print_id", "tile_id", "layer", "height", "width", "pixels").mapInArrow(encode, "value binary")
