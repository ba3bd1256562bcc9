"""TIFF images of one grey band of 8 or 16 bits (the first of several is read), in strips or tiles.

Strips and tiles may be plain or compressed by PackBits, LZW or Deflate, and
rows may be stored as differences.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Tags of the format, bytes and layout of its field types, its compressions, and the codes of its LZW.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _BANDS, _ROWS, _COUNTS, _PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
_PREDICTOR, _TILE_WIDTH, _TILE_HEIGHT, _TILE_OFFSETS, _TILE_COUNTS = 317, 322, 323, 324, 325
_FIELD = {1: "B", 3: "H", 4: "I"}
_PLAIN, _LZW, _DEFLATE, _OLD_DEFLATE, _PACKBITS = 1, 5, 8, 32946, 32773
_CLEAR, _END, _FIRST_FREE, _LEAST_BITS, _MOST_BITS = 256, 257, 258, 9, 12
_DIFFERENCES = 2


class TiffError(ValueError):
    """Bytes that are no readable TIFF."""


def _directory(data: bytes) -> tuple[str, dict[int, list[int]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF header")
    try:
        (at,) = struct.unpack(order + "I", data[4:8])
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for i in range(n):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if kind not in _FIELD:
                continue
            size = struct.calcsize("=" + _FIELD[kind]) * count
            where = struct.unpack(order + "I", entry[8:])[0] if size > 4 else None
            body = data[where : where + size] if where is not None else entry[8 : 8 + size]
            tags[tag] = list(struct.unpack(f"{order}{count}{_FIELD[kind]}", body))
    except struct.error as e:
        raise TiffError("directory is cut off") from e
    return order, tags


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count below 128 copies bytes, one above repeats the next byte."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, highest bit first, that grow one code early."""
    out, table, width, before = bytearray(), {}, _LEAST_BITS, b""
    held = bits = 0
    free = _FIRST_FREE
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, free, width, before = {}, _FIRST_FREE, _LEAST_BITS, b""
            continue
        if code < _CLEAR:
            entry = bytes((code,))
        elif code in table:
            entry = table[code]
        elif before and code == free:
            entry = before + before[:1]
        else:
            raise TiffError("damaged LZW data")
        out += entry
        if before:
            table[free] = before + entry[:1]
            free += 1
        before = entry
        width = min(_MOST_BITS, max(_LEAST_BITS, (free + 1).bit_length()))
    return bytes(out)


def _inflated(data: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(data)
    except zlib.error as e:
        raise TiffError("damaged Deflate data") from e


_UNPACK = {_PLAIN: bytes, _PACKBITS: unpacked_bits, _LZW: unpacked_lzw, _DEFLATE: _inflated, _OLD_DEFLATE: _inflated}


def decode(data: bytes) -> np.ndarray:
    """Unsigned 16-bit matrix (row, column)."""
    data = bytes(data)
    order, tags = _directory(data)
    tiled = _TILE_OFFSETS in tags
    try:
        width, height, bits = tags[_WIDTH][0], tags[_HEIGHT][0], tags[_BITS][0]
        offsets, counts = (tags[_TILE_OFFSETS], tags[_TILE_COUNTS]) if tiled else (tags[_OFFSETS], tags[_COUNTS])
        across, down = (tags[_TILE_WIDTH][0], tags[_TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(_ROWS, [height])[0]))
    except KeyError as e:
        raise TiffError(f"no tag {e}") from e
    bands, compression = tags.get(_BANDS, [1])[0], tags.get(_COMPRESSION, [_PLAIN])[0]
    if compression not in _UNPACK:
        raise TiffError(f"compression {compression} is not supported")
    if bits not in (8, 16):
        raise TiffError(f"{bits} bits are not supported")
    if not (width and height and across and down and bands):
        raise TiffError("image without pixels")
    if bands > 1 and tags.get(_PLANAR, [1])[0] == 2:
        bands = 1  # bands apart: the first one's blocks come first
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) < columns * rows or len(counts) < columns * rows:
        raise TiffError("image is cut off")
    kind = np.dtype(np.uint8 if bits == 8 else f"{order}u2")
    image = np.empty((height, width), "<u2")
    for block in range(columns * rows):
        y, x = block // columns * down, block % columns * across
        lines = down if tiled else min(down, height - y)
        raw = _UNPACK[compression](data[offsets[block] : offsets[block] + counts[block]])
        need = lines * across * bands
        if len(raw) < need * kind.itemsize:
            raise TiffError("image is cut off")
        values = np.frombuffer(raw, kind, need).reshape(lines, across, bands)
        if tags.get(_PREDICTOR, [1])[0] == _DIFFERENCES:
            values = np.cumsum(values, axis=1, dtype=np.uint8 if bits == 8 else np.uint16)
        part = image[y : y + lines, x : x + across]
        part[:] = values[: part.shape[0], : part.shape[1], 0]
    return image


def encode(matrix: np.ndarray, order: str = "<", strip_rows: int | None = None) -> bytes:
    """A one-band 16-bit file."""
    height, width = matrix.shape
    rows = strip_rows or height
    strips = [matrix[i : i + rows].astype(f"{order}u2").tobytes() for i in range(0, height, rows)]
    tags = {_WIDTH: [width], _HEIGHT: [height], _BITS: [16], _COMPRESSION: [1], _PHOTOMETRIC: [1], _OFFSETS: None, _BANDS: [1], _ROWS: [rows], _COUNTS: [len(s) for s in strips]}
    after = 8 + 2 + 12 * len(tags) + 4
    lists = 4 * len(strips) if len(strips) > 1 else 0
    start = after + 2 * lists
    tags[_OFFSETS] = [start + sum(map(len, strips[:i])) for i in range(len(strips))]
    entries, extra = b"", b""
    for tag, values in sorted(tags.items()):
        body = struct.pack(f"{order}{len(values)}I", *values)
        if len(body) > 4:
            body, extra = struct.pack(order + "I", after + len(extra)), extra + body
        entries += struct.pack(order + "HHI", tag, 4, len(values)) + body
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + extra + b"".join(strips)
