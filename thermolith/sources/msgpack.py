"""A MessagePack codec for plain values: nil, booleans, numbers, strings, bytes, lists and maps."""

from __future__ import annotations

import struct
from typing import Any

# Type bytes of the format, with the layout of what follows them.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {
    0xC4: (">B", "bytes"), 0xC5: (">H", "bytes"), 0xC6: (">I", "bytes"),
    0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"),
    0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map"),
    0xC7: (">B", "ext"), 0xC8: (">H", "ext"), 0xC9: (">I", "ext"),
}
_CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}
_FIXED_EXT = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}


class MessagePackError(ValueError):
    """Bytes that are no MessagePack value."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise MessagePackError("value ends too early")
        self.at += n
        return part

    def number(self, layout: str) -> Any:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def body(self, kind: str, n: int) -> Any:
        if kind == "bytes":
            return self.take(n)
        if kind == "str":
            return self.take(n).decode("utf-8")
        if kind == "list":
            return [self.value() for _ in range(n)]
        if kind == "map":
            return {k if isinstance(k := self.value(), (str, int, bytes, bool, float, type(None))) else repr(k): self.value() for _ in range(n)}
        return self.take(n + 1)[1:]

    def value(self) -> Any:
        b = self.take(1)[0]
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return self.body("map", b & 0x0F)
        if b < 0xA0:
            return self.body("list", b & 0x0F)
        if b < 0xC0:
            return self.body("str", b & 0x1F)
        if b in _CONSTANTS:
            return _CONSTANTS[b]
        if b in _NUMBERS:
            return self.number(_NUMBERS[b])
        if b in _LENGTHS:
            layout, kind = _LENGTHS[b]
            return self.body(kind, self.number(layout))
        if b in _FIXED_EXT:
            return self.body("ext", _FIXED_EXT[b])
        raise MessagePackError(f"unknown type byte {b:#x}")


def unpack(data: bytes) -> Any:
    """The one value that ``data`` holds."""
    reader = _Reader(bytes(data))
    try:
        value = reader.value()
    except (UnicodeDecodeError, RecursionError) as e:
        raise MessagePackError(str(e)) from e
    if reader.at != len(reader.data):
        raise MessagePackError("bytes after the value")
    return value


def _head(n: int, short: tuple[int, int] | None, kind: str) -> bytes:
    if short and n < short[1]:
        return bytes([short[0] | n])
    for code, (layout, name) in _LENGTHS.items():
        if name == kind and n < 256 ** struct.calcsize(layout):
            return bytes([code]) + struct.pack(layout, n)
    raise MessagePackError(f"{kind} of {n} is too long")


def pack(value: Any) -> bytes:
    """The shortest form of a value."""
    for code, constant in _CONSTANTS.items():
        if value is constant:
            return bytes([code])
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack("b", value) if value < 0 else bytes([value])
        for code in (0xCC, 0xCD, 0xCE, 0xCF) if value > 0 else (0xD0, 0xD1, 0xD2, 0xD3):
            try:
                return bytes([code]) + struct.pack(_NUMBERS[code], value)
            except struct.error:
                continue
        raise MessagePackError("number out of range")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        return _head(len(data), (0xA0, 32), "str") + data
    if isinstance(value, (bytes, bytearray, memoryview)):
        return _head(len(value), None, "bytes") + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(len(value), (0x90, 16), "list") + b"".join(map(pack, value))
    if isinstance(value, dict):
        return _head(len(value), (0x80, 16), "map") + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise MessagePackError(f"cannot pack {type(value).__name__}")
