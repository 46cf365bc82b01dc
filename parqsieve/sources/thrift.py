"""Thrift's compact protocol, as far as Parquet's metadata uses it."""

from __future__ import annotations

import struct
from typing import Any

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    """Structs become dicts of field ids; what a field means is for the caller to know."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def struct(self) -> dict[int, Any]:
        out, field = {}, 0
        while head := self.byte():
            field = field + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            out[field] = kind == TRUE if kind in (TRUE, FALSE) else self.value(kind)
        return out

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def value(self, kind: int) -> Any:
        if kind in (TRUE, FALSE):  # an element of a list
            return self.byte() == TRUE
        if kind == BYTE:
            return struct.unpack("b", bytes([self.byte()]))[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise ValueError("a binary value goes beyond its end")
            return bytes(self.data[self.at - n : self.at])
        if kind in (LIST, SET):
            head = self.byte()
            n = self.varint() if head >> 4 == 15 else head >> 4
            return [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.byte() if n else 0
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"no kind of the compact protocol: {kind}")
