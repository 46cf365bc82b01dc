"""Split-block bloom filters of Parquet: hashing literals and probing a block."""

from __future__ import annotations

import struct
from typing import Any

import xxhash

SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)  # fixed values of the Parquet format
BLOCK = 32


def hash_of(value: Any, physical: str) -> int | None:
    """The hash of a literal as the physical type stores it; None if the type can't be checked."""
    if value is None or isinstance(value, bool):
        return None
    try:
        if physical in ("INT32", "INT64"):
            if not isinstance(value, int):
                return None
            raw = struct.pack("<i" if physical == "INT32" else "<q", value)
        elif physical in ("FLOAT", "DOUBLE"):
            if not isinstance(value, int | float) or value == 0 or value != value:
                return None  # zeros of either sign are equal but differ in bytes
            raw = struct.pack("<f" if physical == "FLOAT" else "<d", value)
        elif physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
            raw = value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytes | bytearray) else None
            if raw is None:
                return None
        else:
            return None
    except (struct.error, OverflowError):
        return None
    return xxhash.xxh64_intdigest(raw)


def block_of(h: int, n_bytes: int) -> int:
    """The byte offset in the filter of the block that the hash belongs to."""
    return ((h >> 32) * (n_bytes // BLOCK) >> 32) * BLOCK


def in_block(h: int, block: bytes) -> bool:
    words, low = struct.unpack("<8I", block), h & 0xFFFFFFFF
    return all(word >> (low * salt % (1 << 32) >> 27) & 1 for word, salt in zip(words, SALT, strict=True))
