"""The least string above all strings of a prefix."""

from __future__ import annotations


def successor(prefix: str) -> str | None:
    """By code points, which is the order of UTF-8 bytes; None if there is none."""
    points = [ord(c) for c in prefix]
    while points:
        last = points.pop()
        if last < 0x10FFFF:
            return "".join(map(chr, points)) + chr(0xE000 if last == 0xD7FF else last + 1)
    return None
