"""Variable-length integers and gap-coded posting lists, for size reports and exchange.

The index itself is Parquet, whose encodings play this part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(value: int) -> bytes:
    """Unsigned LEB128: seven bits a byte, the lowest first, the top bit set on all but the last."""
    if value < 0:
        raise ValueError("a varint is not negative")
    out = bytearray()
    while value > 127:
        out.append(128 | value & 127)
        value >>= 7
    return bytes([*out, value])


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, bytes read); -1 bytes if the data ends within the number."""
    value = 0
    for n, byte in enumerate(data[at : at + 10]):
        value |= (byte & 127) << 7 * n
        if byte < 128:
            return value, n + 1
    return 0, -1


def length(value: Column) -> Column:
    """Bytes of the varint of a column's value."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(value < 1 << 7 * n, n).otherwise(out)
    return out


def encode_postings(entries: list[tuple[int, int]]) -> bytes:
    """(doc_id, tf) in ascending doc_id order: their number, then gaps and frequencies."""
    out, last = [encode(len(entries))], 0
    for doc, tf in entries:
        out += [encode(doc - last), encode(tf)]
        last = doc
    return b"".join(out)


def decode_postings(data: bytes) -> list[tuple[int, int]]:
    numbers, at = [], 0
    while at < len(data):
        value, n = decode(data, at)
        if n < 0:
            raise ValueError("truncated posting list")
        numbers.append(value)
        at += n
    out, doc = [], 0
    for gap, tf in zip(numbers[1::2], numbers[2::2]):
        doc += gap
        out.append((doc, tf))
    return out
