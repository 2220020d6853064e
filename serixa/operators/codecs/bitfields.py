"""Bit fields, least significant bit first, and the error of all codecs."""

from __future__ import annotations

import numpy as np

#: Error codes.
OK, DST, SRC, CRC, WEIGHT, ARG, INTERNAL = range(0, -7, -1)


class CodecError(ValueError):
    """A codec's failure, with its numeric code."""

    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


def pack_fields(values, widths) -> bytes:
    """All fields in turn; the last byte is padded with zeros."""
    values, widths = np.asarray(values, np.uint64), np.asarray(widths, np.int64)
    total = int(widths.sum())
    if not total:
        return b""
    owner = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths)
    return np.packbits((values[owner] >> place.astype(np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


class BitReader:
    """Fields of a byte string, from a bit position on."""

    def __init__(self, data: bytes, start: int = 0):
        self.data, self.at, self.end = data, start * 8, len(data) * 8

    def take(self, width: int) -> int:
        if self.at + width > self.end:
            raise CodecError(SRC, "bits run out")
        first, shift = self.at >> 3, self.at & 7
        self.at += width
        return int.from_bytes(self.data[first : (self.at + 7) >> 3], "little") >> shift & (1 << width) - 1

    def take_many(self, count: int, width: int) -> np.ndarray:
        """count fields of one width."""
        if not width or not count:
            return np.zeros(count, np.int64)
        if self.at + count * width > self.end:
            raise CodecError(SRC, "bits run out")
        first = self.at >> 3
        bits = np.unpackbits(np.frombuffer(self.data[first : (self.at + count * width + 7) >> 3], np.uint8), bitorder="little")
        bits = bits[self.at & 7 :][: count * width].reshape(count, width)
        self.at += count * width
        return bits @ (1 << np.arange(width, dtype=np.int64))
