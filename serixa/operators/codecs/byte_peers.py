"""General byte codecs that reports compare with: a windowed LZ of bits, and library block codecs.

The windowed form is a stream of bits, highest first: 1 and eight bits of a literal, or 0,
the distance less one and the length less one.  Text before the first byte counts as zeros.
Library blocks don't tell their length, so a length goes before them in `packed` forms.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa

from .bitfields import CodecError

#: Bits of a distance and of a length.
WINDOW_BITS, LENGTH_BITS = 8, 4
#: Fixed value: matches of fewer bytes take more bits than their literals.
SHORTEST = (1 + WINDOW_BITS + LENGTH_BITS) // 8 + 1


def windowed_encode(data: bytes) -> bytes:
    """Greedy parsing: at each place the longest match within the window, if it is worth its bits."""
    window, longest = 1 << WINDOW_BITS, 1 << LENGTH_BITS
    text = bytes(window) + data
    at, end = window, len(text)
    out, held, bits = bytearray(), 0, 0
    while at < end:
        most, size, place = min(longest, end - at), 0, -1
        while size < most:
            found = text.rfind(text[at : at + size + 1], at - window, at + size)
            if found < 0:
                break
            place, size = found, size + 1
            while size < most and text[place + size] == text[at + size]:
                size += 1
        if size >= SHORTEST:
            held, bits = held << 13 | (at - place - 1) << LENGTH_BITS | size - 1, bits + 13
            at += size
        else:
            held, bits = held << 9 | 0x100 | text[at], bits + 9
            at += 1
        if bits >= 1024:
            out += (held >> bits % 8).to_bytes(bits // 8, "big")
            held, bits = held & (1 << bits % 8) - 1, bits % 8
    return bytes(out) + (held << -bits % 8).to_bytes(-(-bits // 8), "big")


def windowed_decode(payload: bytes) -> bytes:
    """What is left of a last byte, fewer bits than any token has, is padding."""
    out = bytearray(1 << WINDOW_BITS)
    place, size = 0, 8 * len(payload)
    while place + 9 <= size:
        word = int.from_bytes(payload[place // 8 : place // 8 + 3].ljust(3, b"\0"), "big") << place % 8
        if word >> 23 & 1:
            out.append(word >> 15 & 255)
            place += 9
            continue
        if place + 13 > size:
            break
        back, count = (word >> 15 & 255) + 1, (word >> 11 & 15) + 1
        for _ in range(count):
            out.append(out[-back])
        place += 13
    return bytes(out[1 << WINDOW_BITS :])


def _block(name: str) -> tuple:
    """(encode, decode) of a library's blocks with their length in front, which the reports don't count."""

    def encode(data: bytes) -> bytes:
        return struct.pack("<Q", len(data)) + (pa.Codec(name).compress(data, asbytes=True) if data else b"")

    def decode(payload: bytes) -> bytes:
        if len(payload) < 8:
            raise CodecError(-3, "truncated length")
        (size,) = struct.unpack_from("<Q", payload)
        if size > 255 * 1024 * max(len(payload) - 8, 0):
            raise CodecError(-3, "a length that no block reaches")
        try:
            return pa.Codec(name).decompress(payload[8:], decompressed_size=size, asbytes=True) if size else b""
        except OSError as problem:
            raise CodecError(-3, str(problem)) from None

    return encode, decode


def inflate(payload: bytes) -> bytes:
    try:
        return zlib.decompress(payload)
    except zlib.error as problem:
        raise CodecError(-3, str(problem)) from None


#: Bytes in front of a codec's blocks that are none of theirs.
FRONT = {"lz4": 8, "zstd": 8}
BYTE_PEERS = {
    "windowed": (windowed_encode, windowed_decode),
    "lz4": _block("lz4_raw"),
    "deflate": (lambda data: zlib.compress(data, 6), inflate),
    "zstd": _block("zstd"),
}
