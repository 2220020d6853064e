"""Two-bit bases, and sequencing reads in four-line records."""

from __future__ import annotations

import struct

import numpy as np

from .bitfields import ARG, SRC, CodecError

BASES = b"ACGT"
_CODE = np.full(256, 255, np.uint8)
_CODE[list(BASES)] = range(4)


def pack_bases(bases: bytes) -> bytes:
    """Four to a byte, the first lowest."""
    codes = _CODE[np.frombuffer(bases, np.uint8)]
    if (codes == 255).any():
        raise CodecError(ARG, "a byte is none of A, C, G and T")
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    return (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def unpack_bases(packed: bytes, count: int) -> bytes:
    codes = (np.frombuffer(packed, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.frombuffer(BASES, np.uint8)[codes.ravel()[:count]].tobytes()


def dna2_encode(bases: bytes) -> bytes:
    return struct.pack("<I", len(bases)) + pack_bases(bases)


def dna2_decode(payload: bytes) -> bytes:
    if len(payload) < 4:
        raise CodecError(SRC, "truncated header")
    (n,) = struct.unpack_from("<I", payload)
    if len(payload) != 4 + -(-n // 4):
        raise CodecError(SRC, "lengths differ")
    return unpack_bases(payload[4:], n)


def fastq4_encode(text: bytes) -> bytes:
    """Header and plus lines as they are, bases packed, qualities as they are."""
    if b"\r" in text or text and not text.endswith(b"\n"):
        raise CodecError(SRC, "every line ends in one line feed")
    lines = text.split(b"\n")[:-1] if text else []
    if len(lines) % 4:
        raise CodecError(SRC, "records have four lines")
    out = [struct.pack("<II", len(text), len(lines) // 4)]
    for head, bases, plus, quality in zip(*(lines[i::4] for i in range(4))):
        if not head.startswith(b"@") or not plus.startswith(b"+") or len(bases) != len(quality) or max(len(head), len(plus)) > 65535:
            raise CodecError(SRC, "malformed record")
        out += [struct.pack("<H", len(head)), head, struct.pack("<I", len(bases)), pack_bases(bases), struct.pack("<H", len(plus)), plus, quality]
    return b"".join(out)


def fastq4_decode(payload: bytes) -> bytes:
    at, out = 8, []

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(payload):
            raise CodecError(SRC, "truncated record")
        at += n
        return payload[at - n : at]

    if len(payload) < 8:
        raise CodecError(SRC, "truncated header")
    size, records = struct.unpack_from("<II", payload)
    for _ in range(records):
        head = take(int.from_bytes(take(2), "little"))
        n = int.from_bytes(take(4), "little")
        bases = unpack_bases(take(-(-n // 4)), n)
        plus = take(int.from_bytes(take(2), "little"))
        out += [head, bases, plus, take(n)]
    text = b"".join(x + b"\n" for x in out)
    if at != len(payload) or len(text) != size:
        raise CodecError(SRC, "lengths differ")
    return text
