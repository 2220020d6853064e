"""Small-window LZ for series with plateaus."""

from __future__ import annotations

import struct

from .bitfields import ARG, SRC, CodecError

#: Marker, window, shortest and longest match, and how far a search goes.
MARK, WINDOW, SHORTEST, LONGEST, ENOUGH, STEPS, MOST, LEAST = 0xCB, 2048, 3, 258, 64, 128, 65536, 16
SLOTS, MULTIPLIER = 4096, 2654435761


def friendly(data: bytes) -> bool:
    """Whether 2 of 5 of the first samples repeat the one before."""
    if len(data) < 64:
        return False
    pairs = [data[i : i + 2] for i in range(0, min(len(data) - 1, 512), 2)]
    same = sum(a == b for a, b in zip(pairs, pairs[1:]))
    return len(pairs) > 1 and same * 5 >= (len(pairs) - 1) * 2


def encode(data: bytes) -> bytes:
    n = len(data)
    if not LEAST <= n <= MOST:
        raise CodecError(ARG, "length out of range")
    slots = [(int.from_bytes(data[i : i + 3], "little") * MULTIPLIER & 0xFFFFFFFF) >> 20 & SLOTS - 1 for i in range(n - 2)]
    newest: dict[int, int] = {}
    before = [-1] * n
    out = bytearray(struct.pack("<BI", MARK, n))
    at = literal = 0

    def literals(upto: int) -> None:
        for first in range(literal, upto, 127):
            run = data[first : min(first + 127, upto)]
            out.append(len(run))
            out.extend(run)

    while at < n:
        size, back = longest(data, at, newest.get(slots[at], -1) if at < len(slots) else -1, before)
        if size >= SHORTEST:
            literals(at)
            for done in range(0, size, 127):
                out.extend(struct.pack("<BH", 0x80 | min(127, size - done), back))
            literal = at + size
        for i in range(at, min(at + max(size, 1), len(slots))):
            before[i] = newest.get(slots[i], -1)
            newest[slots[i]] = i
        at += max(size, 1)
    literals(n)
    return bytes(out)


def longest(data: bytes, at: int, place: int, before: list[int]) -> tuple[int, int]:
    """(size, distance) of the first longest match among the latest places of a slot; size 0 if none is long enough."""
    best = (0, 0)
    most = min(LONGEST, len(data) - at)
    for _ in range(STEPS):
        if place < 0 or at - place > WINDOW:
            break
        if best[0] < most and data[place : place + best[0] + 1] == data[at : at + best[0] + 1]:
            size = best[0] + 1
            while size < most and data[place + size] == data[at + size]:
                size += 1
            if size >= SHORTEST:
                best = (size, at - place)
                if size >= ENOUGH:
                    break
        place = before[place]
    return best


def decode(payload: bytes) -> bytes:
    if len(payload) < 5 or payload[0] != MARK:
        raise CodecError(SRC, "no LZ block")
    (want,) = struct.unpack_from("<I", payload, 1)
    if not 0 < want <= MOST:
        raise CodecError(SRC, "length out of range")
    out, at = bytearray(), 5
    while len(out) < want:
        if at >= len(payload):
            raise CodecError(SRC, "tokens run out")
        size, copy = payload[at] & 127, payload[at] & 128
        at += 1
        if not size or len(out) + size > want or at + (2 if copy else size) > len(payload):
            raise CodecError(SRC, "bad token")
        if copy:
            back = int.from_bytes(payload[at : at + 2], "little")
            at += 2
            if not 0 < back <= len(out):
                raise CodecError(SRC, "bad distance")
            piece = out[-back:]  # may overlap what it makes
            out += (piece * (size // len(piece) + 1))[:size]
        else:
            out += payload[at : at + size]
            at += size
    return bytes(out)
