"""Adaptive range coding of bytes as two nibbles."""

from __future__ import annotations

from .bitfields import SRC, CodecError

#: Scale of the frequencies, step and limit of the counts, least range.
SCALE, STEP, LIMIT, LEAST = 256, 32, 16384, 1 << 24


class Model:
    """Counts of the high nibble, and of the low nibble after each high one."""

    def __init__(self):
        self.tables = [[1] * 16 for _ in range(17)]

    def copy(self) -> Model:
        twin = Model()
        twin.tables = [t[:] for t in self.tables]
        return twin

    def see(self, data: bytes) -> None:
        for b in data:
            self.count(self.tables[16], b >> 4)
            self.count(self.tables[b >> 4], b & 15)

    @staticmethod
    def count(table: list[int], nibble: int) -> None:
        table[nibble] += STEP
        if sum(table) > LIMIT:
            table[:] = [max(1, c >> 1) for c in table]

    @staticmethod
    def frequencies(table: list[int]) -> list[int]:
        """Frequencies that add up to SCALE, none 0; the largest takes what is missing."""
        shift = max(0, (sum(table) // SCALE).bit_length() - 1)
        while True:
            out = [(c >> shift) or 1 for c in table]
            total = sum(out)
            if total <= SCALE:
                out[out.index(max(out))] += SCALE - total
                return out
            shift += 1


def encode(model: Model, data: bytes) -> bytes:
    """The coded bytes; the model learns as it goes.

    low is one long number: carries need no care, and every renormalization is a
    shift of it.
    """
    low, span, shifts = 0, 0xFFFFFFFF, 0
    for b in data:
        for table, nibble in ((model.tables[16], b >> 4), (model.tables[b >> 4], b & 15)):
            freq = model.frequencies(table)
            unit = span >> 8
            low += unit * sum(freq[:nibble])
            span = unit * freq[nibble]
            while span < LEAST:
                low <<= 8
                span <<= 8
                shifts += 1
            model.count(table, nibble)
    return low.to_bytes(shifts + 5, "big")


def decode(model: Model, payload: bytes, count: int) -> bytes:
    code, at, span, out = int.from_bytes(payload[:5].ljust(5, b"\0"), "big"), 5, 0xFFFFFFFF, bytearray()
    for _ in range(count):
        byte, table = 0, model.tables[16]
        for half in range(2):
            freq = model.frequencies(table)
            unit = span >> 8
            goal, low, nibble = code // unit, 0, 0
            while nibble < 16 and goal >= low + freq[nibble]:
                low += freq[nibble]
                nibble += 1
            if nibble == 16:
                raise CodecError(SRC, "no such symbol")
            code -= unit * low
            span = unit * freq[nibble]
            while span < LEAST:
                code = code << 8 | (payload[at] if at < len(payload) else 0)
                at += 1
                span <<= 8
            model.count(table, nibble)
            byte = byte << 4 | nibble
            table = model.tables[nibble] if half == 0 else table
        out.append(byte)
    return bytes(out)
