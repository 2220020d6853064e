"""Blocks of 8 residuals at their own width, and runs of zero blocks."""

from __future__ import annotations

import numpy as np

from .bitfields import SRC, BitReader, CodecError, pack_fields

BLOCK, RUN = 8, 256


def widths(z: np.ndarray) -> np.ndarray:
    """Bit width of each block's largest residual."""
    padded = np.zeros(-(-len(z) // BLOCK) * BLOCK, np.int64)
    padded[: len(z)] = z
    return np.frexp(padded.reshape(-1, BLOCK).max(axis=1, initial=0).astype(np.float64))[1].astype(np.int64)


def fields(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, widths) of the fields of a series, in order."""
    z = np.asarray(z, np.int64)
    if not len(z):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nb = widths(z)
    zero = nb == 0
    at = np.arange(len(nb))
    begins = zero & ~np.append(False, zero[:-1])
    start = np.maximum.accumulate(np.where(begins, at, 0))
    token = zero & ((at - start) % RUN == 0)
    ends = np.append(np.flatnonzero(~zero), len(nb))
    stop = ends[np.searchsorted(ends, at)]  # first block after the run
    extra = np.minimum(stop - at, RUN) - 1
    head = np.flatnonzero(token | ~zero)
    padded = np.zeros(len(nb) * BLOCK, np.int64)
    padded[: len(z)] = z
    # every block gets ten columns: width, extra run, and its 8 residuals; unused ones are 0 bits wide
    values = np.concatenate([nb[head, None], extra[head, None], padded.reshape(-1, BLOCK)[head]], axis=1)
    full = np.where(zero[head], 0, nb[head])[:, None]
    sizes = np.concatenate([np.full((len(head), 1), 5), np.where(zero[head], 8, 0)[:, None], np.repeat(full, BLOCK, axis=1)], axis=1)
    return values.ravel(), sizes.ravel()


def encode_tiles(z: np.ndarray, tile: int) -> list[bytes]:
    """encode() of each run of `tile` residuals, a multiple of the block, all at once."""
    z = np.asarray(z, np.int64)
    if not len(z):
        return []
    nb, per_tile = widths(z), tile // BLOCK
    at = np.arange(len(nb))
    owner = at // per_tile
    zero = nb == 0
    begins = zero & (~np.append(False, zero[:-1]) | (at % per_tile == 0))
    start = np.maximum.accumulate(np.where(begins, at, 0))
    token = zero & ((at - start) % RUN == 0)
    ends = np.append(np.flatnonzero(~zero), len(nb))
    stop = np.minimum(ends[np.searchsorted(ends, at)], (owner + 1) * per_tile)
    extra = np.minimum(stop - at, RUN) - 1
    head = np.flatnonzero(token | ~zero)
    padded = np.zeros(len(nb) * BLOCK, np.int64)
    padded[: len(z)] = z
    full = np.where(zero[head], 0, nb[head])[:, None]
    sizes = np.concatenate([np.full((len(head), 1), 5), np.where(zero[head], 8, 0)[:, None], np.repeat(full, BLOCK, axis=1), np.zeros((len(head), 1), np.int64)], axis=1)
    bits = np.bincount(owner[head], sizes.sum(axis=1)).astype(np.int64)
    last = np.append(np.flatnonzero(np.diff(owner[head])), len(head) - 1)
    sizes[last, -1] = -bits % 8  # each tile begins a byte
    values = np.concatenate([nb[head, None], extra[head, None], padded.reshape(-1, BLOCK)[head], np.zeros((len(head), 1), np.int64)], axis=1)
    packed = pack_fields(values.ravel(), sizes.ravel())
    bounds = np.append(0, np.cumsum(-(-bits // 8))).tolist()
    return [packed[a:b] for a, b in zip(bounds, bounds[1:])]


def encode(z: np.ndarray) -> bytes:
    return pack_fields(*fields(z))


def walk(data: bytes, at: int, end: int, blocks: int) -> tuple[list[int], list[int], list[int], int]:
    """(blocks with residuals, bit each one's residuals begin at, their widths, bit after the last); data has a byte more than end.

    A run that passes the last block is an error.
    """
    held, places, sizes = [], [], []
    done = 0
    while done < blocks:
        first = at >> 3
        if at + 5 > end:
            raise CodecError(SRC, "bits run out")
        nb = (data[first] | data[first + 1] << 8) >> (at & 7) & 31
        if nb:
            held.append(done)
            places.append(at + 5)
            sizes.append(nb)
            at += 5 + BLOCK * nb
            done += 1
            if nb > 16:
                raise CodecError(SRC, "block width over 16")
            if at > end:
                raise CodecError(SRC, "bits run out")
        else:
            if at + 13 > end:
                raise CodecError(SRC, "bits run out")
            done += (int.from_bytes(data[first : first + 3], "little") >> (at & 7) + 5 & 255) + 1
            at += 13
            if done > blocks:
                raise CodecError(SRC, "zero run passes the end")
    return held, places, sizes, at


def unpack(data: bytes, blocks: int, held: list[int], places: list[int], sizes: list[int]) -> np.ndarray:
    """Residuals of all blocks, those of one width at once."""
    out = np.zeros((blocks, BLOCK), np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    held, places, sizes = np.array(held, np.int64), np.array(places, np.int64), np.array(sizes, np.int64)
    for nb in np.flatnonzero(np.bincount(sizes, minlength=1)).tolist():
        own = np.flatnonzero(sizes == nb)
        out[held[own]] = bits[places[own, None] + np.arange(BLOCK * nb)].reshape(-1, BLOCK, nb) @ (1 << np.arange(nb, dtype=np.int64))
    return out.ravel()


def read_blocks(reader: BitReader, count: int) -> np.ndarray:
    """count residuals from where the reader stands."""
    blocks, begin = -(-count // BLOCK), reader.at >> 3
    held, places, sizes, at = walk(reader.data + b"\0", reader.at, reader.end, blocks)
    out = unpack(reader.data[begin : at + 7 >> 3], blocks, held, [p - 8 * begin for p in places], sizes)
    reader.at = at
    return out[:count]


def decode_tiles(tiles: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """decode() of each tile, all at once."""
    data, held, places, sizes, first, at = b"".join(tiles), [], [], [], [0], 0
    padded = data + b"\0"
    for tile, count in zip(tiles, counts):
        own, bits, widths_, _ = walk(padded, 8 * at, 8 * (at + len(tile)), -(-count // BLOCK))
        held += [first[-1] + h for h in own]
        places += bits
        sizes += widths_
        first.append(first[-1] - (-count // BLOCK))
        at += len(tile)
    out = unpack(data, first[-1], held, places, sizes)
    return [out[BLOCK * f : BLOCK * f + n] for f, n in zip(first, counts)]


def decode(data: bytes, count: int) -> np.ndarray:
    return read_blocks(BitReader(data), count)
