"""Residuals of byte buffers, forward and back, with state between chunks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Frontends.
NONE, I16, TICK8, FIRE, DELTA = range(5)
FULL_GAIN = 256


def wrap16(x):
    return ((x + 32768) & 65535) - 32768


def zigzag(d, bits: int = 16):
    return ((d << 1) ^ (d >> (bits - 1))) & ((1 << bits) - 1)


def unzigzag(u):
    return (u >> 1) ^ -(u & 1)


def samples(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2", len(data) // 2).astype(np.int64)


def to_bytes(x: np.ndarray) -> bytes:
    return (x & 65535).astype("<u2").tobytes()


@dataclass
class State:
    """What a predictor remembers: the last two samples and the gain, or the last tick."""

    last: int = 0
    older: int = 0
    gain: int = FULL_GAIN
    ts: int = 0
    px: int = 0

    def forward(self, frontend: int, data: bytes) -> bytes:
        """Residual bytes of the next bytes; what doesn't fill a sample stays as it is."""
        if frontend in (I16, DELTA):
            x = samples(data)
            z = zigzag(wrap16(np.diff(x, prepend=self.last)))
            self.last = int(x[-1]) if len(x) else self.last
            return to_bytes(z) + data[2 * len(x) :]
        if frontend == FIRE:
            x = samples(data)
            return to_bytes(zigzag(np.array(self.learn(x.tolist(), True), np.int64))) + data[2 * len(x) :]
        if frontend == TICK8:
            n = len(data) // 8
            rows = np.frombuffer(data, "<u4", 2 * n).reshape(n, 2).astype(np.int64)
            steps = np.diff(rows, axis=0, prepend=[[self.ts, self.px]])
            steps = ((steps + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
            if n:
                self.ts, self.px = rows[-1].tolist()
            return zigzag(steps, 32).astype("<u4").tobytes() + data[8 * n :]
        return data

    def inverse(self, frontend: int, data: bytes) -> bytes:
        if frontend in (I16, DELTA):
            z = np.frombuffer(data, "<u2", len(data) // 2).astype(np.int64)
            x = wrap16(self.last + np.cumsum(unzigzag(z)))
            self.last = int(x[-1]) if len(x) else self.last
            return to_bytes(x) + data[2 * len(x) :]
        if frontend == FIRE:
            z = np.frombuffer(data, "<u2", len(data) // 2).astype(np.int64)
            return to_bytes(np.array(self.learn(unzigzag(z).tolist(), False), np.int64)) + data[2 * len(z) :]
        if frontend == TICK8:
            n = len(data) // 8
            rows = unzigzag(np.frombuffer(data, "<u4", 2 * n).reshape(n, 2).astype(np.int64))
            rows = (np.array([self.ts, self.px]) + np.cumsum(rows, axis=0)) & 0xFFFFFFFF
            if n:
                self.ts, self.px = rows[-1].tolist()
            return rows.astype("<u4").tobytes() + data[8 * n :]
        return data

    def learn(self, values: list[int], forward: bool) -> list[int]:
        """Errors of samples, or samples of errors, by a slope whose gain follows its success."""
        p, q, gain, out = self.last, self.older, self.gain, []
        for v in values:
            slope = p - q
            guess = p + ((slope * gain) >> 8)
            guess = -32768 if guess < -32768 else 32767 if guess > 32767 else guess
            if forward:
                x, e = v, ((v - guess + 32768) & 65535) - 32768
                out.append(e)
            else:
                x, e = ((guess + v + 32768) & 65535) - 32768, v
                out.append(x)
            if slope and e:
                gain = min(FULL_GAIN, gain + 1) if (slope > 0) == (e > 0) else max(0, gain - 1)
            q, p = p, x
        self.last, self.older, self.gain = p, q, gain
        return out


def fire_many(offsets: np.ndarray, values: np.ndarray, forward: bool) -> np.ndarray:
    """State.learn over many series at once, one sample of each at a time, longest series first."""
    offsets = offsets.astype(np.int64)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start = offsets[:-1][order]
    size = size[order]
    out = np.zeros(len(values), np.int64)
    values = values.astype(np.int64)
    p, q, gain = (np.zeros(len(size), np.int64) for _ in range(3))
    gain += FULL_GAIN
    live = len(size)
    for t in range(int(size.max(initial=0))):
        while live and size[live - 1] <= t:
            live -= 1
        at = start[:live] + t
        v, slope = values[at], p[:live] - q[:live]
        guess = np.clip(p[:live] + ((slope * gain[:live]) >> 8), -32768, 32767)
        x, e = (v, wrap16(v - guess)) if forward else (wrap16(guess + v), v)
        out[at] = e if forward else x
        moved = (slope != 0) & (e != 0)
        gain[:live] += np.where(moved, np.where((slope > 0) == (e > 0), 1, -1), 0)
        np.clip(gain[:live], 0, FULL_GAIN, out=gain[:live])
        q[:live], p[:live] = p[:live].copy(), x
    return out
