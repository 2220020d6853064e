"""Synthetic corpora from fixed seeds, as bytes, and as rows where they need no sequence."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_LINE = "sensor;id=12;temp=21.50;ok\n"
#: Amplitude, frequency and phase of the joints.
JOINTS = [(4500, 0.35, 0.0), (3200, 0.55, 0.7), (2800, 0.40, 1.2), (2100, 0.70, 2.1), (1500, 0.90, 0.3), (900, 1.10, 1.8), (600, 1.40, 2.6)]


#: Factor and addend of the congruential generator, seeds, start values and spreads of the corpora.
FACTOR, ADDEND = 1664525, 1013904223
SERIES_SEED, SERIES_DECAY, SERIES_SIGMA = 7, 0.97, 90.0
TICK_SEED, TICK_START, TICK_PRICE, TICK_SIGMA = 13, 1_700_000_000, 10_000, 4.0
NOISE_SEED = 99


class Lcg:
    """Linear congruential numbers of 32 bits, uniform and Gaussian draws."""

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> int:
        self.state = (self.state * FACTOR + ADDEND) & 0xFFFFFFFF
        return self.state

    def uniform(self) -> float:
        return (self.next() >> 8) / 16777216.0

    def gauss(self, sigma: float) -> float:
        u = 0.0
        while u <= 1e-12:
            u = self.uniform()
        return sigma * math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * self.uniform())


def half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def timeseries(count: int = 80_000) -> bytes:
    draw, x, out = Lcg(SERIES_SEED), 0.0, []
    for _ in range(count):
        x = SERIES_DECAY * x + draw.gauss(SERIES_SIGMA)
        out.append(max(-32767, min(32767, half_away(x))))
    return np.array(out, "<i2").tobytes()


def ticks(count: int = 18_000) -> bytes:
    draw, ts, px, out = Lcg(TICK_SEED), TICK_START, TICK_PRICE, []
    for _ in range(count):
        ts += 1 + draw.next() % 5
        px += half_away(draw.gauss(TICK_SIGMA))
        out.append(struct.pack("<Ii", ts, px))
    return b"".join(out)


def harness128() -> bytes:
    return bytes(3 * i & 255 for i in range(128))


def logline(n: int = 16_384) -> bytes:
    return (LOG_LINE * (n // len(LOG_LINE) + 1)).encode()[:n]


def noise(n: int = 16_384) -> bytes:
    draw = Lcg(NOISE_SEED)
    return bytes(draw.next() >> 16 & 255 for _ in range(n))


def ramp(count: int = 1024) -> bytes:
    """x = 3 x / 4 (truncated) + k % 9 - 4."""
    x, out = 0, []
    for k in range(count):
        y = 3 * x
        x = (abs(y) // 4) * (1 if y >= 0 else -1) + k % 9 - 4
        out.append(x)
    return np.array(out, "<i2").tobytes()


def joints(hz: int = 1000, seconds: int = 10, axes: int = 7) -> bytes:
    i = np.arange(hz * seconds)
    rows = []
    for a, (amplitude, frequency, phase) in enumerate(JOINTS[:axes]):
        wave = np.rint([amplitude * math.sin(2 * math.pi * frequency * (k / float(hz)) + phase) for k in i.tolist()]).astype(np.int64)
        rows.append(np.clip(wave + (17 * i + 31 * a) % 5 - 2, -32768, 32767))
    return np.concatenate(rows).astype("<i2").tobytes()


CORPORA = {
    "harness128": harness128,
    "timeseries_i16": timeseries,
    "timeseries_16k": lambda: timeseries(8192),
    "ticks": ticks,
    "ticks_16k": lambda: ticks(2048),
    "logline_16k": logline,
    "random_16k": noise,
    "joint_7axis_1khz_10s": joints,
}


def joint_rows(spark: SparkSession, hz: int = 1000, seconds: int = 10) -> DataFrame:
    """(axis, i, x) of the joints, made in parallel."""
    table = F.array(*(F.struct(F.lit(float(a)).alias("amp"), F.lit(f).alias("freq"), F.lit(p).alias("phase")) for a, f, p in JOINTS))
    n = hz * seconds
    rows = spark.range(len(JOINTS) * n).select(F.floor(F.col("id") / n).cast("int").alias("axis"), (F.col("id") % n).alias("i"))
    joint = F.element_at(table, F.col("axis") + 1)
    wave = F.rint(joint["amp"] * F.sin(2 * math.pi * joint["freq"] * (F.col("i") / float(hz)) + joint["phase"]))
    return rows.select("axis", "i", (wave.cast("long") + (17 * F.col("i") + 31 * F.col("axis")) % 5 - 2).alias("x"))


def harness_rows(spark: SparkSession) -> DataFrame:
    return spark.range(128).select(F.col("id").alias("i"), (F.col("id") * 3).bitwiseAND(F.lit(255)).alias("b"))


def logline_rows(spark: SparkSession, n: int = 16_384) -> DataFrame:
    at = (F.col("id") % len(LOG_LINE)).cast("int") + 1
    return spark.range(n).select(F.col("id").alias("i"), F.ascii(F.substring(F.lit(LOG_LINE), at, F.lit(1))).cast("long").alias("b"))


def corpus_rows(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(corpus, data) of the named corpora, each made by the task that holds its row."""
    names = list(names or CORPORA)
    make = F.udf(lambda name: bytearray(CORPORA[name]()), "binary")
    return spark.createDataFrame([(n,) for n in names], "corpus string").repartition(len(names), "corpus").select("corpus", make("corpus").alias("data"))
