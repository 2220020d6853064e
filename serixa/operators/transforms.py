"""Residual transforms of series as windows and folds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions import bits


def along() -> WindowSpec:
    return W.partitionBy("series_id").orderBy("idx")


def so_far() -> WindowSpec:
    return along().rowsBetween(W.unboundedPreceding, 0)


def delta(series: DataFrame) -> DataFrame:
    """d, the wrapped step from the sample before (0 at first), and z, its zigzag."""
    step = bits.wrap16(F.col("x") - F.lag("x", 1, 0).over(along()))
    return series.withColumn("d", step).withColumn("z", bits.zigzag16(F.col("d")))


def delta_by_segment(series: DataFrame, size: int = 1 << 16) -> DataFrame:
    """delta() of series that carry their idx, cut into segments: a long series is many tasks.

    The last sample of each segment is handed to the next, so the cut changes nothing.
    """
    cut = F.floor(F.col("idx") / size)
    rows = series.withColumn("segment", cut).withColumn("carried", F.lit(False))
    carry = rows.where((F.col("idx") + 1) % size == 0).withColumn("segment", F.col("segment") + 1).withColumn("carried", F.lit(True))
    within = W.partitionBy("series_id", "segment").orderBy("idx")
    step = bits.wrap16(F.col("x") - F.lag("x", 1, 0).over(within))
    out = rows.unionByName(carry).withColumn("d", step).withColumn("z", bits.zigzag16(F.col("d")))
    return out.where(~F.col("carried")).drop("carried", "segment")


def delta_inverse(residuals: DataFrame) -> DataFrame:
    """x from z: the running sum of the steps, wrapped."""
    total = F.sum(bits.unzigzag16(F.col("z")).cast("long")).over(so_far())
    return residuals.withColumn("x", bits.wrap16(total).cast("int"))


def tick_residuals(ticks: DataFrame) -> DataFrame:
    """zts and zpx: 32-bit zigzags of the steps of time stamps and prices."""
    step = lambda c: bits.wrap32(F.col(c) - F.lag(c, 1, 0).over(along()))
    return ticks.withColumn("zts", bits.zigzag32(step("ts"))).withColumn("zpx", bits.zigzag32(step("px")))


def tick_inverse(residuals: DataFrame) -> DataFrame:
    """ts as an unsigned and px as a signed 32-bit value."""
    total = lambda c: F.sum(bits.unzigzag32(F.col(c)).cast("decimal(30,0)")).over(so_far())
    whole = F.lit(1 << 32)
    ts = F.pmod(total("zts"), whole).cast("long")
    return residuals.withColumn("ts", ts).withColumn("px", bits.wrap32(F.pmod(total("zpx"), whole).cast("long")))


def as_arrays(series: DataFrame, value: str = "x", out: str = "xs") -> DataFrame:
    """(series_id, out): one ordered array per series."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("int").alias("v"))))
    return series.groupBy("series_id").agg(F.transform(pairs, lambda p: p["v"]).alias(out))


def fire_arrow(arrays: DataFrame, forward: bool = True) -> DataFrame:
    """es of xs (or back) over Arrow batches: all series of a batch advance together, a sample at a time."""
    from .codecs import residual

    take, give = ("xs", "es") if forward else ("es", "xs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(take)
            done = residual.fire_many(lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False), forward)
            out = pa.ListArray.from_arrays(lists.offsets, pa.array(done, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), out], names=["series_id", give])

    return arrays.select("series_id", F.col(take).cast("array<int>").alias(take)).mapInArrow(run, f"series_id long, {give} array<int>")
