"""Encoded sizes in closed form, without making a byte.

Residuals z in blocks of 8 take 5 bits and 8 times the block's width; a run of
zero blocks takes 13 bits for each 256 of them.  Each size is a chain of grouped
sums over one shuffle by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.bits import bit_width

BLOCK, CHUNK, HEADER, COMPACT_HEAD = 8, 128, 32, 5


def blocks(residuals: DataFrame, keys: tuple[str, ...] = ("series_id",), tile: int | None = None) -> DataFrame:
    """(keys, [chunk], block, nb, n): the width of each block of 8 residuals."""
    at = F.col("idx")
    group = [*keys]
    rows = residuals
    if tile:
        rows = rows.withColumn("chunk", F.floor(at / tile))
        group.append("chunk")
    rows = rows.withColumn("block", F.floor(at / BLOCK))
    return rows.groupBy(*group, "block").agg(F.max(bit_width(F.col("z"))).cast("long").alias("nb"), F.count("*").alias("n"))


def zero_runs(widths: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, first_block, run, tokens): maximal runs of zero blocks."""
    zero = widths.where("nb = 0")
    island = F.col("block") - F.row_number().over(W.partitionBy(*keys).orderBy("block"))
    runs = zero.withColumn("island", island).groupBy(*keys, "island").agg(F.min("block").alias("first_block"), F.count("*").alias("run"))
    return runs.select(*keys, "first_block", "run", F.ceil(F.col("run") / 256).alias("tokens"))


def packed_bits(widths: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, bits, samples, all_zero): bits of the packed blocks.

    A zero block costs a token if it starts its run or stands a multiple of 256
    blocks after the start; the run's start is the last boundary before it, so one
    window serves both kinds of block.
    """
    along = W.partitionBy(*keys).orderBy("block")
    begins = (F.col("nb") == 0) & (F.coalesce(F.lag("nb").over(along), F.lit(1)) != 0)
    rows = widths.withColumn("begin", F.max(F.when(begins, F.col("block"))).over(along.rowsBetween(W.unboundedPreceding, 0)))
    token = (F.col("block") - F.col("begin")) % 256 == 0
    cost = F.when(F.col("nb") > 0, 5 + 8 * F.col("nb")).when(token, 13).otherwise(0)
    return rows.groupBy(*keys).agg(F.sum(cost).cast("long").alias("bits"), F.sum("n").alias("samples"), (F.max("nb") == 0).alias("all_zero"))


def whole_bytes(bits: Column) -> Column:
    return F.floor((bits + 7) / 8)


def stream_sizes(residuals: DataFrame) -> DataFrame:
    """(series_id, n, stream_bytes): deployable records of 128 samples, after the header; runs stay within chunks."""
    keys = ("series_id", "chunk")
    records = packed_bits(blocks(residuals, tile=CHUNK), keys)
    raw, packed = 2 * F.col("samples"), whole_bytes(F.col("bits"))
    over = F.when(F.col("samples") == CHUNK, 2).otherwise(3)
    fits = (packed < raw) & (packed <= 255)
    record = F.when(F.col("all_zero"), 2).when(fits, packed + over).otherwise(2 + raw)
    return records.groupBy("series_id").agg(F.sum("samples").alias("n"), (F.sum(record) + HEADER).cast("long").alias("stream_bytes"))


def compact_sizes(residuals: DataFrame) -> DataFrame:
    """(series_id, n, orig_bytes, packed_bytes, compact_bytes, eligible)."""
    sums = packed_bits(blocks(residuals), ("series_id",))
    orig, packed = 2 * F.col("samples"), whole_bytes(F.col("bits"))
    return sums.select(
        "series_id",
        F.col("samples").alias("n"),
        orig.alias("orig_bytes"),
        packed.alias("packed_bytes"),
        (packed + COMPACT_HEAD).alias("compact_bytes"),
        ((orig >= 64) & (packed < orig)).alias("eligible"),
    )


def both_sizes(residuals: DataFrame) -> DataFrame:
    """stream_sizes and compact_sizes in one pass: blocks don't cross chunks, so the same widths serve both."""
    widths = blocks(residuals, tile=CHUNK)

    def cost(*keys: str) -> Column:
        along = W.partitionBy(*keys).orderBy("block")
        begins = F.max(F.when(F.col(f"fresh_{len(keys)}"), F.col("block"))).over(along.rowsBetween(W.unboundedPreceding, 0))
        return F.when(F.col("nb") > 0, 5 + 8 * F.col("nb")).when((F.col("block") - begins) % 256 == 0, 13).otherwise(0)

    fresh = lambda *keys: (F.col("nb") == 0) & (F.coalesce(F.lag("nb").over(W.partitionBy(*keys).orderBy("block")), F.lit(1)) != 0)
    rows = widths.withColumns({"fresh_1": fresh("series_id"), "fresh_2": fresh("series_id", "chunk")})
    rows = rows.withColumns({"whole_cost": cost("series_id"), "chunk_cost": cost("series_id", "chunk")})
    chunks = rows.groupBy("series_id", "chunk").agg(F.sum("whole_cost").alias("whole_bits"), F.sum("chunk_cost").alias("bits"), F.sum("n").alias("samples"), (F.max("nb") == 0).alias("all_zero"))
    raw, packed = 2 * F.col("samples"), whole_bytes(F.col("bits"))
    over = F.when(F.col("samples") == CHUNK, 2).otherwise(3)
    record = F.when(F.col("all_zero"), 2).when((packed < raw) & (packed <= 255), packed + over).otherwise(2 + raw)
    sums = chunks.groupBy("series_id").agg(F.sum("samples").alias("n"), (F.sum(record) + HEADER).cast("long").alias("stream_bytes"), whole_bytes(F.sum("whole_bits")).alias("packed_bytes"))
    orig = 2 * F.col("n")
    return sums.select("series_id", "n", orig.alias("orig_bytes"), "packed_bytes", (F.col("packed_bytes") + COMPACT_HEAD).alias("compact_bytes"), ((orig >= 64) & (F.col("packed_bytes") < orig)).alias("eligible"), "stream_bytes")


def lz_friendly(series: DataFrame) -> DataFrame:
    """(series_id, checks, same, friendly): whether 2 of 5 of the first 255 steps repeat the sample before."""
    along = W.partitionBy("series_id").orderBy("idx")
    rows = series.withColumn("same", (F.col("x") == F.lag("x").over(along)).cast("long"))
    checked = F.when(F.col("idx").between(1, 255), 1)
    out = rows.groupBy("series_id").agg(F.count("*").alias("n"), F.count(checked).alias("checks"), F.coalesce(F.sum(F.when(F.col("idx").between(1, 255), F.col("same"))), F.lit(0)).alias("same"))
    return out.select("series_id", "checks", "same", ((F.col("n") >= 32) & (F.col("checks") > 0) & (F.col("same") * 5 >= F.col("checks") * 2)).alias("friendly"))
