"""Mixing sources to target weights by systematic sampling.

A source of weight w gets min(cap * size, level * w) words, where the level uses
up the wanted total.  Every document of a source is expected target / size times;
prefix sums of that along the source, plus one random offset, cross an integer
once for each copy.  Documents are ordered by size first, so each stretch of the
order gives its due and the words taken stay close to the target.

The prefix sum is distributed: rows are range-partitioned by (source, size, a
hash of the id), and a row's rank is its place in its partition plus what earlier
partitions hold of its source.  A source with a third of all rows is dealt over
as many partitions as it fills.

Defined results: a null text has size 0; a null source is a source of its own,
the last; sources without words have target 0 and their documents are taken 0
times; repeated rows are sampled one by one; a null id is allowed; an empty table
gives no rows.  Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import settle, shuffle_partitions

#: Sources are a dimension table; its sums are made level on the driver up to this number.
MOST_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09 to \\x0D; null counts 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets in proportion to weight that use share of all sizes, none above cap times its size."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: cap * sizes[i] / weights[i])
    mass = sum(weights[i] for i in open_)
    for at, i in enumerate(open_):
        level = left / mass if mass > 0 else 0.0
        if cap * sizes[i] > level * weights[i]:
            for j in open_[at:]:
                out[j] = level * weights[j]
            break
        out[i] = cap * sizes[i]
        left -= out[i]
        mass -= weights[i]
    return out


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a frame with columns source and size."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r.source is None, r.source or ""))  # str compares by code point
    filled = water_fill([r.source_size for r in sums], [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    return sized.sparkSession.createDataFrame([(r.source, r.source_size, t) for r, t in zip(sums, filled)], schema)


def sample(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """sized (columns key, source, size) with source_size, target and copies.  key orders rows of a source and size."""
    spark = sized.sparkSession
    goal = targets(sized, weights, share, cap)
    spread = F.md5(F.col("key").cast("string"))
    dealt = sized.repartitionByRange(shuffle_partitions(spark), F.col("source").asc_nulls_last(), "size", spread, "key")
    dealt = dealt.sortWithinPartitions(F.col("source").asc_nulls_last(), "size", spread, "key").withColumn("at", F.monotonically_increasing_id())
    dealt = settle(dealt.withColumn("part", F.shiftright("at", 33)))
    held = dealt.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("base", before - F.col("first")).select(F.col("source").alias("h_source"), F.col("part").alias("h_part"), "base")
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    held = held.join(goal, F.col("h_source").eqNullSafe(F.col("g_source"))).drop("g_source")
    ranked = dealt.join(held, (dealt.part == held.h_part) & dealt.source.eqNullSafe(held.h_source))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 5)  # 20 bits
    offset = F.conv(drawn, 16, 10).cast("long") / F.lit(float(1 << 20))
    rank = F.col("at") + F.col("base")
    copies = F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank)
    return ranked.select(*sized.columns, "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of documents."""
    sized = docs.select(F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sampled = sample(settle(sized), **how)
    return sampled.select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as many times as it is sampled."""
    everything = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    # rows of one id are told apart by their text and source; equal rows may stand for each other
    rows = docs.select(everything.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("id"), F.xxhash64(text).alias("hash"), source.alias("source"), word_count(text).alias("size"))
    turn = F.row_number().over(W.partitionBy("id").orderBy("hash", "source"))
    sized = settle(rows.select("id", "hash", "source", "size").withColumn("turn", turn).select(F.struct("id", "turn").alias("key"), "source", "size"))
    copies = sample(sized, **how).where("copies > 0").select(F.col("key.id").alias("c_id"), F.col("key.turn").alias("c_turn"), "copies")
    rows = rows.select("row", "id", "hash", "source").withColumn("turn", turn)
    joined = rows.join(copies, (F.col("id") == F.col("c_id")) & (F.col("turn") == F.col("c_turn")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
