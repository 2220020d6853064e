"""Integer series from ordinary tables: rows (series_id, idx, x), in a total order.

Rows with a null key, order or value are dropped, never encoded as 0.  Float
values are scaled and rounded half up, and clamped to 16 bits.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.bits import saturate16


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """(series_id, idx, values).  The key has its name before the window, so that all later steps find it partitioned."""
    keep = [F.col(c).isNotNull() for c in (key, *values)]
    named = rows.where(reduce(and_, keep)).select(F.col(key).cast("long").alias("series_id"), *order, *(v for v in values if v not in order))
    idx = (F.row_number().over(W.partitionBy("series_id").orderBy(*order)) - 1).cast("long")
    return named.withColumn("idx", idx).select("series_id", "idx", *values)


def user_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: the events' values in cents."""
    cents = saturate16(F.floor(F.col("value") * 100 + 0.5)).cast("int")
    return indexed(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", cents.alias("x")), "user_id", ["ts", "event_id"], "x")


def user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, idx, ts, px) per user: seconds and cents."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec")
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", seconds, F.floor(F.col("value") * 100 + 0.5).cast("long").alias("px"))
    return indexed(rows, "user_id", ["ts", "event_id"], "sec", "px").withColumnRenamed("sec", "ts")


def supplier_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier: the quantities of its line items by ship date."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity"]
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", *order, F.col("l_quantity").cast("int").alias("x"))
    return indexed(rows, "l_suppkey", order, "x")


def embedding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, dim, step, x): blocks of 100 vectors by id, one series of steps per dimension."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    x = saturate16(F.floor(F.col("v").cast("double") * 32767 + 0.5)).cast("int")
    return rows.select(F.floor(F.col("vec_id") / 100).alias("series_id"), F.col("dim").cast("long").alias("dim"), F.pmod("vec_id", F.lit(100)).alias("step"), x.alias("x"))
