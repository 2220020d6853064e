"""Scans of binary, text, table and report files into typed rows.

Everything is read by Spark's own readers, so any store it can open will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def binary_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, data) of the files that end in the suffix; empty ones are skipped."""
    reader = spark.read.format("binaryFile")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*?{suffix}")
    return reader.load(path).where("length > 0").select("path", F.col("content").alias("data"))


def int16_rows(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, idx, x) of little-endian samples; an odd last byte is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(key), batch.column("data").to_pylist()):
                x = np.frombuffer(data or b"", "<i2", len(data or b"") // 2)
                for first in range(0, len(x), 1 << 16):
                    some = x[first : first + (1 << 16)].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(some)), pa.array(np.arange(first, first + len(some))), pa.array(some)], names=[key, "idx", "x"])

    return files.select(F.col(key).cast("string").alias(key), "data").mapInArrow(run, f"{key} string, idx long, x int")


def prefix(files: DataFrame, n: int = 16_384) -> DataFrame:
    return files.withColumn("data", F.substring("data", 1, n))


def scaled(value: Column, scale: float = 100.0) -> Column:
    """A number as 16 bits: scaled, rounded half to even, clamped to -32767..32767; null where it isn't one."""
    number = value.try_cast("double")
    whole = F.rint(number * scale)
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(-32767), F.least(F.lit(32767), whole)).cast("int"))


def csv_series(spark: SparkSession, path: str, scale: float = 100.0) -> DataFrame:
    """(path, line, x) of the last column; the header and rows without a number are skipped."""
    lines = numbered(spark, path).where("line > 0")
    return lines.select("path", "line", scaled(F.element_at(F.split("value", ","), -1), scale).alias("x")).where("x is not null")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines with their number in their file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    return rows.select("path", (F.row_number().over(W.partitionBy("path").orderBy("at")) - 1).alias("line"), "value")


def log_series(spark: SparkSession, path: str, field: int = 4, scale: float = 100.0, most: int = 400_000) -> DataFrame:
    """(path, line, x) of one field of blank-separated lines; the first `most` rows that hold a number."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = numbered(spark, path).where(F.size(parts) >= field + 1).select("path", "line", scaled(F.get(parts, field), scale).alias("x"))
    return rows.where("x is not null").orderBy("path", "line").limit(most)


def labelled_series(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(split, line, at, v) of files of class and values, one after another; the class is dropped."""
    out = None
    for split, path in enumerate(paths):
        parts = F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ")
        rows = numbered(spark, path).where(F.size(parts) > 1)
        rows = rows.select(F.lit(split).alias("split"), "line", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("at", "text"))
        rows = rows.select("split", "line", "at", F.col("text").try_cast("double").alias("v")).where("v is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def min_max_to_int16(rows: DataFrame, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """x: the value's place between least and largest as -32767..32767; a constant's span is 1."""
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = rows.join(bounds, [*keys]) if keys else rows.crossJoin(F.broadcast(bounds))  # one row
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    x = F.rint((F.col(value) - F.col("lo")) / span * 65534.0 - 32767.0)
    return joined.withColumn("x", F.greatest(F.lit(-32767), F.least(F.lit(32767), x)).cast("int")).drop("lo", "hi")


def ratio_lines(lines: DataFrame) -> DataFrame:
    """(corpus, codec, orig, coded, ratio) of printed lines of five words: two names, two whole numbers, a percentage."""
    words = F.split(F.rtrim("value"), r"\s+")
    number = lambda i: F.get("words", F.lit(i)).try_cast("long")
    share = F.get("words", F.lit(4))
    rows = lines.select(words.alias("words")).where(F.size("words") == 5).select(F.get("words", F.lit(0)).alias("corpus"), F.get("words", F.lit(1)).alias("codec"), number(2).alias("orig"), number(3).alias("coded"), share.alias("ratio"))
    told = F.col("ratio").endswith("%") & F.rtrim("ratio", F.lit("%")).try_cast("double").isNotNull()
    return rows.where((F.col("corpus") != "") & (F.col("orig") >= 0) & (F.col("coded") >= 0) & told)


def section_sizes(lines: DataFrame) -> DataFrame:
    """(image, flash, data, bss, ram) of a size listing's lines (image, value): a section, its size, and what follows."""
    words = F.split(F.trim("value"), r"\s+")
    rows = lines.select("image", F.get(words, F.lit(0)).alias("section"), F.get(words, F.lit(1)).try_cast("long").alias("size")).where("size is not null")
    of = lambda name: F.coalesce(F.max_by(F.when(F.col("section") == name, F.col("size")), F.col("section") == name), F.lit(0)).cast("long")
    sums = rows.groupBy("image").agg(of(".text").alias("flash"), of(".data").alias("data"), of(".bss").alias("bss"))
    return sums.withColumn("ram", F.col("data") + F.col("bss"))


def zeroed_symbols(lines: DataFrame, harness: list[str], library: list[str]) -> DataFrame:
    """(image, harness, library, other): bytes of zeroed symbols (address, hexadecimal size, type, name) of lines (image, value) by owner."""
    words = F.split(F.trim("value"), r"\s+")
    word = lambda i: F.get(words, F.lit(i))
    size = F.when(word(1).rlike("^[0-9a-fA-F]+$"), F.conv(word(1), 16, 10).cast("long"))
    rows = lines.select("image", size.alias("size"), word(2).alias("type"), word(3).alias("name")).where(F.col("type").isin("B", "b", "C") & F.col("size").isNotNull() & F.col("name").isNotNull())
    owner = F.when(F.col("name").isin(harness), "harness").when(F.col("name").isin(library), "library").otherwise("other")
    sums = lambda who: F.coalesce(F.sum(F.when(owner == who, F.col("size"))), F.lit(0)).alias(who)
    return rows.groupBy("image").agg(sums("harness"), sums("library"), sums("other"))


def ablation_lines(lines: DataFrame) -> DataFrame:
    """(corpus, frontend, orig, coded, ratio_pct, mark) of tab-separated lines; comments and short lines are skipped."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(parts) >= 6))
    return rows.select(parts[0].alias("corpus"), parts[1].try_cast("int").alias("frontend"), parts[2].try_cast("long").alias("orig"), parts[3].try_cast("long").alias("coded"), parts[4].try_cast("double").alias("ratio_pct"), parts[5].alias("mark"))


def json_rows(spark: SparkSession, path: str, rows: str = "rows") -> DataFrame:
    """The objects of one array of a report."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(rows).alias("r")).select("r.*")
