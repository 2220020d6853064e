"""Sinks: payload tables and files, reports and streamed batches."""

from __future__ import annotations

from collections.abc import Callable

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.codecs.bitfields import DST, CodecError


def write_payloads(encoded: DataFrame, path: str) -> None:
    """Payloads as a table; binary columns hold any length up to 2 GB."""
    encoded.write.mode("overwrite").parquet(path)


def write_files(rows: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """(path, n_bytes): one file per row in a folder of any store that Arrow opens; a retried task writes the same file again.

    A file is written under a name of its task and then moved, so that readers never meet half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        mark = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths, sizes = [], []
            for own, body in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist()):
                body = body or b""
                with store.open_output_stream(f"{root}/.{own}.{mark}") as out:
                    if out.write(body) != len(body):
                        raise OSError(f"{own}: not all bytes were taken")
                store.move(f"{root}/.{own}.{mark}", f"{root}/{own}")
                paths.append(f"{root}/{own}")
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return rows.select(F.col(name).cast("string").alias("name"), F.col(data).cast("binary").alias("data")).mapInArrow(run, "path string, n_bytes long")


class MemorySink:
    """Bytes up to a bound; what doesn't fit whole is refused with the destination's error."""

    def __init__(self, most: int):
        self.most, self.data = most, bytearray()

    def write(self, piece: bytes) -> int:
        if len(self.data) + len(piece) > self.most:
            raise CodecError(DST, "the destination is full")
        self.data += piece
        return len(piece)


def within(payload: Column, most: Column) -> Column:
    """The payload where it fits the destination, else null."""
    return F.when(F.octet_length(payload) <= most, payload)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def fixed_width(rows: DataFrame) -> DataFrame:
    """Ratio rows as printed lines, which ratio_lines() reads back."""
    share = F.concat(F.format_string("%.1f", F.round(F.lit(100.0) * F.col("coded") / F.col("orig"), 1)), F.lit("%"))
    left = [F.rpad(c, F.greatest(F.length(c), F.lit(20)), " ") for c in (F.col("corpus"), F.col("codec"))]
    right = [F.lpad(c, F.greatest(F.length(c), F.lit(12)), " ") for c in (F.col("orig").cast("string"), F.col("coded").cast("string"), share)]
    return rows.select(F.concat_ws(" ", *left, *right).alias("value"))


def tab_separated(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """value: each row as a line of a table, floating numbers with one decimal, nulls empty."""
    cell = lambda c, t: F.format_string("%.1f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNull(), F.lit("")).otherwise(cell(c, t)) for c, t in rows.dtypes]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown(rows: DataFrame) -> str:
    """A whole table as text, for reports, which the driver holds; markdown_rows() is for tables of any size."""
    head = ["| " + " | ".join(x) + " |" for x in (rows.columns, ["---"] * len(rows.columns))]
    return "\n".join([*head, *(r.value for r in markdown_rows(rows).collect())]) + "\n"


def each_batch(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream whose batches `take` receives; it must take all of each."""
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
