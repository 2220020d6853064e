"""What several operators share: sessions, checkpoints and Arrow columns."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: A batch is worked on in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is spark.checkpoint.dir of the session; a folder of this machine is
    used only by local sessions that set none, as tests do, and never on a cluster.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="serixa-"))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def byte_views(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column, without a copy; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, body = column.buffers()
    kind = np.int64 if wide else np.int32
    if places is None or len(column) == 0:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes of the column; a row stays whole."""
    offsets, _ = byte_views(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 14) -> Iterator[pa.Table]:
    """Sorted batches as tables of at least `least` rows, the last one aside, that part no run of equal keys."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= batch.column(k).to_numpy(zero_copy_only=False) == v
        tail = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if not tail:
            continue  # one run so far fills the batch; what came before it goes with it
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, tail)])
        held, rows = [batch.slice(tail)], batch.num_rows - tail
    if held:
        yield pa.Table.from_batches(held)
