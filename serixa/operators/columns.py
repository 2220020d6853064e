"""Codecs over tables: one buffer or one series per row, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import little_endian
from .codecs import CODECS, SAMPLES_ONLY, container, peers
from .codecs.bitfields import CodecError

ENCODED = "series_id long, codec string, n_bytes long, payload binary, crc long, error int"


def series_bytes(series: DataFrame, value: str = "x") -> DataFrame:
    """(series_id, data): each series as 16-bit little-endian samples, by one shuffle."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("int").alias("v"))))
    arrays = series.groupBy("series_id").agg(F.transform(pairs, lambda p: p["v"]).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("xs")
            values = lists.flatten().to_numpy().astype("<i2").tobytes()
            ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            data = [values[2 * a : 2 * b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(data, pa.binary())], names=["series_id", "data"])

    return arrays.mapInArrow(run, "series_id long, data binary")


def tick_bytes(ticks: DataFrame) -> DataFrame:
    """(series_id, data): each series as 8-byte ticks."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "ts", "px")))
    arrays = ticks.groupBy("series_id").agg(ordered.alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for rows in batch.column("rows").to_pylist():
                pairs = np.array([(r["ts"] & 0xFFFFFFFF, r["px"] & 0xFFFFFFFF) for r in rows], np.int64)
                data.append(pairs.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(data, pa.binary())], names=["series_id", "data"])

    return arrays.mapInArrow(run, "series_id long, data binary")


def encode(buffers: DataFrame, codecs: list[str], fail: bool = False) -> DataFrame:
    """(series_id, codec, n_bytes, payload, crc, error) of buffers (series_id, data), one row per codec.

    A failure gives its code and no payload, or ends the query if `fail`.
    """
    unknown = set(codecs) - set(CODECS)
    if unknown:
        raise ValueError(f"unknown codecs: {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("series_id").to_pylist(), batch.column("data").to_pylist()):
                data = data or b""
                for codec in codecs:
                    payload, error = None, 0
                    try:
                        if codec in SAMPLES_ONLY and len(data) % 2:
                            raise CodecError(-5, "an odd number of bytes")
                        payload = CODECS[codec][0](data)
                    except CodecError as problem:
                        if fail:
                            raise
                        error = problem.code
                    rows.append((name, codec, len(data), payload, zlib.crc32(data), error))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ENCODED.split(", ")])

    return buffers.select("series_id", "data").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, fail: bool = False) -> DataFrame:
    """(series_id, codec, data, error); compact forms have no checksum of their own, so crc is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, codec, payload, crc in zip(*(batch.column(c).to_pylist() for c in ("series_id", "codec", "payload", "crc"))):
                data, error = None, 0
                try:
                    if payload is None:
                        raise CodecError(-5, "no payload")
                    data = CODECS[codec][1](payload)
                    if crc is not None and zlib.crc32(data) != crc:
                        data = None
                        raise CodecError(-3, "checksums differ")
                except CodecError as problem:
                    if fail:
                        raise
                    error = problem.code
                rows.append((name, codec, data, error))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.int32()))], names=["series_id", "codec", "data", "error"])

    return encoded.select("series_id", "codec", "payload", "crc").mapInArrow(run, "series_id long, codec string, data binary, error int")


def samples_of(decoded: DataFrame) -> DataFrame:
    """(series_id, codec, idx, x) of decoded 16-bit series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(d or b"", "<i2", len(d or b"") // 2) for d in batch.column("data").to_pylist()]
            sizes = [len(r) for r in raw]
            take = pa.array(np.repeat(np.arange(len(raw)), sizes))
            idx = np.concatenate([np.arange(n) for n in sizes]) if raw else np.zeros(0, np.int64)
            x = np.concatenate(raw).astype(np.int32) if raw else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("series_id").take(take), batch.column("codec").take(take), pa.array(idx), pa.array(x)], names=["series_id", "codec", "idx", "x"])

    return decoded.mapInArrow(run, "series_id long, codec string, idx long, x int")


def sprintz_multi(steps: DataFrame, dims: int) -> DataFrame:
    """(series_id, n, payload, intact) of (series_id, dim, step, x): dimensions interleaved, packed one after another."""

    rows = steps.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "dim", "x"))), lambda p: p["x"]).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for xs in batch.column("xs").to_pylist():
                payload = peers.sprintz_encode(np.array(xs, np.int64), dims)
                out.append((len(xs), payload, bool((peers.sprintz_decode(payload) == xs).all())))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.bool_())))], names=["series_id", "n", "payload", "intact"])

    return rows.mapInArrow(run, "series_id long, n long, payload binary, intact boolean")


def parse_headers(payloads: DataFrame) -> DataFrame:
    """(series_id, version, flags, orig_len, coded_len, weight_id, crc32) by byte expressions; payloads without a header give nulls."""
    place = lambda at, n: little_endian(F.col("payload"), at, n)
    known = F.substring("payload", 1, 4) == F.lit(container.MAGIC)
    fields = {"version": (4, 2), "flags": (6, 2), "orig_len": (8, 8), "coded_len": (16, 8), "weight_id": (24, 4), "crc32": (28, 4)}
    return payloads.select("series_id", *(F.when(known & (F.length("payload") >= 32), place(*span)).alias(name) for name, span in fields.items()))


def register(spark: SparkSession) -> None:
    """SQL functions: series_encode(codec, data), series_decode(codec, payload), and the table function series_samples(data)."""
    from pyspark.sql.types import BinaryType

    def by_name(side: int):
        def run(codec, data):
            return None if data is None or codec not in CODECS else bytearray(CODECS[codec][side](bytes(data)))

        return run

    spark.udf.register("series_encode", by_name(0), BinaryType())
    spark.udf.register("series_decode", by_name(1), BinaryType())

    @F.udtf(returnType="idx: int, x: int")
    class Samples:
        def eval(self, data: bytes):
            if data is not None:
                yield from enumerate(np.frombuffer(bytes(data), "<i2", len(data) // 2).tolist())

    spark.udtf.register("series_samples", Samples)
