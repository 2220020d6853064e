"""Queries through files: what a sink writes is scanned again and held against SQL over the tables it came from.

Files go to a folder of their own below spark.checkpoint.dir, which every executor
sees, or to a temporary folder of a local session; their names don't clash.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import columns
from ..operators.codecs import bitpack, container
from ..sources import scans, series, sinks
from . import sql
from .report_queries import DEVICE, RATIOS, ratio_rows
from .series_queries import ORACLES, QUERIES, longs


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        root = tempfile.mkdtemp(prefix="serixa-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _add(name: str, f, oracle: str) -> None:
    QUERIES[name], ORACLES[name] = f, oracle


def supplier_files(spark, sf_dir) -> str:
    """One file of samples for each supplier, an empty one and one of another suffix."""
    folder = scratch(spark, "samples")
    data = columns.series_bytes(series.supplier_quantities(spark, sf_dir)).select(F.concat(F.lit("s"), F.col("series_id").cast("string"), F.lit(".i16le")).alias("name"), "data")
    odd = spark.createDataFrame([("empty.i16le", bytearray()), ("note.txt", bytearray(b"no samples"))], "name string, data binary")
    sinks.write_files(data.unionByName(odd), folder).write.format("noop").mode("overwrite").save()
    return folder


def named(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"/s(\d+)\.i16le$", 1).cast("long").alias("series_id"), "data")


def files_int16(spark, sf_dir):
    """Samples of every file of the suffix; files without bytes are skipped."""
    files = named(scans.binary_files(spark, supplier_files(spark, sf_dir), ".i16le"))
    rows = scans.int16_rows(files, "series_id").select(F.col("series_id").cast("long").alias("series_id"), "idx", "x")
    return longs(rows)


_add("files_int16", files_int16, f"WITH {sql.SUPPLIER_SERIES} SELECT series_id, idx, x FROM li")


def files_binary(spark, sf_dir):
    """Bytes of every file, and the first 100 of them."""
    files = scans.binary_files(spark, supplier_files(spark, sf_dir), ".i16le")
    both = named(files).select("series_id", F.octet_length("data").alias("n_bytes")).join(named(scans.prefix(files, 100)).select("series_id", F.octet_length("data").alias("n_prefix")), "series_id")
    return longs(both)


_add("files_binary", files_binary, "SELECT l_suppkey AS series_id, 2 * count(*) AS n_bytes, least(100, 2 * count(*)) AS n_prefix FROM lineitem GROUP BY l_suppkey")


def files_csv(spark, sf_dir):
    """Event values printed as a CSV file's last column and read back as 16 bits."""
    path = scratch(spark, "csv")
    rows = series.read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 == 0, F.lit("none")).otherwise(F.col("value").cast("string")).alias("value"))
    rows.write.option("header", True).csv(path)
    return longs(scans.csv_series(spark, path).groupBy("x").agg(F.count("*").alias("n")))


_add("files_csv", files_csv, "SELECT CAST(greatest(-32767, least(32767, round_even(value * 100, 0))) AS BIGINT) AS x, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1")

_FIRST = 500


def files_log(spark, sf_dir):
    """Field 4 of blank-separated lines: the first 500 that hold a number, in order."""
    path = scratch(spark, "log")
    value = F.when(F.col("event_id") % 7 == 0, F.lit("?")).otherwise(F.col("value").cast("string"))
    lines = series.read(spark, sf_dir, "events").select("event_id", F.concat_ws("  ", F.lit("day time"), "event_id", "user_id", value, F.lit("end")).alias("value"))
    lines.coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path)
    return longs(scans.log_series(spark, path, most=_FIRST).select("line", "x"))


_add(
    "files_log",
    files_log,
    f"""WITH n AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS line FROM events)
SELECT line, CAST(greatest(-32767, least(32767, round_even(value * 100, 0))) AS BIGINT) AS x FROM n WHERE event_id % 7 <> 0 ORDER BY line LIMIT {_FIRST}""",
)


def files_labelled(spark, sf_dir):
    """Vectors as lines of a class and values in two files, read one after the other, scaled over all of them."""
    rows = series.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    paths = []
    for split in (0, 1):
        path = scratch(spark, f"split{split}")
        texts = F.transform("embedding", lambda x: x.cast("double").cast("string"))
        lines = rows.where(F.col("vec_id") % 2 == split).select("vec_id", F.concat_ws([" ", "\t"][split], F.lit("1"), texts).alias("value"))
        lines.coalesce(1).sortWithinPartitions("vec_id").select("value").write.text(path)
        paths.append(path)
    scaled = scans.min_max_to_int16(scans.labelled_series(spark, paths))
    return longs(scaled.select("split", "line", "at", "x"))


_add(
    "files_labelled",
    files_labelled,
    """WITH l AS (SELECT vec_id % 2 AS split, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS line, embedding FROM embeddings),
v AS (SELECT split, line, unnest(range(len(embedding))) AS "at", embedding FROM l),
w AS (SELECT split, line, "at", CAST(embedding["at" + 1] AS DOUBLE) AS v FROM v), b AS (SELECT min(v) AS lo, max(v) AS hi FROM w)
SELECT split, line, "at", CAST(greatest(-32767, least(32767, round_even((v - lo) / (hi - lo) * 65534.0::DOUBLE - 32767.0::DOUBLE, 0))) AS BIGINT) AS x FROM w, b""",
)


def files_ablation(spark, sf_dir):
    """Ratio rows as tab-separated lines with comments and short lines between, scanned again."""
    path = scratch(spark, "tsv")
    rows = ratio_rows(spark, sf_dir).where("codec = 'core'")
    lines = sinks.tab_separated(rows.select("corpus", F.lit(1).alias("frontend"), "orig", "coded", "ratio", F.lit("C").alias("mark")))
    noise = spark.createDataFrame([("# corpus\tfrontend\t1\t2\t3\t4",), ("short\t1",)], "value string")
    lines.unionByName(noise).write.text(path)
    return longs(scans.ablation_lines(spark.read.text(path)))


_add("files_ablation", files_ablation, f"WITH {RATIOS} SELECT corpus, CAST(1 AS BIGINT) AS frontend, orig, coded, ratio AS ratio_pct, 'C' AS mark FROM ratios WHERE codec = 'core'")


def files_json(spark, sf_dir):
    """A report's rows written as JSON, wrapped as one report's array, and scanned."""
    path, whole = scratch(spark, "json"), scratch(spark, "report")
    sinks.write_json(ratio_rows(spark, sf_dir).where("codec = 'store'"), path)
    rows = spark.read.json(path)
    rows.groupBy().agg(F.collect_list(F.struct("corpus", "codec", "orig", "coded", "ratio")).alias("rows")).select(F.to_json(F.struct("rows")).alias("value")).write.text(whole)  # a report
    return longs(scans.json_rows(spark, whole).select("corpus", "codec", "orig", "coded", "ratio"))


_add("files_json", files_json, f"WITH {RATIOS} SELECT corpus, codec, orig, coded, ratio FROM ratios WHERE codec = 'store'")


def device_sizes(spark, sf_dir):
    """(target, codec, flash, state): a report of code and state on devices, written as JSON and scanned target by target."""
    path = scratch(spark, "device")
    table = spark.createDataFrame(DEVICE, "target string, codec string, flash long, state long")
    report = table.groupBy().agg(*(F.collect_list(F.when(F.col("target") == t, F.struct("codec", "flash", "state"))).alias(t) for t in ("cortex-m0", "cortex-m3")))
    report.select(F.to_json(F.struct("*")).alias("value")).write.text(path)  # a report of two targets
    out = None
    for target in ("cortex-m0", "cortex-m3"):
        rows = scans.json_rows(spark, path, f"`{target}`").select(F.lit(target).alias("target"), "codec", "flash", "state")
        out = rows if out is None else out.unionByName(rows)
    return out


_add("device_sizes", device_sizes, "SELECT * FROM (VALUES " + ", ".join(f"({t!r}, {c!r}, {f}::BIGINT, {s}::BIGINT)" for t, c, f, s in DEVICE) + ") d(target, codec, flash, state)")


def report_markdown(spark, sf_dir):
    """The ratio table as lines of a report."""
    return sinks.markdown_rows(ratio_rows(spark, sf_dir).select("corpus", "codec", "orig", "coded", "ratio"))


_add("report_markdown", report_markdown, f"WITH {RATIOS} SELECT '| ' || corpus || ' | ' || codec || ' | ' || orig || ' | ' || coded || ' | ' || printf('%.1f', ratio) || ' |' AS value FROM ratios")


def payload_table(spark, sf_dir):
    """Payloads written as a table and decoded from it."""
    path = scratch(spark, "payloads")
    sinks.write_payloads(columns.encode(columns.series_bytes(series.supplier_quantities(spark, sf_dir)), ["core"], fail=True), path)
    return longs(columns.samples_of(columns.decode(spark.read.parquet(path), fail=True)).select("series_id", "idx", "x"))


_add("payload_table", payload_table, f"WITH {sql.SUPPLIER_SERIES} SELECT series_id, idx, x FROM li")


def streamed_batches(spark, sf_dir):
    """Rows that a stream hands to a callback, which must take all of each batch; a replayed batch replaces itself."""
    took, marks = scratch(spark, "taken"), scratch(spark, "marks")
    source = scratch(spark, "events")
    series.read(spark, sf_dir, "events").select("event_id", "user_id").write.parquet(source)
    stream = spark.readStream.schema("event_id long, user_id long").parquet(source)
    query = sinks.each_batch(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{took}/batch={n}"), marks)
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(took).select("event_id", "user_id")


_add("streamed_batches", streamed_batches, "SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id FROM events")


def _cli_paths(folder: str, name: int) -> list[str]:
    return [f"{folder}/{name}.{kind}" for kind in ("raw", "coded", "back")]


def cli_roundtrip(spark, sf_dir):
    """(series_id, n_bytes, back, broken): each series through the command line's files and back; a changed byte must fail."""
    import os
    from collections.abc import Iterator

    import pyarrow as pa

    data = columns.series_bytes(series.supplier_quantities(spark, sf_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import contextlib
        import io

        from .. import cli

        for batch in batches:
            rows = []
            for name, raw in zip(batch.column("series_id").to_pylist(), batch.column("data").to_pylist()):
                with tempfile.TemporaryDirectory() as folder, contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):  # gone with the row
                    first, coded, back = _cli_paths(folder, name)
                    with open(first, "wb") as file:
                        file.write(raw)
                    ends = [cli.main(["c", "-f", "i16", "--profile", "deployable", "-i", first, "-o", coded]), cli.main(["d", "-i", coded, "-o", back])]
                    with open(back, "rb") as file:
                        same = file.read() == raw and ends == [0, 0]
                    with open(coded, "r+b") as file:
                        file.seek(28)
                        byte = file.read(1)[0]
                        file.seek(28)
                        file.write(bytes((byte ^ 255,)))
                    broken = cli.main(["d", "-i", coded, "-o", back])
                    size = os.path.getsize(first)
                rows.append((name, size, same, broken))
            columns_ = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], names=["series_id", "n_bytes", "back", "broken"])

    return data.mapInArrow(run, "series_id long, n_bytes long, back boolean, broken long")


_add("cli_roundtrip", cli_roundtrip, "SELECT l_suppkey AS series_id, 2 * count(*) AS n_bytes, true AS back, CAST(1 AS BIGINT) AS broken FROM lineitem GROUP BY l_suppkey")


def legacy_forms(spark, sf_dir):
    """(series_id, form, n_bytes, intact): older whole-buffer and stored payloads, built here byte by byte, read by the decoder."""
    import struct
    import zlib
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from ..operators.codecs.residual import I16, State

    data = columns.series_bytes(series.supplier_quantities(spark, sf_dir))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column("series_id").to_pylist(), batch.column("data").to_pylist()):
                rest = State().forward(I16, raw)
                packed = bitpack.encode(np.frombuffer(rest, "<u2"))
                whole = struct.pack("<BI", container.WHOLE, len(packed)) + packed
                for form, body, flags in (("whole", whole, container.STREAM_FLAG | container.DELTA_FLAG), ("stored", rest, container.STORE_FLAG | container.DELTA_FLAG)):
                    head = container.Header(flags, len(raw), len(body), zlib.crc32(raw)).pack()
                    rows.append((name, form, len(raw), container.decompress(head + body) == raw))
            columns_ = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, (pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["series_id", "form", "n_bytes", "intact"])

    return data.mapInArrow(run, "series_id long, form string, n_bytes long, intact boolean")


_add("legacy_forms", legacy_forms, "SELECT l_suppkey AS series_id, form, 2 * count(*) AS n_bytes, true AS intact FROM lineitem, (VALUES ('whole'), ('stored')) f(form) GROUP BY l_suppkey, form")


def frontend_names(spark, sf_dir):
    """Market segments and aliases as frontends: number, validity, whether of 16 bits, and flag."""
    names = series.read(spark, sf_dir, "customer").select(F.concat_ws(",", F.lit("raw,NONE,i16,tick8,Ticks,fire"), "c_mktsegment").alias("n")).select(F.explode(F.split("n", ",")).alias("name"))
    rows = names.select("name", F.coalesce(bits.frontend_by_alias(F.col("name")), F.lit(9)).alias("frontend"))
    rows = rows.withColumns({"valid": bits.frontend_is_valid(F.col("frontend")), "sixteen": bits.frontend_is_i16(F.col("frontend"))})
    return longs(rows.groupBy("name", "frontend", "valid", "sixteen").agg(F.count("*").alias("n")))


_ALIASED = ", ".join(f"({a!r}, {n})" for a, n in sorted(bits.ALIASES.items()))
_add(
    "frontend_names",
    frontend_names,
    f"""WITH a(alias, frontend) AS (VALUES {_ALIASED}), n AS (SELECT unnest(string_split('raw,NONE,i16,tick8,Ticks,fire,' || c_mktsegment, ',')) AS name FROM customer)
SELECT name, CAST(coalesce(frontend, 9) AS BIGINT) AS frontend, coalesce(frontend, 9) BETWEEN 0 AND 4 AS valid, coalesce(frontend IN (1, 3, 4), false) AS sixteen, count(*) AS n FROM n LEFT JOIN a ON alias = lower(name) GROUP BY name, frontend""",
)


def device_listing(spark, sf_dir):
    """Sections and zeroed symbols of a size listing and a symbol listing, made of parts and suppliers."""
    image = F.concat(F.lit("image"), (F.col("p_partkey") % 5).cast("string")).alias("image")
    parts = series.read(spark, sf_dir, "part")
    sections = parts.groupBy(image).agg(F.sum("p_size").alias("s"), F.max("p_size").alias("m"))
    lines = sections.select("image", F.explode(F.array(F.lit("section size addr"), F.concat(F.lit(".text  "), "s", F.lit(" 0")), F.concat(F.lit(" .data "), "m", F.lit(" 0")), F.concat(F.lit(".bss\t"), F.lit("64 0")), F.lit(".debug x 0"), F.lit(""))).alias("value"))
    kind = F.element_at(F.array(*map(F.lit, ("b", "B", "C", "T"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    owner = F.element_at(F.array(*map(F.lit, ("src", "enc", "table"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    symbols = parts.select(image, F.concat_ws(" ", F.lit("20000000"), F.lpad(F.lower(F.hex("p_size")), 8, "0"), kind, owner).alias("value"))
    short = parts.select(image, F.lit("20000000 b src").alias("value"))
    sizes = scans.section_sizes(lines).join(scans.zeroed_symbols(symbols.unionByName(short), ["src", "dst"], ["enc", "dec"]), "image", "left")
    return longs(sizes)


_add(
    "device_listing",
    device_listing,
    """WITH p AS (SELECT 'image' || (p_partkey % 5) AS image, p_partkey AS k, p_size AS z FROM part)
SELECT image, CAST(sum(z) AS BIGINT) AS flash, CAST(max(z) AS BIGINT) AS data, CAST(64 AS BIGINT) AS bss, CAST(max(z) + 64 AS BIGINT) AS ram,
  CAST(coalesce(sum(z) FILTER (k % 4 < 3 AND k % 3 = 0), 0) AS BIGINT) AS harness, CAST(coalesce(sum(z) FILTER (k % 4 < 3 AND k % 3 = 1), 0) AS BIGINT) AS library,
  CAST(coalesce(sum(z) FILTER (k % 4 < 3 AND k % 3 = 2), 0) AS BIGINT) AS other FROM p GROUP BY image""",
)


def bounded_payloads(spark, sf_dir):
    """Payloads that fit a destination of half their series' bytes; what doesn't fit is refused whole."""
    coded = columns.encode(columns.series_bytes(series.supplier_quantities(spark, sf_dir)), ["sprintz_d"], fail=True)
    kept = sinks.within(F.col("payload"), F.floor(F.col("n_bytes") / 2))
    return longs(coded.select("series_id", F.octet_length(kept).alias("coded")))


_add("bounded_payloads", bounded_payloads, f"{sql.compact_sizes(sql.SUPPLIER_SERIES, 'li')} SELECT series_id, CASE WHEN packed_bytes + 5 <= orig_bytes // 2 THEN packed_bytes + 5 END AS coded FROM sizes")
