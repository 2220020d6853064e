"""Queries through the byte codecs: round trips, sizes of real payloads, push streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import columns
from ..operators.codecs import genome
from ..sources import series
from . import sql
from .series_queries import DNA, ORACLES, QUERIES, dna, longs, plateaus

SOURCE = {
    "user": (lambda s, d: columns.series_bytes(series.user_cents(s, d)), f"WITH {sql.USER_SERIES} SELECT series_id, idx, x FROM ev"),
    "supplier": (lambda s, d: columns.series_bytes(series.supplier_quantities(s, d)), f"WITH {sql.SUPPLIER_SERIES} SELECT series_id, idx, x FROM li"),
    "plateau": (
        lambda s, d: columns.series_bytes(plateaus(s, d)),
        f"WITH {sql.SUPPLIER_SERIES} SELECT series_id, idx, CASE WHEN (idx // 64) % 3 = 0 THEN x ELSE 7 END AS x FROM li",
    ),
}


def _round_trip(name: str, codec: str, source: str) -> None:
    make, oracle = SOURCE[source]

    def run(spark, sf_dir):
        coded = columns.encode(make(spark, sf_dir), [codec], fail=True)
        return longs(columns.samples_of(columns.decode(coded, fail=True)).select("series_id", "idx", "x"))

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, oracle


for _name, _codec, _source in (
    ("sprintz_roundtrip", "sprintz_d", "supplier"),
    ("compact_roundtrip", "core", "supplier"),
    ("fire_compact_roundtrip", "core_fire", "supplier"),
    ("stream_roundtrip", "core_deployable", "supplier"),
    ("rc_roundtrip", "core_bytes", "user"),
    ("lz_roundtrip", "core", "plateau"),
    ("drh_roundtrip", "drh", "supplier"),
    ("proglz_roundtrip", "proglz", "plateau"),
    ("schulduhr_roundtrip", "schulduhr", "plateau"),
):
    _round_trip(_name, _codec, _source)


def payload_sizes(spark, sf_dir):
    """Real payloads of three codecs, to be held against the closed forms."""
    coded = columns.encode(columns.series_bytes(series.supplier_quantities(spark, sf_dir)), ["sprintz_d", "core_delta", "core_deployable"], fail=True)
    return longs(coded.select("series_id", "codec", "n_bytes", F.octet_length("payload").alias("coded")))


# the explicit predictor is a stream in the host profile too; its packed records beat range coding at these widths or not, so only closed forms are compared
ORACLES["payload_sizes_closed_form"] = f"""WITH st AS ({sql.stream_sizes(sql.SUPPLIER_SERIES, "li")} SELECT * FROM streams), co AS ({sql.compact_sizes(sql.SUPPLIER_SERIES, "li")} SELECT * FROM sizes)
SELECT series_id, 'sprintz_d' AS codec, orig_bytes AS n_bytes, packed_bytes + 5 AS coded FROM co
UNION ALL SELECT series_id, 'core_deployable', 2 * n, stream_bytes FROM st"""


def payload_sizes_closed_form(spark, sf_dir):
    """The sizes of real payloads, where a closed form tells them too."""
    return payload_sizes(spark, sf_dir).where("codec <> 'core_delta'")


QUERIES["payload_sizes_closed_form"] = payload_sizes_closed_form


def tick8_roundtrip(spark, sf_dir):
    ticks = series.user_ticks(spark, sf_dir)
    back = columns.decode(columns.encode(columns.tick_bytes(ticks), ["core_tick8"], fail=True), fail=True)
    at = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("data") / 8).cast("int") - 1))
    word = lambda start: bits.little_endian(F.col("data"), F.col("idx") * 8 + start, 4)
    rows = back.select("series_id", "data", at.alias("idx")).select("series_id", "idx", word(0).alias("ts"), bits.wrap32(word(4)).alias("px"))
    return longs(rows)


QUERIES["tick8_roundtrip"], ORACLES["tick8_roundtrip"] = tick8_roundtrip, ORACLES["tick8_inverse"]


def sprintz_mv_size(spark, sf_dir):
    coded = columns.sprintz_multi(series.embedding_steps(spark, sf_dir), 64)
    return longs(coded.select("series_id", "n", F.octet_length("payload").alias("coded"), "intact"))


QUERIES["sprintz_mv_size"] = sprintz_mv_size
ORACLES["sprintz_mv_size"] = f"""WITH u AS (SELECT vec_id, unnest(range(64)) AS dim, embedding FROM embeddings),
mv AS (SELECT (vec_id // 100) * 1000 + dim AS series_id, vec_id % 100 AS step, CAST(greatest(-32768, least(32767, floor(CAST(embedding[CAST(dim + 1 AS BIGINT)] AS DOUBLE) * 32767 + 0.5))) AS BIGINT) AS x FROM u),
sx AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY step) - 1 AS idx, x FROM mv), {sql.residuals("sx")}, {sql.packed()}
SELECT series_id // 1000 AS series_id, CAST(sum(samples) AS BIGINT) AS n, CAST(5 + ceil(sum(bits) / 8.0) AS BIGINT) AS coded, true AS intact FROM p GROUP BY series_id // 1000"""


def header_fields(spark, sf_dir):
    """Headers of deployable streams, parsed by byte expressions."""
    coded = columns.encode(columns.series_bytes(series.supplier_quantities(spark, sf_dir)), ["core_deployable"], fail=True)
    return longs(columns.parse_headers(coded).select("series_id", "version", "flags", "orig_len", "coded_len", "weight_id"))


QUERIES["header_fields"] = header_fields
ORACLES["header_fields"] = f"""{sql.stream_sizes(sql.SUPPLIER_SERIES, "li")}
SELECT series_id, CAST(1 AS BIGINT) AS version, CAST(50 AS BIGINT) AS flags, 2 * n AS orig_len, stream_bytes - 32 AS coded_len, CAST(1313162060 AS BIGINT) AS weight_id FROM streams"""


def push_stream_roundtrip(spark, sf_dir):
    """Series pushed in slices of 17 bytes through keyed encoder state, and their payloads through keyed decoder state."""
    from ..streaming import processors

    data = columns.series_bytes(series.user_cents(spark, sf_dir))
    slices = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / 17).cast("int"))
    rows = data.select(F.col("series_id").alias("key"), "data", slices.alias("n")).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("key", F.col("seq").cast("long").alias("seq"), F.substring(F.col("data"), F.col("seq") * 17 + 1, F.lit(17)).alias("data"), (F.col("seq") == F.col("n") - 1).alias("last"))
    coded = processors.run(rows, "encode").select("key", "seq", "data", F.col("done").alias("last"))
    back = processors.run(coded, "decode").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    texts = F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")  # joined in one go
    whole = back.select(F.col("key").alias("series_id"), F.lit("push").alias("codec"), F.unhex(texts).alias("data"))
    return longs(columns.samples_of(whole.withColumn("error", F.lit(0))).select("series_id", "idx", "x"))


QUERIES["push_stream_roundtrip"], ORACLES["push_stream_roundtrip"] = push_stream_roundtrip, SOURCE["user"][1]


def dna2_roundtrip(spark, sf_dir):
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [genome.dna2_encode(d.encode()) for d in batch.column("dna").to_pylist()]
            back = [genome.dna2_decode(p).decode() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back), pa.array([len(p) for p in packed], pa.int64())], names=["doc_id", "dna", "coded"])

    return dna(spark, sf_dir).mapInArrow(run, "doc_id long, dna string, coded long")


QUERIES["dna2_roundtrip"], ORACLES["dna2_roundtrip"] = dna2_roundtrip, f"WITH {DNA} SELECT doc_id, dna, CAST(4 + (length(dna) + 3) // 4 AS BIGINT) AS coded FROM dna"


def fastq4_roundtrip(spark, sf_dir):
    """Documents as sequencing records, packed and unpacked again."""
    from collections.abc import Iterator

    import pyarrow as pa

    reads = dna(spark, sf_dir).select("doc_id", F.concat(F.lit("@r"), F.col("doc_id").cast("string"), F.lit("\n"), "dna", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("dna")), F.lit("\n")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [genome.fastq4_encode(r.encode()) for r in batch.column("record").to_pylist()]
            back = [genome.fastq4_decode(p).decode() for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back), pa.array([len(p) for p in packed], pa.int64())], names=["doc_id", "record", "coded"])

    return reads.mapInArrow(run, "doc_id long, record string, coded long")


QUERIES["fastq4_roundtrip"] = fastq4_roundtrip
ORACLES["fastq4_roundtrip"] = f"""WITH {DNA} SELECT doc_id, '@r' || doc_id || chr(10) || dna || chr(10) || '+' || chr(10) || repeat('I', length(dna)) || chr(10) AS record,
CAST(8 + 2 + 2 + length(CAST(doc_id AS VARCHAR)) + 4 + (length(dna) + 3) // 4 + 2 + 1 + length(dna) AS BIGINT) AS coded FROM dna"""


def crc32_documents(spark, sf_dir):
    return series.read(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


QUERIES["crc32_documents"] = crc32_documents
ORACLES["crc32_documents"] = """WITH RECURSIVE steps(n, c, k) AS (
  SELECT CAST(i AS BIGINT), CAST(i AS BIGINT), 0 FROM range(256) r(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tbl AS (SELECT list(c ORDER BY n) AS l FROM steps WHERE k = 8),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, l[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM b, tbl"""


def tag_counters(spark, sf_dir):
    """(series_id, codec, tag, n): how the program and clock codecs covered each series; counters are each call's own."""
    from collections import Counter
    from collections.abc import Iterator

    import pyarrow as pa

    from ..operators.codecs import peers, residual

    names = {peers.HOLD: "hold", peers.RAMP: "ramp", peers.RECALL: "recall", peers.RAW: "raw"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(batch.column("series_id").to_pylist(), batch.column("data").to_pylist()):
                programs, clock, x = Counter(), Counter(), residual.samples(data)
                peers.proglz_encode(x, programs)
                peers.schulduhr_encode(x, clock)
                rows += [(key, "proglz", names[t], n) for t, n in programs.items()] + [(key, "schulduhr", t, n) for t, n in clock.items()]
            columns_ = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["series_id", "codec", "tag", "n"])

    return columns.series_bytes(plateaus(spark, sf_dir)).mapInArrow(run, "series_id long, codec string, tag string, n long")


QUERIES["tag_counters"] = tag_counters
