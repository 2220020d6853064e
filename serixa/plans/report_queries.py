"""Reports over ratio tables: pivots, best codecs, scorecards, joins and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sizes, transforms
from ..sources import generators, series
from . import sql
from .series_queries import ORACLES, QUERIES, longs

#: Preference among codecs of equal ratio.
PEERS = ["core", "sprintz_d", "deployable", "store"]


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def wide_rows(spark, sf_dir) -> DataFrame:
    """(corpus, orig, and the coded bytes of each codec): closed-form sizes of every user and supplier series, in one pass."""
    parts = []
    for kind, make in (("user", series.user_cents), ("supplier", series.supplier_quantities)):
        rows = sizes.both_sizes(transforms.delta(make(spark, sf_dir)))
        coded = {"core": F.when(F.col("eligible"), F.col("compact_bytes")).otherwise(F.col("stream_bytes")), "sprintz_d": F.col("packed_bytes") + 5, "deployable": F.col("stream_bytes"), "store": F.col("orig_bytes") + 34}
        parts.append(rows.select(F.concat(F.lit(f"{kind}_"), F.col("series_id").cast("string")).alias("corpus"), F.col("orig_bytes").alias("orig"), *(coded[c].cast("long").alias(c) for c in PEERS)))
    return parts[0].unionByName(parts[1])


def ratio_of(codec: str) -> Column:
    return one_decimal(F.lit(100.0) * F.col(codec) / F.col("orig"))


def ratio_rows(spark, sf_dir) -> DataFrame:
    """(corpus, codec, orig, coded, ratio): a row per series and codec."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(c).alias("coded")) for c in PEERS)))
    both = wide_rows(spark, sf_dir).select("corpus", "orig", each.alias("r")).select("corpus", "r.codec", "orig", "r.coded")
    return longs(both).withColumn("ratio", one_decimal(F.lit(100.0) * F.col("coded") / F.col("orig")))


def _sizes(kind: str, source: tuple[str, str]) -> str:
    return f"""SELECT '{kind}_' || c.series_id AS corpus, orig_bytes AS orig, CASE WHEN eligible THEN compact_bytes ELSE stream_bytes END AS core, packed_bytes + 5 AS sprintz_d, stream_bytes AS deployable, orig_bytes + 34 AS store
FROM ({sql.compact_sizes(*source)} SELECT * FROM sizes) c JOIN ({sql.stream_sizes(*source)} SELECT * FROM streams) s USING (series_id)"""


RATIOS = f"""wide AS ({_sizes("user", (sql.USER_SERIES, "ev"))} UNION ALL {_sizes("supplier", (sql.SUPPLIER_SERIES, "li"))}),
tall AS (UNPIVOT wide ON core, sprintz_d, deployable, store INTO NAME codec VALUE coded),
ratios AS (SELECT corpus, codec, orig, CAST(coded AS BIGINT) AS coded, floor(100.0::DOUBLE * coded / orig * 10 + 0.5) / 10 AS ratio FROM tall)"""


def _add(name: str, f, oracle: str | None) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLES[name] = oracle


_add("ratio_table", ratio_rows, f"WITH {RATIOS} SELECT corpus, codec, orig, coded, ratio FROM ratios")


def ratio_pivot(spark, sf_dir):
    return wide_rows(spark, sf_dir).select("corpus", *(ratio_of(c).alias(c) for c in PEERS))


_add("ratio_pivot", ratio_pivot, f"WITH {RATIOS} SELECT corpus, {', '.join(f'max(ratio) FILTER (codec = {p!r}) AS {p}' for p in PEERS)} FROM ratios GROUP BY corpus")


def best_codec(spark, sf_dir):
    """The codec of the least ratio; of equal ones the first among the peers."""
    options = F.least(*(F.struct(ratio_of(c).alias("ratio"), F.lit(i).alias("rank"), F.lit(c).alias("codec")) for i, c in enumerate(PEERS)))
    return wide_rows(spark, sf_dir).select("corpus", options.alias("o")).select("corpus", F.col("o.codec").alias("best"), F.col("o.ratio").alias("ratio"))


_add("best_codec", best_codec, f"WITH {RATIOS} SELECT corpus, arg_min(codec, ratio * 100 + list_position({PEERS}, codec)) AS best, min(ratio) AS ratio FROM ratios GROUP BY corpus")


def scorecard(spark, sf_dir):
    """Per kind of corpus: how often the core codec is smaller than a store, and no worse than its peer."""
    wide = ratio_pivot(spark, sf_dir)
    kind = F.regexp_extract("corpus", "^([a-z]+)_", 1)
    return wide.groupBy(kind.alias("kind")).agg(F.count_if(F.col("core") < F.col("store")).alias("wins_store"), F.count_if(F.col("core") <= F.col("sprintz_d") + 0.05).alias("wins_sprintz"), F.count("*").alias("total"))


_add(
    "scorecard",
    scorecard,
    f"""WITH {RATIOS}, w AS (SELECT corpus, max(ratio) FILTER (codec = 'core') AS core, max(ratio) FILTER (codec = 'store') AS store, max(ratio) FILTER (codec = 'sprintz_d') AS sp FROM ratios GROUP BY corpus)
SELECT regexp_extract(corpus, '^([a-z]+)_', 1) AS kind, count(*) FILTER (core < store) AS wins_store, count(*) FILTER (core <= sp + 0.05) AS wins_sprintz, count(*) AS total FROM w GROUP BY 1""",
)


def profile_delta_pp(spark, sf_dir):
    """Deployable rows with the host's, where there is one: points gained, and whether the deployable ratio warns."""
    host, deployable = F.when(ratio_of("core") < 100, ratio_of("core")), ratio_of("deployable")
    rows = wide_rows(spark, sf_dir).select("corpus", deployable.alias("deployable"), host.alias("host"))
    return rows.select("corpus", "deployable", "host", one_decimal(F.col("host") - F.col("deployable")).alias("delta_pp"), (F.col("deployable") > 95).alias("warns"))


_add(
    "profile_delta_pp",
    profile_delta_pp,
    f"""WITH {RATIOS}, d AS (SELECT corpus, ratio AS deployable FROM ratios WHERE codec = 'deployable'), h AS (SELECT corpus, ratio AS host FROM ratios WHERE codec = 'core' AND ratio < 100)
SELECT corpus, deployable, host, floor((host - deployable) * 10 + 0.5) / 10 AS delta_pp, deployable > 95 AS warns FROM d LEFT JOIN h USING (corpus)""",
)


def suite_rows(spark, sf_dir):
    """The rows of a fixed suite of corpora that have a core ratio, in the suite's order."""
    suite = spark.createDataFrame([(f"supplier_{i}", i) for i in (7, 3, 9, 10**9)] + [("user_1", 4)], "corpus string, place long")
    have = ratio_rows(spark, sf_dir).where("codec = 'core'")
    return have.join(F.broadcast(suite), "corpus").select("place", "corpus", "ratio").orderBy("place")  # five rows


_add("suite_rows", suite_rows, f"WITH {RATIOS}, s(corpus, place) AS (VALUES ('supplier_7', 7), ('supplier_3', 3), ('supplier_9', 9), ('supplier_1000000000', 1000000000), ('user_1', 4)) SELECT CAST(place AS BIGINT) AS place, corpus, ratio FROM ratios JOIN s USING (corpus) WHERE codec = 'core'")


def roi(rows: DataFrame, interval_s=300.0, batch=12, sample_bytes=2, header=12, devices=500, years=5.0, eur_per_mb=0.50, tx_share=0.60, battery_years=4.0, service_eur=55.0) -> DataFrame:
    """Fleet transmission and service costs with and without coding, for each row's ratio in percent."""
    sent = 365.25 * 24.0 * 3600.0 / interval_s / batch
    raw, coded = header + batch * sample_bytes, header + batch * sample_bytes * (F.col("ratio") / 100.0)
    fleet = devices * years / (1024 * 1024)
    energy = (1.0 - tx_share) + tx_share * (coded / raw)
    life = battery_years / energy
    data_eur = (raw - coded) * sent * fleet * eur_per_mb
    service = (years / battery_years - years / life) * service_eur * devices
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    return rows.select("corpus", "ratio", cents(F.lit(raw * sent * fleet)).alias("mb_raw"), cents(coded * sent * fleet).alias("mb_coded"), cents(data_eur).alias("eur_data"), cents(life).alias("battery_years"), cents(service).alias("eur_service"), cents(data_eur + service).alias("eur_total"))


def with_fallback(spark, sf_dir) -> DataFrame:
    """Deployable ratios of the users' series, 59.9 where it isn't below 100."""
    ratio = ratio_of("deployable")
    return wide_rows(spark, sf_dir).where("corpus like 'user%'").select("corpus", F.when(ratio < 100, ratio).otherwise(F.lit(59.9)).alias("ratio"))


def roi_model(spark, sf_dir):
    return roi(with_fallback(spark, sf_dir))


_FLEET = "365.25 * 24.0 * 3600.0 / 300.0 / 12 * 500 * 5.0 / (1024 * 1024)"
_add(
    "roi_model",
    roi_model,
    f"""WITH {RATIOS}, t AS (SELECT corpus, CAST(CASE WHEN ratio < 100 THEN ratio ELSE 59.9 END AS DOUBLE) AS ratio FROM ratios WHERE codec = 'deployable' AND corpus LIKE 'user%'),
m AS (SELECT corpus, ratio, CAST(12 + 24 * ratio / 100 AS DOUBLE) AS coded, CAST({_FLEET} AS DOUBLE) AS fleet FROM t),
n AS (SELECT *, 4.0::DOUBLE / (0.4::DOUBLE + 0.6::DOUBLE * coded / 36) AS life, (36 - coded) * fleet * 0.5::DOUBLE AS data FROM m),
o AS (SELECT *, (5.0::DOUBLE / 4.0 - 5.0 / life) * 55.0 * 500 AS service FROM n)
SELECT corpus, ratio, floor(36 * fleet * 100 + 0.5) / 100 AS mb_raw, floor(coded * fleet * 100 + 0.5) / 100 AS mb_coded, floor(data * 100 + 0.5) / 100 AS eur_data, floor(life * 100 + 0.5) / 100 AS battery_years,
  floor(service * 100 + 0.5) / 100 AS eur_service, floor((data + service) * 100 + 0.5) / 100 AS eur_total FROM o""",
)


def payload_rate(spark, sf_dir):
    """Bytes a second of seven 16-bit axes at 1 kHz, at each supplier's deployable ratio."""
    rows = ratio_rows(spark, sf_dir).where("codec = 'deployable' and corpus like 'supplier%'")
    return rows.select("corpus", F.lit(14000).cast("long").alias("raw_rate"), F.floor(F.lit(14000.0) * F.col("ratio") / 100 + 0.5).cast("long").alias("coded_rate"), F.floor(100 - F.col("ratio") + 0.5).cast("long").alias("saved_percent"))


_add("payload_rate", payload_rate, f"WITH {RATIOS} SELECT corpus, CAST(14000 AS BIGINT) AS raw_rate, CAST(floor(14000.0::DOUBLE * ratio / 100 + 0.5) AS BIGINT) AS coded_rate, CAST(floor(100 - ratio + 0.5) AS BIGINT) AS saved_percent FROM ratios WHERE codec = 'deployable' AND corpus LIKE 'supplier%'")


SAMPLE_PEERS, BYTES_PEERS = ["drh", "sprintz_d", "proglz", "schulduhr"], ["windowed", "lz4", "deflate", "zstd"]
#: Frontends of the corpora that aren't 16-bit samples.
FRONTENDS = {"ticks": "core_tick8", "ticks_16k": "core_tick8", "logline_16k": "core_bytes", "random_16k": "core_bytes"}


def corpus_ratios(spark, sf_dir, names: list[str] | None = None, peers: list[str] | None = None):
    """(corpus, codec, orig, coded, intact): real payload sizes of generated corpora under every codec that takes them.

    Each payload is made once and verified by its round trip in the same task.
    """
    import zlib
    from collections.abc import Iterator

    import pyarrow as pa

    from ..operators.codecs import CODECS
    from ..operators.codecs.byte_peers import FRONT

    wanted = SAMPLE_PEERS + BYTES_PEERS if peers is None else peers
    pairs = []
    for name in names or list(generators.CORPORA):
        core = FRONTENDS.get(name, "core")
        pairs += [(name, c) for c in (core, f"{core}_deployable", *(p for p in wanted if core == "core" or p in BYTES_PEERS))]
    schema = "corpus string, codec string, orig long, coded long, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, codec in zip(batch.column("corpus").to_pylist(), batch.column("codec").to_pylist()):
                data = generators.CORPORA[name]()
                payload = CODECS[codec][0](data)
                back = CODECS[codec][1](payload)
                rows.append((name, codec, len(data), len(payload) - FRONT.get(codec, 0), zlib.crc32(back) == zlib.crc32(data) and back == data))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return spark.createDataFrame(pairs, "corpus string, codec string").repartition(len(pairs), "corpus", "codec").mapInArrow(run, schema)


#: Published sizes of the generated corpora.
PUBLISHED = """harness128 core 128 106|harness128 drh 128 15|harness128 sprintz_d 128 106|harness128 proglz 128 111|harness128 schulduhr 128 36
timeseries_i16 core 160000 93932|timeseries_i16 core_deployable 160000 95209|timeseries_i16 drh 160000 119842|timeseries_i16 sprintz_d 160000 93932|timeseries_i16 proglz 160000 104866|timeseries_i16 schulduhr 160000 408694
timeseries_16k core 16384 9627|timeseries_16k drh 16384 12273|timeseries_16k sprintz_d 16384 9627|timeseries_16k proglz 16384 10771|timeseries_16k schulduhr 16384 41852
ticks core_tick8 144000 35257|ticks core_tick8_deployable 144000 145158|ticks_16k core_tick8 16384 4027|logline_16k core_bytes 16384 9707|random_16k core_bytes 16384 16544
joint_7axis_1khz_10s core 140000 41074|joint_7axis_1khz_10s core_deployable 140000 45193|joint_7axis_1khz_10s drh 140000 80284|joint_7axis_1khz_10s sprintz_d 140000 44071|joint_7axis_1khz_10s proglz 140000 57370|joint_7axis_1khz_10s schulduhr 140000 321826
harness128 windowed 128 144|harness128 lz4 128 130|timeseries_i16 windowed 160000 166699|timeseries_i16 lz4 160000 160629|timeseries_16k windowed 16384 17060|timeseries_16k lz4 16384 16450
ticks windowed 144000 73769|ticks lz4 144000 86175|ticks_16k windowed 16384 8492|ticks_16k lz4 16384 10448|logline_16k windowed 16384 1693|logline_16k lz4 16384 102
random_16k windowed 16384 18393|random_16k lz4 16384 16450|joint_7axis_1khz_10s windowed 140000 144184|joint_7axis_1khz_10s lz4 140000 103638"""
PUBLISHED = [(a, b, int(c), int(d)) for a, b, c, d in (x.split() for x in PUBLISHED.replace("\n", "|").split("|"))]


def corpus_ratios_published(spark, sf_dir):
    """corpus_ratios, where published sizes are known."""
    known = spark.createDataFrame([(a, b) for a, b, *_ in PUBLISHED], "corpus string, codec string")
    return corpus_ratios(spark, sf_dir, peers=[*SAMPLE_PEERS, "windowed", "lz4"]).join(F.broadcast(known), ["corpus", "codec"])  # some fifty rows


_add("corpus_ratios_published", corpus_ratios_published, "SELECT * FROM (VALUES " + ", ".join(f"({a!r}, {b!r}, {c}::BIGINT, {d}::BIGINT, true)" for a, b, c, d in PUBLISHED) + ") t(corpus, codec, orig, coded, intact)")


def ratio_lines_scan(spark, sf_dir):
    """The ratio table printed as a harness's lines and read back from them."""
    from ..sources import scans, sinks

    return scans.ratio_lines(sinks.fixed_width(ratio_rows(spark, sf_dir)))


_add("ratio_lines_scan", ratio_lines_scan, f"WITH {RATIOS} SELECT corpus, codec, orig, coded, printf('%.1f%%', round(100.0::DOUBLE * coded / orig, 1)) AS ratio FROM ratios")


def record_kinds(spark, sf_dir):
    """How many zero, packed and stored records the suppliers' deployable streams have."""
    from .series_queries import plateaus

    keys = ("series_id", "chunk")
    records = sizes.packed_bits(sizes.blocks(transforms.delta(plateaus(spark, sf_dir)), tile=sizes.CHUNK), keys)
    packed = sizes.whole_bytes(F.col("bits"))
    kind = F.when(F.col("all_zero"), "zero").when((packed < 2 * F.col("samples")) & (packed <= 255), "packed").otherwise("stored")
    return longs(records.groupBy(kind.alias("kind")).agg(F.count("*").alias("records"), F.sum("samples").alias("samples")))


_add(
    "record_kinds",
    record_kinds,
    f"""WITH {sql.SUPPLIER_SERIES}, st AS (SELECT series_id, idx, CASE WHEN (idx // 64) % 3 = 0 THEN x ELSE 7 END AS x FROM li), {sql.residuals("st")}, {sql.packed("series_id, chunk", "chunk")}
SELECT CASE WHEN all_zero THEN 'zero' WHEN (bits + 7) // 8 < 2 * samples AND (bits + 7) // 8 <= 255 THEN 'packed' ELSE 'stored' END AS kind, count(*) AS records, CAST(sum(samples) AS BIGINT) AS samples FROM p GROUP BY 1""",
)


def focus_peers(spark, sf_dir):
    """Coded bytes of the focus corpora under each codec, one column a codec."""
    focus = ["timeseries_16k", "joint_7axis_1khz_10s", "harness128"]
    rows = corpus_ratios(spark, sf_dir, focus, SAMPLE_PEERS)
    return rows.groupBy("corpus").pivot("codec", ["core", "sprintz_d", "drh", "proglz", "schulduhr"]).agg(F.first("coded"))


_add(
    "focus_peers",
    focus_peers,
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([repr(n), *(f"{next(d for a, b, _, d in PUBLISHED if (a, b) == (n, c))}::BIGINT" for c in ("core", "sprintz_d", "drh", "proglz", "schulduhr"))]) + ")" for n in ("timeseries_16k", "joint_7axis_1khz_10s", "harness128")) + ") t(corpus, core, sprintz_d, drh, proglz, schulduhr)",
)


def corpus_scorecard(spark, sf_dir):
    """(peer, wins, total): how many generated corpora the core codec codes smaller than a peer, or as small."""
    rows = corpus_ratios(spark, sf_dir, peers=["windowed", "lz4", "sprintz_d"]).withColumn("codec", F.when(F.col("codec").isin(*set(FRONTENDS.values())), "core").otherwise(F.col("codec")))
    wide = rows.groupBy("corpus").pivot("codec", ["core", "windowed", "lz4", "sprintz_d"]).agg(F.first("coded"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("peer"), F.col(p).alias("coded")) for p in ("windowed", "lz4", "sprintz_d"))))
    return wide.select("core", each.alias("p")).where("p.coded is not null").groupBy("p.peer").agg(F.count_if(F.col("core") <= F.col("p.coded")).alias("wins"), F.count("*").alias("total"))


def _scores() -> str:
    core = {a: d for a, b, _, d in PUBLISHED if b in ("core", *FRONTENDS.values())}
    rows = []
    for peer in ("windowed", "lz4", "sprintz_d"):
        coded = {a: d for a, b, _, d in PUBLISHED if b == peer}
        rows.append(f"({peer!r}, {sum(core[a] <= d for a, d in coded.items())}::BIGINT, {len(coded)}::BIGINT)")
    return ", ".join(rows)


_add("corpus_scorecard", corpus_scorecard, f"SELECT * FROM (VALUES {_scores()}) t(peer, wins, total)")


#: Published code and state sizes (target, codec, flash, state), where known.
DEVICE = [("cortex-m3", "core", 4920, 2568), ("cortex-m3", "windowed", 2168, 1856), ("cortex-m3", "lz4", 4308, 0), ("cortex-m3", "deflate", 4116, 0), ("cortex-m0", "core", 5384, 2568), ("cortex-m0", "windowed", 2236, 1856), ("cortex-m0", "lz4", 6488, 0), ("cortex-m0", "deflate", 4828, 0)]


def flash_plus_payload(spark, sf_dir):
    """(corpus, codec, coded, flash, flash_plus_coded): code on the smallest target and payload of the corpora of 16 KiB."""
    names = [n for n in generators.CORPORA if n.endswith("_16k")]
    rows = corpus_ratios(spark, sf_dir, names, ["windowed", "lz4"]).where(~F.col("codec").endswith("_deployable"))
    rows = rows.withColumn("codec", F.when(F.col("codec").startswith("core"), "core").otherwise(F.col("codec")))
    flash = spark.createDataFrame([(c, f) for t, c, f, _ in DEVICE if t == "cortex-m0"], "codec string, flash long")
    return rows.join(F.broadcast(flash), "codec").select("corpus", "codec", "coded", "flash", (F.col("flash") + F.col("coded")).alias("flash_plus_coded"))  # four rows


#: Published sums of code and payload.
SUMS = [("ticks_16k", 9411, 10728, 16936), ("timeseries_16k", 15011, 19296, 22938), ("logline_16k", 15091, 3929, 6590), ("random_16k", 21928, 20629, 22938)]
_add(
    "flash_plus_payload",
    flash_plus_payload,
    "WITH s(corpus, core, windowed, lz4) AS (VALUES " + ", ".join(map(str, SUMS)) + "), t AS (UNPIVOT s ON core, windowed, lz4 INTO NAME codec VALUE total), f(codec, flash) AS (VALUES ('core', 5384), ('windowed', 2236), ('lz4', 6488)) "
    "SELECT corpus, codec, CAST(total - flash AS BIGINT) AS coded, CAST(flash AS BIGINT) AS flash, CAST(total AS BIGINT) AS flash_plus_coded FROM t JOIN f USING (codec)",
)


def host_timing(spark, sf_dir, corpus: str = "timeseries_16k", loops: int = 40, warm: int = 4):
    """(codec, orig, coded, enc_ns_med, dec_ns_med, enc_mb_s, dec_mb_s): upper medians over loops, one codec a task."""
    import time
    from collections.abc import Iterator

    import pyarrow as pa

    from ..operators.codecs import CODECS

    data = generators.CORPORA[corpus]()
    schema = "codec string, orig long, coded long, enc_ns_med long, dec_ns_med long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def median(f) -> int:
            spans = []
            for _ in range(warm + loops):
                began = time.perf_counter_ns()
                f()
                spans.append(time.perf_counter_ns() - began)
            return sorted(spans[warm:])[loops // 2]

        for batch in batches:
            for codec in batch.column("codec").to_pylist():
                encode, decode = CODECS[codec]
                payload = encode(data)
                row = [codec, len(data), len(payload), median(lambda: encode(data)), median(lambda: decode(payload))]  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=[c.split()[0] for c in schema.split(", ")])

    codecs = ["core_deployable", "core", *SAMPLE_PEERS, *BYTES_PEERS]
    rows = spark.createDataFrame([(c,) for c in codecs], "codec string").repartition(len(codecs), "codec").mapInArrow(run, schema)
    rate = lambda ns: F.col("orig") / (1 << 20) / (F.col(ns) / 1e9)
    return rows.withColumn("enc_mb_s", rate("enc_ns_med")).withColumn("dec_mb_s", rate("dec_ns_med"))


_add("host_timing", host_timing, None)
