"""Queries over series: transforms, widths, runs and closed-form sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import sizes, transforms
from ..sources import generators, scans, series
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as longs, so that both engines name one type."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


USERS, SUPPLIERS = (sql.USER_SERIES, "ev"), (sql.SUPPLIER_SERIES, "li")


@query(f"WITH {sql.USER_SERIES}, {sql.residuals('ev')} SELECT series_id, idx, x, d, z FROM z")
def delta_zigzag(spark, sf_dir):
    return longs(transforms.delta(series.user_cents(spark, sf_dir)).select("series_id", "idx", "x", "d", "z"))


@query(f"WITH {sql.USER_SERIES} SELECT series_id, idx, x FROM ev")
def delta_inverse(spark, sf_dir):
    coded = transforms.delta(series.user_cents(spark, sf_dir)).select("series_id", "idx", "z")
    return longs(transforms.delta_inverse(coded).select("series_id", "idx", "x"))


@query(f"WITH {sql.SUPPLIER_SERIES}, {sql.residuals('li')} SELECT series_id, idx, z FROM z")
def delta_segmented(spark, sf_dir):
    return longs(transforms.delta_by_segment(series.supplier_quantities(spark, sf_dir), 100).select("series_id", "idx", "z"))


@query(
    f"""WITH {sql.TICKS}, s AS (SELECT *, ts - lag(ts, 1, 0) OVER w AS dt, px - lag(px, 1, 0) OVER w AS dp FROM tk WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
v AS (SELECT series_id, idx, ((dt + 2147483648) & 4294967295) - 2147483648 AS dt, ((dp + 2147483648) & 4294967295) - 2147483648 AS dp FROM s)
SELECT series_id, idx, {sql.ZIGZAG.format("dt")} AS zts, {sql.ZIGZAG.format("dp")} AS zpx FROM v"""
)
def tick8_residuals(spark, sf_dir):
    return longs(transforms.tick_residuals(series.user_ticks(spark, sf_dir)).select("series_id", "idx", "zts", "zpx"))


@query(f"WITH {sql.TICKS} SELECT series_id, idx, ts, px FROM tk")
def tick8_inverse(spark, sf_dir):
    coded = transforms.tick_residuals(series.user_ticks(spark, sf_dir)).select("series_id", "idx", "zts", "zpx")
    return longs(transforms.tick_inverse(coded).select("series_id", "idx", "ts", "px"))


FIRE = f"WITH {sql.USER_SERIES}, l AS (SELECT series_id, list(x ORDER BY idx) AS xs FROM ev GROUP BY series_id), e AS (SELECT series_id, {sql.fire('xs')} AS es FROM l)"


@query(f"{FIRE} SELECT series_id, CAST(i - 1 AS BIGINT) AS idx, CAST(es[i] AS BIGINT) AS e FROM e, LATERAL (SELECT unnest(range(1, len(es) + 1)) AS i)")
def fire_residuals(spark, sf_dir):
    arrays = transforms.fire_arrow(transforms.as_arrays(series.user_cents(spark, sf_dir)))
    return longs(arrays.select("series_id", F.posexplode("es").alias("idx", "e")))


@query(ORACLES["delta_inverse"])
def fire_inverse(spark, sf_dir):
    arrays = transforms.fire_arrow(transforms.as_arrays(series.user_cents(spark, sf_dir)))
    back = transforms.fire_arrow(arrays, False)
    return longs(back.select("series_id", F.posexplode("xs").alias("idx", "x")))


@query(f"WITH {sql.SUPPLIER_SERIES}, {sql.residuals('li')}, {sql.packed()} SELECT series_id, block, CAST(nb AS BIGINT) AS nb, n FROM b")
def block_bitwidth(spark, sf_dir):
    return longs(sizes.blocks(transforms.delta(series.supplier_quantities(spark, sf_dir))))


@query(f"WITH {sql.SUPPLIER_SERIES}, {sql.residuals('li')}, {sql.packed()} SELECT CAST(nb AS BIGINT) AS nb, count(*) AS blocks FROM b GROUP BY nb")
def bitwidth_histogram(spark, sf_dir):
    widths = sizes.blocks(transforms.delta(series.supplier_quantities(spark, sf_dir)))
    return longs(widths.groupBy("nb").agg(F.count("*").alias("blocks")))


STEPS = "st AS (SELECT series_id, idx, CASE WHEN (idx // 64) % 3 = 0 THEN x ELSE 7 END AS x FROM li)"


def plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier series with two of three stretches of 64 held level."""
    return series.supplier_quantities(spark, sf_dir).withColumn("x", F.when(F.floor(F.col("idx") / 64) % 3 == 0, F.col("x")).otherwise(F.lit(7)))


@query(f"WITH {sql.SUPPLIER_SERIES}, {STEPS}, {sql.residuals('st')}, {sql.packed()} SELECT series_id, first_block, run, CAST(ceil(run / 256.0) AS BIGINT) AS tokens FROM runs")
def zero_run_tokens(spark, sf_dir):
    return longs(sizes.zero_runs(sizes.blocks(transforms.delta(plateaus(spark, sf_dir))), ("series_id",)))


COMPACT = "SELECT series_id, n, orig_bytes, packed_bytes, compact_bytes, eligible FROM sizes"


@query(f"{sql.compact_sizes(*SUPPLIERS)} {COMPACT}")
def compact_size_by_supplier(spark, sf_dir):
    return longs(sizes.compact_sizes(transforms.delta(series.supplier_quantities(spark, sf_dir))))


@query(f"{sql.compact_sizes(*USERS)} {COMPACT}")
def compact_size_by_user(spark, sf_dir):
    return longs(sizes.compact_sizes(transforms.delta(series.user_cents(spark, sf_dir))))


@query(f"{sql.compact_sizes(sql.SUPPLIER_SERIES + ', ' + STEPS, 'st')} {COMPACT}")
def compact_size_of_plateaus(spark, sf_dir):
    return longs(sizes.compact_sizes(transforms.delta(plateaus(spark, sf_dir))))


@query(f"{sql.stream_sizes(*USERS)} SELECT * FROM streams")
def stream_size_by_user(spark, sf_dir):
    return longs(sizes.stream_sizes(transforms.delta(series.user_cents(spark, sf_dir))))


@query(f"{sql.stream_sizes(*SUPPLIERS)} SELECT * FROM streams")
def stream_size_by_supplier(spark, sf_dir):
    return longs(sizes.stream_sizes(transforms.delta(series.supplier_quantities(spark, sf_dir))))


@query(
    f"""WITH {sql.SUPPLIER_SERIES}, l AS (SELECT series_id, list(x ORDER BY idx) AS xs FROM li GROUP BY series_id), e AS (SELECT series_id, {sql.fire("xs")} AS es FROM l),
f AS (SELECT series_id, i - 1 AS idx, es[i] AS d FROM e, LATERAL (SELECT unnest(range(1, len(es) + 1)) AS i)),
z AS (SELECT *, {sql.ZIGZAG.format("d")} AS z FROM f), {sql.packed()},
fs AS (SELECT series_id, (bits + 7) // 8 + 5 AS fire_bytes FROM p),
ds AS (SELECT series_id, compact_bytes AS delta_bytes FROM ({sql.compact_sizes(*SUPPLIERS)} SELECT * FROM sizes))
SELECT series_id, delta_bytes, fire_bytes, CASE WHEN fire_bytes < delta_bytes THEN 'fire' ELSE 'delta' END AS best FROM ds JOIN fs USING (series_id)"""
)
def delta_vs_fire_best(spark, sf_dir):
    rows = series.supplier_quantities(spark, sf_dir)
    plain = sizes.compact_sizes(transforms.delta(rows)).select("series_id", F.col("compact_bytes").alias("delta_bytes"))
    errors = transforms.fire_arrow(transforms.as_arrays(rows)).select("series_id", F.posexplode("es").alias("idx", "d"))
    learned = sizes.compact_sizes(errors.withColumn("z", bits.zigzag16(F.col("d")))).select("series_id", F.col("compact_bytes").alias("fire_bytes"))
    best = F.when(F.col("fire_bytes") < F.col("delta_bytes"), "fire").otherwise("delta")
    return longs(plain.join(learned, "series_id").select("series_id", "delta_bytes", "fire_bytes", best.alias("best")))


@query("SELECT doc_id, strlen(text) AS n, strlen(text) + 32 + 2 * ((strlen(text) + 255) // 256) + 16 AS bound, CAST(0 AS BIGINT) AS scratch FROM documents")
def compress_bound(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    return longs(series.read(spark, sf_dir, "documents").select("doc_id", n.alias("n"), bits.compress_bound(n).alias("bound"), F.lit(0).alias("scratch")))


@query(
    f"""WITH {sql.SUPPLIER_SERIES}, {STEPS}, s AS (SELECT *, x = lag(x) OVER (PARTITION BY series_id ORDER BY idx) AS same FROM st),
g AS (SELECT series_id, count(*) AS n, count(*) FILTER (idx BETWEEN 1 AND 255) AS checks, count(*) FILTER (idx BETWEEN 1 AND 255 AND same) AS same FROM s GROUP BY series_id)
SELECT series_id, checks, same, n >= 32 AND checks > 0 AND 5 * same >= 2 * checks AS friendly FROM g"""
)
def lz_friendly(spark, sf_dir):
    return longs(sizes.lz_friendly(plateaus(spark, sf_dir)))


@query("SELECT event_id, CAST(greatest(-32767, least(32767, round_even(value * 100, 0))) AS BIGINT) AS x FROM events")
def csv_scale_clamp(spark, sf_dir):
    return longs(series.read(spark, sf_dir, "events").select("event_id", scans.scaled(F.col("value").cast("string")).alias("x")))


@query(
    """WITH m AS (SELECT l_suppkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(greatest(-32767, least(32767, round_even((l_extendedprice - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END * 65534.0 - 32767.0, 0))) AS BIGINT) AS x
FROM lineitem JOIN m USING (l_suppkey)"""
)
def minmax_to_i16(spark, sf_dir):
    rows = series.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.select("l_suppkey", F.col("l_orderkey"), F.col("l_linenumber"), "l_extendedprice").transform(lambda d: scans.min_max_to_int16(d, "l_extendedprice", ("l_suppkey",))).withColumn("x", F.col("x").cast("long"))


JOINTS = ", ".join(f"({a}, {amp}, {freq}, {phase})" for a, (amp, freq, phase) in enumerate(generators.JOINTS))


@query(
    f"""WITH j(axis, amp, freq, phase) AS (VALUES {JOINTS}), t AS (SELECT unnest(range(10000)) AS i)
SELECT CAST(axis AS BIGINT) AS axis, i, CAST(round_even(amp * sin(2 * pi() * freq * (i / 1000.0::DOUBLE) + phase), 0) AS BIGINT) + (17 * i + 31 * axis) % 5 - 2 AS x FROM j, t"""
)
def joint_telemetry(spark, sf_dir):
    return longs(generators.joint_rows(spark))


@query("SELECT i, (3 * i) & 255 AS b FROM (SELECT unnest(range(128)) AS i)")
def harness_bytes(spark, sf_dir):
    return longs(generators.harness_rows(spark))


@query("SELECT i, CAST(ascii(substr('sensor;id=12;temp=21.50;ok' || chr(10), CAST(i % 27 + 1 AS BIGINT), 1)) AS BIGINT) AS b FROM (SELECT unnest(range(16384)) AS i)")
def logline_bytes(spark, sf_dir):
    return longs(generators.logline_rows(spark))


DNA = "dna AS (SELECT doc_id, translate(lower(hex(encode(text))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS dna FROM documents)"


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dna): every whole text as bases, two a byte."""
    return series.read(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower(F.hex(F.col("text").cast("binary"))), "0123456789abcdef", "ACGTACGTACGTACGT").alias("dna"))


@query(
    f"""WITH {DNA}, l AS (SELECT doc_id, regexp_extract_all(dna, '.{{1,4}}') AS l FROM dna), e AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS four FROM l)
SELECT doc_id, i AS at, CAST(sum_of AS BIGINT) AS b FROM (SELECT *, greatest(0, strpos('ACGT', four[1]) - 1) + CASE WHEN length(four) > 1 THEN 4 * (strpos('ACGT', four[2]) - 1) ELSE 0 END
  + CASE WHEN length(four) > 2 THEN 16 * (strpos('ACGT', four[3]) - 1) ELSE 0 END + CASE WHEN length(four) > 3 THEN 64 * (strpos('ACGT', four[4]) - 1) ELSE 0 END AS sum_of FROM e)"""
)
def dna2_pack(spark, sf_dir):
    fours = F.posexplode(F.expr("regexp_extract_all(dna, '.{1,4}', 0)")).alias("at", "four")
    rows = dna(spark, sf_dir).where(F.col("dna").rlike("^[ACGT]*$")).select("doc_id", fours)
    part = lambda k: F.greatest(F.lit(0), F.instr(F.lit("ACGT"), F.substring("four", k + 1, 1)) - 1) * (1 << 2 * k)
    return longs(rows.select("doc_id", "at", sum((F.when(F.length("four") > k, part(k)).otherwise(0) for k in range(1, 4)), part(0)).alias("b")))


@query(
    """SELECT doc_id, CAST(f AS BIGINT) AS frontend, CAST(CASE f WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 64 ELSE 2 END AS BIGINT) AS flag, f IN (1, 3, 4) AS is_i16,
CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'destination too small' WHEN 2 THEN 'invalid or truncated source' WHEN 3 THEN 'crc mismatch'
  WHEN 4 THEN 'weight_id mismatch' WHEN 5 THEN 'null argument' WHEN 6 THEN 'internal error' ELSE 'unknown error' END AS message,
CASE WHEN n_chars = 0 THEN 0 ELSE (doc_id * 100) // n_chars END AS percent
FROM (SELECT doc_id, n_chars, doc_id % 5 AS f FROM documents)"""
)
def frontend_tables(spark, sf_dir):
    f = (F.col("doc_id") % 5).cast("int")
    rows = series.read(spark, sf_dir, "documents")
    return longs(
        rows.select(
            "doc_id", f.alias("frontend"), bits.frontend_flag(f).alias("flag"), bits.frontend_is_i16(f).alias("is_i16"),
            bits.error_text((-(F.col("doc_id") % 8)).cast("int")).alias("message"), bits.whole_percent(F.col("doc_id"), F.col("n_chars")).alias("percent"),
        )
    )


@query(
    f"""WITH {sql.SUPPLIER_SERIES}, w AS (SELECT series_id, idx // 32 AS "window", list(x ORDER BY idx) AS xs FROM li GROUP BY 1, 2),
f AS (SELECT *, len(xs) AS n, xs[1] AS a, xs[len(xs) // 2 + 1] AS m, xs[len(xs)] AS c FROM w),
g AS (SELECT *, a + m + c - greatest(a, m, c) - least(a, m, c) AS hold, CASE WHEN n > 1 THEN (c - a) // (n - 1) ELSE 0 END AS step FROM f),
k AS (SELECT *, list_max(list_transform(xs, lambda x: {sql.ZIGZAG.format("(x - hold)")})) AS zh,
  list_max(list_transform(range(1, n + 1), lambda i: {sql.ZIGZAG.format("(xs[i] - a - step * (i - 1))")})) AS zr FROM g)
SELECT series_id, "window", CAST(7 + 16 * n AS BIGINT) AS raw_bits, CAST(28 + n * {sql.WIDTH.format("zh")} AS BIGINT) AS hold_bits, CAST(44 + n * {sql.WIDTH.format("zr")} AS BIGINT) AS ramp_bits FROM k"""
)
def proglz_candidate_costs(spark, sf_dir):
    rows = series.supplier_quantities(spark, sf_dir).withColumn("window", F.floor(F.col("idx") / 32))
    w = rows.groupBy("series_id", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("xs"))
    n = F.size("xs")
    a, c = F.get("xs", F.lit(0)), F.element_at("xs", -1)
    m = F.get("xs", F.floor(n / 2).cast("int"))
    w = w.select("series_id", "window", "xs", n.alias("n"), a.alias("a"), (a + m + c - F.greatest(a, m, c) - F.least(a, m, c)).alias("hold"), F.when(n > 1, F.expr("(element_at(xs, -1) - xs[0]) div (size(xs) - 1)")).otherwise(0).cast("int").alias("step"))
    most = lambda guess: F.array_max(F.transform("xs", lambda x, i: bits.zigzag16(bits.wrap16(x - guess(i)))))
    hold, ramp = most(lambda i: F.col("hold")), most(lambda i: F.col("a") + F.col("step") * i)
    return longs(w.select("series_id", "window", (16 * F.col("n") + 7).alias("raw_bits"), (28 + F.col("n") * bits.bit_width(hold)).alias("hold_bits"), (44 + F.col("n") * bits.bit_width(ramp)).alias("ramp_bits")))


@query(
    """WITH l AS (SELECT user_id, list(value ORDER BY value) AS vs FROM events GROUP BY user_id) SELECT user_id, vs[len(vs) // 2 + 1] AS upper_median FROM l"""
)
def upper_median(spark, sf_dir):
    along = F.element_at(F.array_sort(F.collect_list("value")), (F.floor(F.count("value") / 2) + 1).cast("int"))
    return series.read(spark, sf_dir, "events").groupBy("user_id").agg(along.alias("upper_median"))
