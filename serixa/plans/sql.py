"""Pieces of SQL (DuckDB) that the oracles are put together from."""

from __future__ import annotations

USER_SERIES = """ev AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         CAST(greatest(-32768, least(32767, floor(value * 100 + 0.5))) AS BIGINT) AS x
  FROM events)"""
SUPPLIER_SERIES = """li AS (
  SELECT l_suppkey AS series_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity) - 1 AS idx,
         CAST(l_quantity AS BIGINT) AS x
  FROM lineitem)"""
TICKS = """tk AS (
  SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
         CAST(epoch_us(ts) // 1000000 AS BIGINT) AS ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS px
  FROM events)"""
ZIGZAG = "CASE WHEN {0} >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END"
WIDTH = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def residuals(source: str) -> str:
    return f"""r AS (
  SELECT *, ((x - lag(x, 1, 0) OVER (PARTITION BY series_id ORDER BY idx) + 32768) & 65535) - 32768 AS d FROM {source}),
z AS (SELECT *, {ZIGZAG.format("d")} AS z FROM r)"""


def packed(keys: str = "series_id", tile: str = "") -> str:
    """p(keys, bits, samples, all_zero) from z."""
    chunk = "idx // 128 AS chunk, " if tile else ""
    group = "series_id, chunk, block" if tile else "series_id, block"
    return f"""w AS (SELECT series_id, {chunk}idx // 8 AS block, {WIDTH.format("z")} AS nbits FROM z),
b AS (SELECT {group}, max(nbits) AS nb, count(*) AS n FROM w GROUP BY {group}),
i AS (SELECT *, block - row_number() OVER (PARTITION BY {keys} ORDER BY block) AS island FROM b WHERE nb = 0),
runs AS (SELECT {keys}, island, min(block) AS first_block, count(*) AS run FROM i GROUP BY {keys}, island),
tokens AS (SELECT {keys}, sum(13 * ceil(run / 256.0)) AS bits FROM runs GROUP BY {keys}),
full_ AS (SELECT {keys}, sum(CASE WHEN nb > 0 THEN 5 + 8 * nb ELSE 0 END) AS bits, sum(n) AS samples, max(nb) = 0 AS all_zero FROM b GROUP BY {keys}),
p AS (SELECT {", ".join("f." + k.strip() for k in keys.split(","))}, CAST(f.bits + coalesce(t.bits, 0) AS BIGINT) AS bits, CAST(samples AS BIGINT) AS samples, all_zero
      FROM full_ f LEFT JOIN tokens t ON {" AND ".join(f"f.{k.strip()} = t.{k.strip()}" for k in keys.split(","))})"""


def compact_sizes(series: str, source: str) -> str:
    return f"""WITH {series}, {residuals(source)}, {packed()},
c AS (SELECT series_id, samples AS n, 2 * samples AS orig_bytes, (bits + 7) // 8 AS packed_bytes FROM p),
sizes AS (SELECT *, packed_bytes + 5 AS compact_bytes, orig_bytes >= 64 AND packed_bytes < orig_bytes AS eligible FROM c)"""


def stream_sizes(series: str, source: str) -> str:
    return f"""WITH {series}, {residuals(source)}, {packed("series_id, chunk", "chunk")},
q AS (SELECT *, (bits + 7) // 8 AS pb, CASE WHEN samples = 128 THEN 2 ELSE 3 END AS oh FROM p),
streams AS (SELECT series_id, CAST(sum(samples) AS BIGINT) AS n,
  CAST(32 + sum(CASE WHEN all_zero THEN 2 WHEN pb < 2 * samples AND pb <= 255 THEN pb + oh ELSE 2 + 2 * samples END) AS BIGINT) AS stream_bytes
  FROM q GROUP BY series_id)"""


def fire(lists: str, forward: bool = True) -> str:
    """list of errors of a list of samples (or back) as one fold."""
    guess = "greatest(-32768, least(32767, a.p + CAST(floor((a.p - a.q) * a.gain / 256.0) AS BIGINT)))"
    e = f"((v.p - {guess} + 32768) & 65535) - 32768" if forward else "v.p"
    x = "v.p" if forward else f"(({guess} + v.p + 32768) & 65535) - 32768"
    gain = f"CASE WHEN a.p = a.q OR {e} = 0 THEN a.gain WHEN ((a.p - a.q) > 0) = (({e}) > 0) THEN least(256, a.gain + 1) ELSE greatest(0, a.gain - 1) END"
    kind = "{'p': CAST(%s AS BIGINT), 'q': CAST(%s AS BIGINT), 'gain': CAST(%s AS BIGINT), 'o': CAST(%s AS BIGINT[])}"
    start = kind % (0, 0, 256, "[]")
    each = kind % ("u", 0, 0, "[]")
    step = kind % (x, "a.p", gain, f"list_append(a.o, {e if forward else x})")
    return f"list_reduce(list_transform({lists}, lambda u: {each}), lambda a, v: {step}, {start}).o"
