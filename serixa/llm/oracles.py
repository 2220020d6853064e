"""SQL (DuckDB) for the operators that it can express; the others are tested against brute force."""

from __future__ import annotations

from .license_scan import GRAM, NOTICES, PHRASES

TOPK = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, unnest(range(0, greatest(0, length(h) // 2 - 199), 100)) AS z, h FROM d),
u AS (SELECT doc_id, z, substr(h, 2 * z + 1, 598) AS c FROM t),
w AS (SELECT doc_id, z, unnest(range(0, least(100, length(c) // 2 - 199))) AS i, c FROM u),
m AS (SELECT doc_id, z + i AS p, md5(substr(c, 2 * i + 1, 400)) AS k FROM w),
twice AS (SELECT k FROM m GROUP BY k HAVING count(*) > 1),
c AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM m SEMI JOIN twice USING (k)),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM c),
r AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
s AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""


def license_scan(slack: int = 3, share: float = 0.7) -> str:
    rows, k = [], GRAM
    for name, (words, label, exact) in enumerate([(p.split(), x, "true") for p, x in PHRASES.items()] + [(n.split(), x, "false") for x, n in NOTICES.items()]):
        count = len(words) - k + 1
        rows += [f"('{' '.join(words[i : i + k])}', {name}, '{label}', {exact}, {i}, {count})" for i in range(count)]
    return rf"""WITH t(gram, template, label, exact, "at", grams) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, greatest(0, len(w) - {k - 1}))) AS place, w FROM d),
x AS (SELECT doc_id, place, array_to_string(w[CAST(place + 1 AS BIGINT):CAST(place + {k} AS BIGINT)], ' ') AS gram FROM g),
h AS (SELECT doc_id, place, template, label, exact, "at", grams, place - "at" AS diagonal FROM x JOIN t USING (gram)),
v AS (SELECT doc_id, template, label, exact, grams, diagonal, min(place) AS first, max(place) AS last, list(DISTINCT "at") AS held FROM h GROUP BY ALL),
f AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER o > {slack}, true) THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM f),
s AS (SELECT doc_id, template, label, exact, grams, run, len(list_distinct(flatten(list(held)))) AS held, min(first) AS first, max(last) + {k - 1} AS last FROM r GROUP BY doc_id, template, label, exact, grams, run),
y AS (SELECT *, exact AND held = grams AS base, NOT exact AND held / grams >= {share}::DOUBLE AS other, CASE WHEN exact THEN 0.0 ELSE held / grams END AS met FROM s),
a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  list_sort(list(DISTINCT label) FILTER (base)) AS b, list_sort(list(DISTINCT label) FILTER (base OR other)) AS l, greatest(max(CASE WHEN base THEN 1.0 ELSE 0.0 END), max(met)) AS score,
  string_agg(label || ':' || first || '-' || last, ',' ORDER BY first, last, label) FILTER (base OR other) AS spans FROM y GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b, ','), '') AS base_labels,
  coalesce(array_to_string(l, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


MIXING = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s),
v AS (SELECT *, CAST([3, 1, 2][(turn - 1) % 3 + 1] AS DOUBLE) AS weight FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY 2::DOUBLE * source_size / weight, turn) AS k FROM v WHERE source_size > 0),
p AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(2::DOUBLE * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass FROM o),
f AS (SELECT arg_min(rest / mass, k) AS level, min(k) AS k FROM p WHERE 2::DOUBLE * source_size > rest / mass * weight),
t AS (SELECT p.source, p.source_size, CASE WHEN p.k < coalesce(f.k, p.k + 1) THEN 2::DOUBLE * source_size ELSE f.level * weight END AS target FROM p, f
  UNION ALL SELECT source, source_size, 0::DOUBLE FROM s WHERE source_size = 0),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('7/' || coalesce(d.source, '')), 1, 5) AS BIGINT) / 1048576::DOUBLE AS z,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, doc_id NULLS FIRST) - 1 AS n FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, CAST((floor(z + rate * (n + 1)) - floor(z + rate * n)) * size AS BIGINT) AS taken FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": MIXING, "op2_suffix_dedup": SUFFIX, "op3_topk_search": TOPK, "op5_license_scan": license_scan()}
