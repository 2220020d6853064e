"""Exact top-k search by columnar branch and bound.

Vectors stand in vertical layout, a row of the matrix per dimension.  A query's
inner products with a block of candidates grow dimension block by dimension
block; after each, a candidate's bound is what it has plus the product of the
masses (Euclidean norms) that remain on either side, and only candidates whose
bound reaches the k-th best score so far are kept, in compact arrays.

Queries and candidates are dealt as a grid of blocks of bounded size, and each
cell passes on k rows per query, so no task holds all of either.  There are far
fewer queries than candidates, so a block of queries is large next to their share:
most of what is copied are queries.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without an id take no part; vectors meet those of equal length only; a row
never meets rows of its own id; repeated rows are candidates one by one but ask
once, and of rows with one id and several vectors the least vector asks, in the order of
arrays; ties go to the smaller id; an empty table gives no rows; fewer than k candidates give as many ranks; columns
other than the two named are not read.  Scores are exact: vectors whose scores
might not fit are multiplied as integers of any size, and a score outside 64 bits is given as the
nearest long, in its right rank.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 1 << 13
CHUNK, DIMS = 4096, 16
#: Scores below this are added up in machine numbers.
MOST = float(1 << 62)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows other than its own id; integer vectors."""
    width = rows.shape[1]
    most = int(max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0)))
    kind = np.float64 if most * most * max(width, 1) < 1 << 52 else np.int64
    order = np.lexsort((ids, -np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64))))
    rows, ids = rows[order], ids[order]
    vertical = np.ascontiguousarray(rows.T.astype(kind))
    edges = [*range(0, width, DIMS), width]
    mass = lambda x: np.sqrt(np.array([(x[:, e:].astype(np.float64) ** 2).sum(axis=1) for e in edges]))
    row_mass, query_mass = mass(rows), mass(queries)
    out_query, out_id, out_score = [], [], []
    for q, (query, own) in enumerate(zip(queries.astype(kind), query_ids)):
        scores, names = np.zeros(0, kind), np.zeros(0, np.int64)
        least = -np.inf
        for first in range(0, len(ids), CHUNK):
            last = min(first + CHUNK, len(ids))
            alive = None  # all, until something is pruned
            part = np.zeros(last - first, kind)
            for e, (lo, hi) in enumerate(zip(edges, edges[1:])):
                block = vertical[lo:hi, first:last]
                part = part + query[lo:hi] @ (block if alive is None else block[:, alive])
                if least > -np.inf:
                    rest = row_mass[e + 1, first:last]
                    slack = query_mass[e + 1, q] * (rest if alive is None else rest[alive]) * (1 + 1e-9) + 1e-6 + abs(least) * 2.0**-50
                    stay = np.flatnonzero(part + slack >= least)
                    if len(stay) < len(part):
                        part = part[stay]
                        alive = stay if alive is None else alive[stay]
                        if not len(stay):
                            break
            found = ids[first:last] if alive is None else ids[first:last][alive]
            other = found != own
            scores, names = np.concatenate([scores, part[other]]), np.concatenate([names, found[other]])
            top = np.lexsort((names, -scores))[:k]
            scores, names = scores[top], names[top]
            if len(scores) == k:
                least = scores[-1]
        out_query.append(np.full(len(names), own))
        out_id.append(names)
        out_score.append(scores.astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(out_query), join(out_id), join(out_score)


def large_best(queries: list[list[int]], query_ids: np.ndarray, rows: list[list[int]], ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same for vectors of integers of any size."""
    vertical, out = np.array(rows, dtype=object).reshape(len(rows), -1), ([], [], [])
    for query, own in zip(queries, query_ids.tolist()):
        scores = (vertical * np.array(query, dtype=object)).sum(axis=1) if len(query) else [0] * len(rows)
        top = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != own)[:k]
        out[0].extend([own] * len(top))
        out[1].extend(i for _, i in top)
        out[2].extend(-s for s, _ in top)
    return out


def cell_best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, scale: float) -> tuple[list, list, list]:
    """(query id, id, score) of a cell of the grid, from double components; pairs with a large component go apart."""
    out = ([], [], [])
    is_large = lambda x: (np.abs(x) * abs(scale) >= np.sqrt(MOST / max(x.shape[1], 1)) - 1).any(axis=1)
    whole = lambda x: np.floor(x * scale).astype(np.int64)
    exact = lambda x: [[floor(Fraction(v) * Fraction(scale)) for v in row] for row in x.tolist()]
    large_query, large_row = is_large(queries), is_large(rows)
    for ask in (False, True):
        for meet in (False, True):
            q, r = np.flatnonzero(large_query == ask), np.flatnonzero(large_row == meet)
            if len(q) and len(r):
                some = queries[q], query_ids[q], rows[r], ids[r]
                found = large_best(exact(some[0]), some[1], exact(some[2]), some[3], k) if ask or meet else best(whole(some[0]), some[1], whole(some[2]), some[3], k)
                for held, more in zip(out, found):
                    held.extend(more if isinstance(more, list) else more.tolist())
    return out


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k best of all other rows."""
    value = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).where(whole & F.col("id").isNotNull()).withColumn("width", F.size("v"))
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("width", "v")).alias("x"))
    asks = asks.select(F.col("id").alias("id"), F.col("x.v").alias("v"), F.col("x.width").alias("width"))  # new attributes, as cogroup wants
    total = rows.count()
    down, across = max(1, -(-total // CANDIDATE_BLOCK)), max(1, -(-total // (every * QUERY_BLOCK)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asks.withColumn("q", deal("id", across)).withColumn("c", each(down))
    # by row, not by id: rows of one id may be many
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("c", deal("row", down)).drop("row").withColumn("q", each(across))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            matrix = lambda t: pa.concat_arrays(t["v"].chunks).flatten().to_numpy().reshape(t.num_rows, t["width"][0].as_py())
            found = cell_best(matrix(left), left["id"].to_numpy(), matrix(right), right["id"].to_numpy(), k, scale)
        names, (asking, ids, scores) = ("query_id", "vec_id", "score", "over"), found
        fits = [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
        # what a long can't hold is ordered by its excess, as a decimal
        return pa.table({n: pa.array(x, t) for n, x, t in zip(names, (asking, ids, fits, [str(s - f) for s, f in zip(scores, fits)]), (pa.int64(), pa.int64(), pa.int64(), pa.string()))})

    cell = ["width", "q", "c"]
    near = asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(run, "query_id long, vec_id long, score long, over string")
    # excesses order by sign, number of digits, digits; those below zero the other way round
    minus, digits = F.col("over").startswith("-"), F.regexp_replace("over", "^-", "")
    size = F.when(minus, -F.length(digits)).otherwise(F.length(digits))
    flipped = F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), size.desc(), flipped.desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
