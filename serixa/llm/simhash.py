"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are spread over tables of bit blocks: two that differ in at most
`radius` of 64 bits agree on at least blocks - radius whole blocks, so each set
of that many blocks is a table and every linked pair meets in one.  In a bucket
the fingerprints stand vertically, one bit plane after another with 64 of them
to a word; a row's distances to 64 others grow together in carry-save counters,
and words in which all exceed the radius are abandoned.

Links are never listed: a task unites what it links and passes on a spanning
forest.  Components are found by alternating star contractions, each written to
the checkpoint folder.  Nothing of this size is collected to the driver.

Defined results: a null or blank text has fingerprint zero, which links as any
other; a null id never names a component unless its component has no other id;
repeated rows each get their row; an empty table gives no rows; texts of any length
are hashed whole; columns other than the two named are not read.  Rounds of contractions go
on until nothing changes: their number grows with the logarithm of a component's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, byte_views, settle, shuffle_partitions

SEED = 42
#: Fingerprints of one bucket that a task compares at once; larger buckets are dealt as a grid of parts.
PART = 1 << 15
#: Buckets of about this size are aimed at when the number of blocks is chosen.
BUCKET = 2048


def text_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text (its words joined by one space)."""
    parts = raw.translate(ASCII_LOWER).split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, 1 << 14):
        some = hashes[first : first + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            found = np.fromiter((fingerprint(text_hashes(data[a:b].tobytes(), words)) for a, b in zip(offsets[:-1], offsets[1:])), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union of row numbers, by arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (next_ := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = next_


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes of 64-bit words; lane i of word w is bit b of value 64 w + i."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T.reshape(64, -1), axis=1, bitorder="little")).view("<u8")


def near_lanes(planes: np.ndarray, values: np.ndarray, rows: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, mask) where lanes of the word lie within the radius of the row."""
    own = values[rows]
    over = np.zeros(len(rows), dtype=np.uint64)
    counts = [over.copy() for _ in range(max(radius, 1).bit_length())]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for b in range(64):
            carry = planes[b][words] ^ (np.uint64(0) - ((own >> np.uint64(b)) & np.uint64(1)))
            for plane in counts:
                more = plane & carry
                plane ^= carry
                carry = more
            # a counter above the radius stays above: it can only grow, and `over` keeps what wraps
            over |= carry
            if b % 8 == 7 and radius <= b < 63:
                gone = over | above(counts, radius)
                alive = np.flatnonzero(gone != full)
                if len(alive) < 0.7 * len(rows):
                    rows, words, own, over, *counts = (x[alive] for x in (rows, words, own, over, *counts))
                    if not len(rows):
                        break
        near = ~(over | above(counts, radius))
    hit = np.flatnonzero(near)
    return rows[hit], words[hit], near[hit]


def above(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, a plane per bit from the lowest, exceeds the radius: compared from the highest bit down."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for bit in range(len(counts) - 1, -1, -1):
        if radius >> bit & 1:
            same &= counts[bit]
        else:
            more |= same & counts[bit]
            same &= ~counts[bit]
    return more


#: In a group of over so many values the compared rows leave out those that pivots have united.
PIVOTED, PIVOTS = 256, 6


def apart(values: np.ndarray, index: np.ndarray, forest: Forest, radius: int, also: Callable | None, first: int) -> np.ndarray:
    """The places in a large group outside its largest tree, after some values have been compared with all others."""
    left = np.arange(len(values))
    for _ in range(PIVOTS):
        pivot = left[0]
        near = np.flatnonzero(np.bitwise_count(values ^ values[pivot]) <= radius)
        if also is not None:
            near = near[also(np.full(len(near), first + pivot), first + near)]
        forest.unite(np.full(len(near), index[pivot]), index[near])
        left = left[forest.label[index[left]] != forest.label[index[pivot]]]
        if not len(left):
            break
    trees, own = np.unique(forest.label[index], return_inverse=True)
    return np.flatnonzero(own != np.bincount(own).argmax())


def link_bucket(values: np.ndarray, group: np.ndarray, forest: Forest, index: np.ndarray, radius: int, also: Callable | None = None) -> None:
    """Unites, within each run of equal `group`, the values within the radius; also(left, right) says which pairs of places count.

    index gives each value's place in the forest.  Pairs that are united already are not looked at again.
    """
    bounds = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    ends = np.append(bounds[1:], len(group))
    slot, order, rows, words = 0, [], [], []
    for a, b in zip(bounds.tolist(), ends.tolist()):  # each group begins a word of its own
        if b - a < 2:
            continue
        n, first = b - a, slot // 64
        chosen = np.arange(n) if n <= PIVOTED else apart(values[a:b], index[a:b], forest, radius, also, a)
        order.append((a, b, slot))
        for w in range(-(-n // 64)):
            # of two rows that are both compared, the later one meets the earlier
            rows.append(slot + (chosen if n > PIVOTED else chosen[w * 64 :]))
            words.append(np.full(len(rows[-1]), first + w))
        slot += -(-n // 64) * 64
    if not order:
        return
    placed = np.zeros(slot, dtype=np.uint64)
    back = np.full(slot, -1, dtype=np.int64)
    for a, b, at in order:
        placed[at : at + b - a] = values[a:b]
        back[at : at + b - a] = np.arange(a, b)
    planes = bit_planes(placed)
    rows, words = np.concatenate(rows), np.concatenate(words)
    for first in range(0, len(rows), 1 << 16):
        r, w, mask = near_lanes(planes, placed, rows[first : first + (1 << 16)], words[first : first + (1 << 16)], radius)
        for part in range(0, len(r), 1 << 12):
            lanes = np.unpackbits(mask[part : part + (1 << 12)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(lanes)
            left, right = back[r[part + i]], back[w[part + i] * 64 + lane]
            keep = np.flatnonzero((right >= 0) & (left != right))
            left, right = left[keep], right[keep]
            new = np.flatnonzero(forest.label[index[left]] != forest.label[index[right]])
            left, right = left[new], right[new]
            if also is not None and len(left):
                good = also(left, right)
                left, right = left[good], right[good]
            forest.unite(index[left], index[right])


def block_tables(count: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(bit ranges of the blocks, block sets): the fewest blocks that keep mean buckets near BUCKET."""
    blocks = radius + 1
    while blocks < 2 * radius + 4 and count / 2 ** (64 * (blocks - radius) / blocks) > BUCKET:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return list(zip(edges, edges[1:])), list(combinations(range(blocks), blocks - radius))


def forest_edges(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): a spanning forest, per task, of the links between distinct fingerprints of column fp."""
    spark = nodes.sparkSession
    ranges, tables = block_tables(nodes.count(), radius)
    keys = []
    for t, chosen in enumerate(tables):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in (ranges[c] for c in chosen))
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("v")))
    rows = nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.v")
    large = rows.groupBy("t", "v").count().where(F.col("count") > PART).select("t", "v", F.ceil(F.col("count") / F.lit(PART)).cast("int").alias("parts"))
    rows = rows.join(large, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("fp", "t", "v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        fp, cell = got["fp"].to_numpy().view(np.uint64), np.stack([got[c].to_numpy().astype(np.int64) for c in ("t", "v", "i", "j")])
        order = np.lexsort(cell[::-1])
        fp, cell = fp[order], cell[:, order]
        group = np.cumsum(np.any(np.diff(cell, axis=1, prepend=cell[:, :1]) != 0, axis=0))
        names, index = np.unique(fp, return_inverse=True)
        forest = Forest(len(names))
        link_bucket(fp, group, forest, index, radius)
        tied = np.flatnonzero(forest.label != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[tied].view(np.int64)), pa.array(names[forest.label[tied]].view(np.int64))], names=["a", "b"])

    return rows.repartition(shuffle_partitions(spark), "t", "v", "i", "j").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates large and small star contractions.  Minima are aggregated before
    they are joined back, so a node with very many neighbours is no single task's.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = pairs.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = least.where("a <> m").select("a", F.col("m").alias("b"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()

    pairs = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        pairs = settle(star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): one row per document."""
    marked = settle(fingerprints(docs, words, id_col, text_col))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(forest_edges(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = settle(rooted.join(named, "root").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")
