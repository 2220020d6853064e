"""SimHash near-dedup at a Jaccard similarity: the form of the operator that the corpus pipeline takes.

Documents link at a similarity of 0.8 or more of their sets of five-word shingles.
At 0.8 about 10 of 64 fingerprint bits differ, too many for tables of bit blocks, so
fingerprints meet in buckets of a band of minimum hashes instead (24 bands of 5: a
pair at 0.8 is missed with probability (1 - 0.8^5)^24, below 0.0001).

1. In a bucket the fingerprints are compared bit-sliced, with a radius that a pair at
   0.8 exceeds about once in 5000 times, and then one bit of each minimum hash.  A
   task passes on a spanning forest of what is left, never the pairs; the trees are
   the loose groups, and all that links is in one of them.
2. In a loose group all whole sets are compared with its pivot.  If some are no
   copies of it, those are compared with all sets of the group: an inverted index of
   the shingles counts what is common, and again only a forest is passed on.  Groups
   too large for a task are dealt as a grid of parts of bounded size.

So no pair below the similarity is linked, and no pairs are listed.

Defined results: a text of fewer words than a shingle is one shingle; null and
blank texts have none, and are copies of each other; of each group the row with
the smallest id stays, a null id counting as the largest; rows are told apart by
id and text, so repeated and null ids are judged as all others; an empty table gives
no rows; extra columns are handed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, settle, shuffle_partitions, whole_runs
from .simhash import SEED, PART, Forest, components, fingerprint, link_bucket, text_hashes

BANDS, DEPTH = 24, 5
HASHES = BANDS * DEPTH
_RANDOM = np.random.default_rng(SEED)
_MASK, _FACTOR, _FOLD = (_RANDOM.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(odd) for odd in (0, 1, 1))
#: Shingles of one part of a loose group that a task holds; larger groups are dealt as a grid of parts.
CELL = 1 << 17
#: How many standard deviations beyond its mean at the similarity a distance may lie.
SIGMAS = 3.7


def bits_apart(size: int, share: float) -> int:
    """The largest distance of `size` bits, each different with probability `share`, that still counts."""
    return int(size * share + SIGMAS * np.sqrt(size * share * (1 - share)))


def radii(similarity: float) -> tuple[int, int]:
    """For fingerprints and for minimum-hash bits: how far apart sets of the similarity may be.

    Votes of very few shingles tie: those of four and of the same four and one more differ in 3 of 16 bits.
    """
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return bits_apart(64, max(angle, 3 / 16)), bits_apart(HASHES, (1 - similarity) / 2)


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """The mixed minimum of each hash function over a set."""
    least = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(shingles), 1 << 9):
            mixed = (shingles[first : first + (1 << 9), None] ^ _MASK) * _FACTOR
            np.minimum(least, mixed.min(axis=0), out=least)
        return least * _FOLD


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of minimum hashes of a set."""
    with np.errstate(over="ignore"):
        return minimum_hashes(shingles).reshape(BANDS, DEPTH).sum(axis=1, dtype=np.uint64)


SKETCH = "no_id boolean, id long, hash long, node long, n long, fp long, low long, high long, bands array<long>"


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """rows (no_id, id, hash, text) with node, a hash of the set of shingles, its size n, fingerprint, minimum-hash bits and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            size = batch.num_rows
            nodes, fps, sizes, least = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros((size, HASHES), np.uint64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.unique(text_hashes(data[a:b].tobytes(), words))
                nodes[i], sizes[i], fps[i], least[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own), fingerprint(own), minimum_hashes(own)
            tops = np.zeros((size, 128), np.uint8)
            tops[:, :HASHES] = (least >> np.uint64(63)).astype(np.uint8)
            bits = np.packbits(tops, axis=1, bitorder="little").view("<i8").reshape(size, 2)
            flat = least.reshape(size, BANDS, DEPTH).sum(axis=2, dtype=np.uint64).view(np.int64).ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * BANDS), pa.array(flat))
            values = [nodes.view(np.int64), sizes, fps.view(np.int64), np.ascontiguousarray(bits[:, 0]), np.ascontiguousarray(bits[:, 1])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("no_id", "id", "hash")), *map(pa.array, values), bands], names=[f.split()[0] for f in SKETCH.split(", ")])

    return rows.mapInArrow(run, SKETCH)


def shared_bands(nodes: DataFrame) -> DataFrame:
    """(band, node): the nodes that share a band's key with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row before those in hand, and whether it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            band, node = (batch.column(c).to_numpy() for c in ("band", "node"))
            if before is not None:
                band, node = np.append(before[0], band), np.append(before[1], node)
            same = band[1:] == band[:-1]
            shared = np.append(False, same) | np.append(same, False)
            if before is not None:
                shared[0] &= not before[2]
            before = (band[-1], node[-1], bool(len(same) and same[-1]) or (len(band) == 1 and before is not None and before[2]))
            hit = np.flatnonzero(shared)
            yield pa.RecordBatch.from_arrays([pa.array(band[hit]), pa.array(node[hit])], names=["band", "node"])

    dealt = nodes.select("node", F.explode("bands").alias("band")).repartition(shuffle_partitions(nodes.sparkSession), "band")
    return dealt.select("band", "node").sortWithinPartitions("band").mapInArrow(run, "band long, node long")


def loose_links(nodes: DataFrame, similarity: float, most: int = PART) -> DataFrame:
    """(a, b): per task, a spanning forest of the nodes that may have the similarity; `most` of a bucket meet in a task."""
    spark = nodes.sparkSession
    near, alike = radii(similarity)
    shared = settle(shared_bands(nodes))
    large = shared.groupBy("band").count().where(F.col("count") > most).select(F.col("band").alias("l_band"), F.ceil(F.col("count") / F.lit(most)).cast("int").alias("parts"))
    dealt = shared.join(large, F.col("band") == F.col("l_band"), "left").select("band", F.col("node").alias("s_node"), F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("s_node"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["band", "i", "j"]
    dealt = dealt.select("band", "s_node", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
    rows = dealt.join(nodes.select("node", "n", "fp", "low", "high"), F.col("s_node") == F.col("node")).drop("s_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_runs(batches, cell):
            keys = np.stack([got[c].to_numpy().astype(np.int64) for c in cell])
            node, n = got["node"].to_numpy(), got["n"].to_numpy()
            fp, low, high = (got[c].to_numpy().view(np.uint64) for c in ("fp", "low", "high"))
            group = np.cumsum(np.any(np.diff(keys, axis=1, prepend=keys[:, :1]) != 0, axis=0))
            names, index = np.unique(node, return_inverse=True)
            forest = Forest(len(names))

            def also(a, b, n=n, low=low, high=high):
                differ = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
                return (differ <= alike) & (np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b]))

            link_bucket(fp, group, forest, index, near, also)
            tied = np.flatnonzero(forest.label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[tied]), pa.array(names[forest.label[tied]])], names=["a", "b"])

    dealt = rows.repartition(shuffle_partitions(spark), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """texts (loose, node, text) as (loose, node, shingles); the shingles are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            sets = [np.unique(text_hashes(data[a:b].tobytes(), words)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            bounds = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("loose"), batch.column("node"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["loose", "node", "shingles"])

    return texts.mapInArrow(run, "loose long, node long, shingles array<long>")


def link_sets(flat: np.ndarray, sizes: np.ndarray, asks: np.ndarray, forest: Forest, similarity: float) -> None:
    """Unites each of the sets at `asks` with those of the similarity; an inverted index counts common shingles."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    keys, owner = flat[order], owner[order]
    begins = np.cumsum(sizes) - sizes
    for a in asks.tolist():
        own = flat[begins[a] : begins[a] + sizes[a]]
        first, last = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        counts = last - first
        places = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        common = np.bincount(owner[places], minlength=len(sizes))
        hit = np.flatnonzero(common >= similarity * (sizes[a] + sizes - common))
        forest.unite(np.full(len(hit), a), hit)


def exact_links(sets: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """(a, b): links that have the same components as all links within the loose groups of sets (loose, node, shingles)."""
    spark = sets.sparkSession
    # every set against its group's pivot, the node that names the group
    pivots = sets.where("node = loose").select(F.col("loose").alias("p_loose"), F.col("shingles").alias("pivot"))
    common = F.size(F.array_intersect("shingles", "pivot"))
    union = F.size("shingles") + F.size("pivot") - F.col("common")
    compared = sets.join(pivots, F.col("loose") == F.col("p_loose")).withColumn("common", common)
    compared = settle(compared.select("loose", "node", F.size("shingles").alias("n"), (F.col("common") >= F.lit(similarity) * union).alias("copy")))
    stars = compared.where("copy and node <> loose").select(F.col("loose").alias("a"), F.col("node").alias("b"))
    # groups with others than copies of the pivot: these against all
    parts = lambda total: F.greatest(F.lit(1), F.ceil(total / F.lit(cell))).cast("int")
    mixed = compared.groupBy("loose").agg(F.sum("n").alias("total"), F.sum(F.when(~F.col("copy"), F.col("n"))).alias("others")).where("others is not null")
    mixed = settle(mixed.select(F.col("loose").alias("m_loose"), parts(F.col("others")).alias("down"), parts(F.col("total")).alias("across")))
    chosen = compared.select(F.col("node").alias("c_node"), F.col("loose").alias("c_loose"), "copy").join(mixed, F.col("c_loose") == F.col("m_loose")).drop("m_loose", "c_loose")
    rows = sets.join(chosen, F.col("node") == F.col("c_node")).drop("c_node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["loose", "i", "j"]
    asking = rows.where(~F.col("copy")).withColumn("i", deal("down")).withColumn("j", all_of("across")).select(*key, F.lit(True).alias("asks"), "node", "shingles")
    asked = rows.withColumn("j", deal("across")).withColumn("i", all_of("down")).select(*key, F.lit(False).alias("asks"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_runs(batches, key, 1):
            got = got.combine_chunks()
            keys = np.stack([got[c].to_numpy().astype(np.int64) for c in key])
            starts = np.flatnonzero(np.append(True, np.any(np.diff(keys, axis=1) != 0, axis=0)))
            left, right = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), got.num_rows]):
                part = got.slice(a, b - a)
                node, asks = part["node"].to_numpy(), part["asks"].to_numpy(zero_copy_only=False)
                lists = pa.concat_arrays(part["shingles"].chunks)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                names, index = np.unique(node, return_inverse=True)
                forest = Forest(len(node))
                first = np.full(len(names), -1)
                first[index[::-1]] = np.arange(len(node))[::-1]
                forest.unite(first[index], np.arange(len(node)))  # a node that asks is also one of those asked
                link_sets(lists.flatten().to_numpy(), sizes, np.flatnonzero(asks), forest, similarity)
                tied = np.flatnonzero(node[forest.label] != node)
                left.append(node[tied])
                right.append(node[forest.label[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    dealt = asking.union(asked).repartition(shuffle_partitions(spark), *key).sortWithinPartitions(*key)
    return stars.union(dealt.mapInArrow(run, "a long, b long"))


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """One row of each group of near copies, that with the smallest id."""
    text = F.col("text").cast("string")
    number = F.col("doc_id").cast("long")
    # rows are told apart by id and text; equal rows are copies and may stand for each other
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), number.isNull().alias("no_id"), F.coalesce(number, F.xxhash64(text)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marked = settle(sketches(rows.select("no_id", "id", "hash", "text"), words))
    nodes = marked.where("n > 0").dropDuplicates(["node"])
    loose = components(loose_links(nodes, similarity))
    loose = loose.union(loose.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("l_node"), F.col("root").alias("loose"))
    # one text of each node in a loose group
    wanted = marked.join(loose, F.col("node") == F.col("l_node")).groupBy("node", "loose").agg(F.min(F.struct("id", "hash")).alias("w"))
    wanted = wanted.select("node", "loose", F.col("w.id").alias("w_id"), F.col("w.hash").alias("w_hash"))
    texts = rows.select("id", "hash", "text").join(wanted, (F.col("id") == F.col("w_id")) & (F.col("hash") == F.col("w_hash"))).select("loose", "node", "text").dropDuplicates(["node"])
    sets = settle(shingle_sets(texts, words))
    roots = components(exact_links(sets, similarity)).withColumnRenamed("node", "r_node")
    best = marked.groupBy("node").agg(F.min(F.struct("no_id", "id", "hash")).alias("best"))
    best = best.join(roots, F.col("node") == F.col("r_node"), "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    kept = settle(best.select(F.col("best.id").alias("k_id"), F.col("best.hash").alias("k_hash")))
    chosen = rows.drop("text").join(kept, (F.col("id") == F.col("k_id")) & (F.col("hash") == F.col("k_hash")), "left_semi")
    return chosen.dropDuplicates(["id", "hash"]).select("row.*")
