"""Suffix-array deduplication of repeated byte strings.

A byte goes if a string of `span` bytes that covers it also starts elsewhere.
Suffixes are taken at content-defined anchors (see anchors.py): every window of
`span` bytes has exactly one, at the same offset in equal windows.  So two equal
windows show as two anchors whose suffixes agree up to the windows' end and whose
prefixes agree up to their start.

1. Texts are dealt by document once; each anchor is passed on with the hash of its
   gram and of its context (all bytes of its windows).
2. Two anchors at most for each context of a batch are dealt by gram and sorted.  Grams
   that occur once go; of each context the first two stand for all, so that copies are no
   one task's, however many there are.  Nothing is judged by these hashes.
3. The contexts' suffixes are range-partitioned by their leading bytes at sampled
   splitters.  A splitter never parts suffixes that agree in the gram, so what lies
   on either side of a boundary differs within it: comparing across boundaries
   needs the gram alone.  Each bucket sorts its suffixes, and its reversed prefixes,
   by multikey quicksort over 8-byte words, and reads the common lengths of
   neighbours; for each offset, the anchors that agree on both sides repeat.  A gram
   with more than CROWD contexts that stand for others is no bucket's: its windows are
   dealt one by one, by a 128-bit hash, and counted; both ways are exact.
4. The repeated windows go back to every anchor with that context, and their runs
   to the documents.

Defined results: a null text is empty; texts shorter than a window keep all; a row
that is repeated repeats all its windows; a null id stays null; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import _MIX, _powers, anchors
from .common import byte_views, shuffle_partitions

SPAN, GRAM = 200, 48
#: Stand-ins of one gram that a bucket sorts, a bound on its memory; a gram with more is dealt by window instead.
CROWD = 100_000
NO_ID = -(1 << 63)


def text_anchors(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, context hash, packed place) per anchor; a place is first start << 16 | lead << 8 | windows - 1."""
    at, first, last, hashes = anchors(data, span, gram)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.int32), none
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        size = last + span - first
        context = (sums[last + span] - sums[first]) * down[first] + size.astype(np.uint64)
        context ^= context >> np.uint64(31)
        context *= _MIX
        context ^= context >> np.uint64(30)
    return hashes.view(np.int64), (context >> np.uint64(32)).astype(np.uint32).view(np.int32), first << 16 | (at - first) << 8 | (last - first)


def word_columns(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, backward: bool) -> np.ndarray:
    """Strings as rows of big-endian 8-byte words, zero-padded; backward reads down from starts - 1."""
    width = -(-int(sizes.max(initial=0)) // 8) * 8
    step = np.arange(width)
    places = (starts[:, None] - 1 - step) if backward else (starts[:, None] + step)
    inside = step < sizes[:, None]
    out = np.where(inside, buffer[np.where(inside, places, 0)], 0).astype(np.uint8)
    return out.view(">u8").astype(np.uint64) if width else np.zeros((len(starts), 0), np.uint64)


def multikey_sort(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows by their words, shorter first, and the bytes each shares with its predecessor.

    Multikey quicksort, all segments at once: each is parted in three by one word of its
    middle row; the parts below and above stay at their word, the equal part moves to the next.
    """
    n, depth = words.shape
    order = np.arange(n)
    keyed_words = np.concatenate([words, sizes[:, None].astype(np.uint64)], axis=1)
    begin = np.zeros(min(n, 1), np.int64)  # of the open segments, with their ends and words
    end, at = begin + n, np.zeros(len(begin), np.int64)
    while len(begin):
        size = end - begin
        before = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        places = np.arange(int(size.sum())) + (begin - before)[owner]
        rows = order[places]
        keys = keyed_words[rows, at[owner]]
        pivot = keys[before + size // 2][owner]
        part = 3 * owner + 1 + (keys > pivot) - (keys < pivot)
        order[places] = rows[np.argsort(part, kind="stable")]
        counts = np.bincount(part, minlength=3 * len(size))
        ends = np.cumsum(counts) + np.repeat(begin - before, 3)
        words_at = np.repeat(at, 3) + (np.arange(len(counts)) % 3 == 1)
        open_ = np.flatnonzero((counts > 1) & (words_at <= depth))
        begin, end, at = (ends - counts)[open_], ends[open_], words_at[open_]
    lcp = np.zeros(n, np.int64)
    for first in range(1, n, 1 << 13):  # neighbours share whole words, then bytes of the first that differs
        last = min(n, first + (1 << 13))
        differ = words[order[first:last]] ^ words[order[first - 1 : last - 1]]
        word = (differ != 0).argmax(axis=1) if depth else np.zeros(last - first, np.int64)
        own = differ[np.arange(last - first), word] if depth else np.zeros(last - first, np.uint64)
        share = 8 * word + sum((own < np.uint64(1 << 64 - 8 * b)).astype(np.int64) for b in range(1, 8))
        lcp[first:last] = np.where(own == 0, 8 * depth, share)
    if n:
        lcp[1:] = np.minimum(lcp[1:], np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, lcp


def repeated_windows(buffer: np.ndarray, starts: np.ndarray, lead: np.ndarray, more: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of contexts whose window also stands in another context at the same offset from its anchor.

    A context begins at starts, has its anchor `lead` bytes on and 1 + more windows.
    """
    n = len(starts)
    if n < 2:
        none = np.zeros(0, np.int64)
        return none, none
    right, left = span + more - lead, lead
    order, share = multikey_sort(word_columns(buffer, starts + lead, right, False), right)
    back, agree = multikey_sort(word_columns(buffer, starts + lead, left, True), left)
    rows, windows = [], []
    rank_right, rank_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int((lead - more).min()), int(lead.max()) + 1):
        inside = np.flatnonzero((lead - more <= offset) & (offset <= lead))
        if len(inside) < 2:
            continue
        rank_right[order] = np.cumsum(share < span - offset)
        rank_left[back] = np.cumsum(agree < offset)
        key = rank_right[inside] * (n + 1) + rank_left[inside]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = np.zeros(len(inside), bool)
        twice[by[1:]] |= same
        twice[by[:-1]] |= same
        hit = inside[twice]
        rows.append(hit)
        windows.append(lead[hit] - offset)
    return (np.concatenate(rows), np.concatenate(windows)) if rows else (np.zeros(0, np.int64),) * 2


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, text, rest): texts dealt by document; rest holds all other columns."""
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # rows of one key and text have the same repeats, so a clash of keys changes nothing
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(key.alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"))
    return rows.repartition(shuffle_partitions(docs.sparkSession), "k1", "k2")


def repeats(dealt: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(k1, k2, runs): flat start, end, start, end, ... of the repeated bytes of keyed texts."""
    if not gram <= span <= 256:
        raise ValueError("spans are gram to 256 bytes")
    parts = shuffle_partitions(dealt.sparkSession)
    places = "gram long, context int, k1 long, k2 long, place long"
    names = [c.split()[0] for c in places.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            found = [text_anchors(data[a:b], span, gram) for a, b in zip(offsets[:-1], offsets[1:])]
            counts = [len(f[0]) for f in found]
            g, c, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
            c = c.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, c, np.repeat(k1, counts), np.repeat(k2, counts), p)], names=names)

    def find_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two anchors at most for each context of a batch: copies are gone before they are dealt."""
        for batch in find(batches):
            g, c = batch.column("gram").to_numpy(), batch.column("context").to_numpy()
            by = np.lexsort((c, g))
            same = (g[by][1:] == g[by][:-1]) & (c[by][1:] == c[by][:-1])
            third = np.zeros(len(g), bool)
            third[2:] = same[1:] & same[:-1]
            yield batch.take(pa.array(by[~third]))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first two of each context, with `turn`, in grams that occur twice; lone grams go."""
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        last = (None, None, 0)  # gram, context and how many of that have passed, before the rows in hand
        while batch is not None:
            after = next(batches, None)
            g, c = batch.column("gram").to_numpy(), batch.column("context").to_numpy()
            gram_before = np.append(g[0] == last[0], g[1:] == g[:-1])
            gram_after = np.append(g[1:] == g[:-1], after is not None and g[-1] == after.column("gram")[0].as_py())
            fresh = ~(gram_before & np.append(c[0] == last[1], c[1:] == c[:-1]))
            starts = np.flatnonzero(np.append(True, fresh[1:]))
            turn = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
            if not fresh[0]:
                turn[: starts[1] if len(starts) > 1 else len(g)] += last[2]
            last = (g[-1], c[-1], int(turn[-1]) + 1)
            yield batch.append_column("turn", pa.array(turn)).filter(pa.array((turn < 2) & (gram_before | gram_after)))
            batch = after

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stand-ins, with whether their gram has more of them than a bucket sorts; a gram's first ones wait till that is known."""
        marked = lambda t, many: t.append_column("many", pa.array(many)).combine_chunks().to_batches()
        held, passed = None, 0  # the last gram's rows, and how many of it have been passed on
        for batch in neighbours(batches):
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else ()), batch])
            g = held["gram"].to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            counts = np.diff(np.append(starts, len(g)))
            if passed and g[0] != passed_gram:
                passed = 0
            whole = int(starts[-1])
            if whole:
                many = np.repeat(counts[:-1] > crowd, counts[:-1])
                many[: counts[0]] |= passed > 0
                yield from marked(held.slice(0, whole), many)
                held, passed = held.slice(whole), 0
            if held.num_rows + passed > crowd:
                yield from marked(held, np.ones(held.num_rows, bool))
                passed, passed_gram, held = passed + held.num_rows, g[-1], None
        if held is not None and held.num_rows:
            yield from marked(held, np.full(held.num_rows, bool(passed and held["gram"][0].as_py() == passed_gram)))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each context that stands for others, from one row per text."""
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            lists = batch.column("held")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            # rows that are repeated hold each stand-in many times over; one is enough
            keys = np.stack([flat.field(c).to_numpy().astype(np.int64) for c in ("gram", "context", "turn")])
            _, one = np.unique(keys, axis=1, return_index=True)
            flat, owner = flat.take(pa.array(one)), owner[one]
            place = flat.field("place").to_numpy()
            first, lead, more = place >> 16, place >> 8 & 255, place & 255
            begin = offsets[:-1][owner] + first
            bytes_ = [data[o : o + m + span].tobytes() for o, m in zip(begin.tolist(), more.tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("gram"), flat.field("context"), pa.array(lead), pa.array(more), pa.array(bytes_, pa.binary())], names=["gram", "context", "lead", "more", "bytes"])

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        offsets, data = byte_views(got["bytes"])
        lead, more = got["lead"].to_numpy(), got["more"].to_numpy()
        row, window = repeated_windows(data, offsets[:-1], lead, more, span)
        grams, wholes = got["gram"].to_numpy(), got["context"].to_numpy()
        first = np.unique(np.stack([grams, wholes.astype(np.int64)]), axis=1, return_index=True)[1]
        one = np.zeros(len(grams), bool)  # a context's other stand-ins have the same windows
        one[first] = True
        row, window = row[one[row]], window[one[row]]
        by = np.lexsort((window, row))
        row, window = row[by], window[by]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(row)) - 1
        runs = np.stack([window[begin], window[end]], axis=1).ravel() if len(row) else np.zeros(0, np.int64)
        owner = row[begin] if len(row) else np.zeros(0, np.int64)
        who, n = np.unique(owner, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * n)).astype(np.int32)), pa.array(runs.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(grams[who]), pa.array(wholes[who]), lists], names=["s_gram", "s_context", "windows"])

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of a context by a 128-bit hash, for grams with too many contexts for a bucket."""
        for batch in batches:
            keys, owner, at = [], [], []
            for i, (data, m) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("more").to_pylist())):
                keys += [hashlib.blake2b(data[w : w + span], digest_size=16).digest() for w in range(m + 1)]
                owner += [i] * (m + 1)
                at += range(m + 1)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("gram").take(take), batch.column("context").take(take), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], names=["gram", "context", "window", "key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Byte runs of each anchor's repeated windows."""
        for batch in batches:
            first = batch.column("place").to_numpy() >> 16
            more = batch.column("place").to_numpy() & 255
            runs = [
                [a, a + m + span] if own == [0, m] else [x for b, e in zip(own[::2], own[1::2]) for x in (a + b, a + e + span)]
                for a, m, own in zip(first.tolist(), more.tolist(), batch.column("windows").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(runs, pa.list_(pa.int32()))], names=["k1", "k2", "runs"])

    texts = dealt.select("k1", "k2", "text", "rest")  # the same columns wherever it is used, so it is dealt once
    dealt_grams = texts.mapInArrow(find_few, places).repartition(parts, "gram").sortWithinPartitions("gram", "context", "k1", "k2", "place")
    stand = dealt_grams.mapInArrow(crowded, places + ", turn long, many boolean").withColumnsRenamed({"k1": "s1", "k2": "s2"})


    def suffixes(chosen: DataFrame) -> DataFrame:
        # one row per text, so that a long text with many anchors is handed over once
        chosen = chosen.groupBy("s1", "s2").agg(F.collect_list(F.struct("gram", "context", "place", "turn")).alias("held"))
        held = texts.join(chosen, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).select("held", "text", "rest")
        return held.mapInArrow(contexts, "gram long, context int, lead long, more long, bytes binary")

    few, many = suffixes(stand.where("not many")), suffixes(stand.where("many"))
    leading = F.substring(F.col("bytes"), F.col("lead").cast("int") + 1, F.lit(gram))
    judged = few.repartitionByRange(parts, leading).mapInArrow(bucket, "s_gram long, s_context int, windows array<int>")
    loose = many.mapInArrow(windows_of, "gram long, context int, window int, key binary")
    twice = loose.groupBy("key").count().where("count > 1").select("key")
    run = F.flatten(F.transform(F.array_sort(F.collect_set("window")), lambda w: F.array(w, w)))
    dealt_windows = loose.join(twice, "key", "left_semi").groupBy("gram", "context").agg(run.alias("windows"))
    verdicts = judged.union(dealt_windows)
    members = texts.mapInArrow(find, places)
    back = members.join(verdicts, (F.col("gram") == F.col("s_gram")) & (F.col("context") == F.col("s_context")))
    back = back.select("k1", "k2", "place", "windows").mapInArrow(spread, "k1 long, k2 long, runs array<int>")
    return back.groupBy("k1", "k2").agg(F.flatten(F.collect_set("runs")).alias("runs"))  # repeated rows tell the same runs again


def merge(runs: list[int] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint, non-touching (start, end) of flat runs."""
    out: list[list[int]] = []
    for a, b in sorted(zip(runs[::2], runs[1::2])) if runs else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def marked(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(text, rest, runs) of every document; rest holds its other columns."""
    dealt = keyed(docs, id_col, text_col)
    runs = repeats(dealt, span, gram, crowd).withColumnsRenamed({"k1": "r1", "k2": "r2"})
    return dealt.join(runs, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left").select("text", "rest", "runs")


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(docs: DataFrame, span: int = SPAN, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = byte_views(batch.column("text"))
            removed, spans, hashes = [], [], []
            for a, b, flat in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("runs").to_pylist()):
                raw, at, digest = memoryview(data)[a:b], 0, hashlib.sha256()
                cut = merge(flat)
                for begin, end in cut:
                    digest.update(raw[at:begin])
                    at = end
                digest.update(raw[at:])
                removed.append(sum(e - s for s, e in cut))
                spans.append(len(cut))
                hashes.append(digest.hexdigest())
            columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DIGEST.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return marked(slim, span, gram, crowd=crowd).select(F.col("rest.doc_id").alias("doc_id"), "text", "runs").mapInArrow(run, DIGEST)


def cut(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The documents without their repeated bytes; a character goes only if all its bytes do.  n_chars follows the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, flat in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                if flat:
                    raw, at, keep = text.encode(), 0, []
                    inner = lambda i, raw=raw: i < len(raw) and raw[i] & 0xC0 == 0x80
                    for begin, end in merge(flat):
                        while inner(begin):
                            begin += 1
                        while end > begin and inner(end):
                            end -= 1
                        keep.append(raw[at:begin])
                        at = max(end, begin)
                    text = b"".join([*keep, raw[at:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], schema=pa.schema([pa.field("text", pa.string()), batch.schema.field("rest")]))

    found = marked(docs, span, gram)
    done = found.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), found.schema["rest"]]))
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("rest")[c].alias(c) for c in docs.columns]
    return done.select(*columns)
