"""Harmonic packing of token sequences.

A document's tail (what is left after its full sequences) of length r falls into
the reciprocal class k = capacity // r, and a bin of class k takes exactly k
tails.  Every partition fills its own bins, so no row moves.  What a full bin
lacks is cut from the head of the partition's longest waiting tail; what waits
at the end of a partition is concatenated, and the last short run is cut into
powers of two.  So no sequence needs padding.

Defined results: a null or empty text is the separator alone; repeated rows are
packed once each; an empty table gives no rows; a null id stays null.  Extra
columns are not read.
"""

from __future__ import annotations

import itertools
import json
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces of words, and bytes of them, above which a worker forgets those that it knows.
PIECES_KEPT, PIECE_BYTES = 400_000, 16 << 20
#: ASCII marks that no contraction begins with.
MARKS = string.punctuation.replace("'", "")
#: Most words: letters that NFC leaves alone, then marks that make up one piece; < may begin a special token.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*[" + re.escape(MARKS.replace("<", "")) + "]*$"
#: What a tokenizer file says if its words can be taken one by one.
WORDWISE = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "\\s+", "</w>")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat from begin on, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(begin - before, size) + np.arange(int(size.sum()))]


def tails(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What each word has beyond its stem, its beginning."""
    (at, data), (stem, _) = byte_views(words), byte_views(stems)
    size = np.diff(at) - np.diff(stem)
    body = gathered(data, at[1:] - size, size)
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(body)])


class WordIds:
    """Token ids of texts; each worker remembers those of pieces of words.

    A wordwise tokenizer never joins text across a blank or a line feed, so a
    text's ids are those of its words in turn.  A slice's distinct words are lower-cased
    and parted into pieces as the tokenizer's own pattern does, those of Latin
    letters and marks all at once in Arrow.  Pieces that aren't remembered go to the
    merges together.  What NFC or lower-casing might treat in another way goes to the
    tokenizer whole.
    """

    shared: dict[str, WordIds] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        """The worker's own instance, which lasts from task to task."""
        if path not in cls.shared:
            cls.shared[path] = cls(path)
        return cls.shared[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = lambda part, name: (told.get(part) or {}).get(name) or []
        rules, splits = steps("normalizer", "normalizers"), steps("pre_tokenizer", "pretokenizers")
        kinds = [r["type"] for r in rules], [r["type"] for r in splits]
        suffix = told["model"].get("end_of_word_suffix")
        self.wordwise = (*kinds, rules[1]["pattern"].get("Regex") if len(rules) > 1 else None, suffix) == WORDWISE
        self.special = [t["content"] for t in told.get("added_tokens", ())]
        self.letters = byte_letters()
        if self.wordwise:
            self.split = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = told["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece, and no others do
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.wordwise = all(c in vocabulary and c + suffix in vocabulary for c in self.letters.values())
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def parts(self, word: str) -> list[str] | None:
        """The pieces of a word, or None where only the tokenizer itself can tell."""
        if not (word.isascii() or max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)) or "<" in word and any(s in word for s in self.special):
            return None
        return self.split(word.lower())

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(where each piece's ids end, ids): pieces go through the merges together, told apart by the ids that end one."""
        found = []
        for first in range(0, len(pieces), 4096):
            spelled = " ".join([p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in pieces[first : first + 4096]])
            found.append(np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(pieces):
            raise ValueError("the tokenizer's pieces don't end as its vocabulary says")
        return last, ids

    def numbers(self, pieces: pa.Array) -> np.ndarray:
        """The number of each piece among the known ones; new ones are learned."""
        if len(self.known) > PIECES_KEPT or self.known.nbytes > PIECE_BYTES:
            self.forget()
        coded = pieces.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(pc.is_null(at))
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        last, ids = self.merged(new.to_pylist())
        self.bounds = np.append(self.bounds, len(self.ids) + last)
        self.ids = np.append(self.ids, ids)
        self.known = pa.concat_arrays([self.known, new])
        return at[coded.indices.to_numpy()]

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(begin of each word's ids and their end, flat ids) of distinct words."""
        plain = pc.match_substring_regex(words, PLAIN)
        plain_at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        low = pc.utf8_lower(words.filter(plain))
        stems = pc.ascii_rtrim(low, characters=MARKS)
        marks = tails(low, stems)
        held = [np.flatnonzero(pc.not_equal(x, "").to_numpy(zero_copy_only=False)) for x in (stems, marks)]
        owners, turns, pieces = [plain_at[h] for h in held], [np.full(len(h), t) for t, h in enumerate(held)], [x.take(pa.array(h)) for x, h in zip((stems, marks), held)]
        others = np.flatnonzero(pc.invert(plain).to_numpy(zero_copy_only=False))
        split, whole = [], {}
        for at, word in zip(others.tolist(), words.take(pa.array(others)).to_pylist()):
            own = self.parts(word)
            if own is None:
                whole[at] = self.whole(word)
            split.append(own or [])
        counts = np.array([len(own) for own in split], np.int64)
        owners.append(np.repeat(others, counts))
        turns.append(np.arange(int(counts.sum())))
        pieces.append(pa.array([p for own in split for p in own], pa.string()))
        owner, turn, number = np.concatenate(owners), np.concatenate(turns), self.numbers(pa.concat_arrays(pieces))
        begin, size, ids = self.bounds[number], self.bounds[number + 1] - self.bounds[number], self.ids
        if whole:
            more = list(whole.values())
            sizes = np.array([len(x) for x in more])
            owner, turn = np.append(owner, list(whole)), np.append(turn, np.zeros(len(more), np.int64))
            begin, size, ids = np.append(begin, len(ids) + np.cumsum(sizes) - sizes), np.append(size, sizes), np.concatenate([ids, *more])
        order = np.lexsort((turn, owner))
        per_word = np.bincount(owner, size, len(words)).astype(np.int64)
        return np.append(0, np.cumsum(per_word)), gathered(ids, begin[order], size[order])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """Each text's ids and then `end`."""
        texts = texts.fill_null("")
        if not self.wordwise:
            return [np.append(self.whole(text), np.uint32(end)).astype("<u4") for text in texts.to_pylist()]
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        word_bounds, ids = self.word_ids(coded.dictionary)
        # the separator stands as one more word after each text
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), bounds[1:] - bounds[0], len(coded.dictionary))
        begin, size = np.append(word_bounds[:-1], len(ids)), np.append(np.diff(word_bounds), 1)
        flat = gathered(np.append(ids, np.uint32(end)), begin[codes], size[codes]).astype("<u4")
        ends = np.append(0, np.cumsum(size[codes]))[bounds - bounds[0] + np.arange(len(bounds))]
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


class Harmonic:
    """The open bins of one worker.  A piece is (document, start, ids)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list] = {}
        self.waiting: list = []  # tails that may be cut to fill bins, longest first
        self.tie = itertools.count()

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self.close([(doc, start, ids[start : start + self.capacity])])
        if whole < len(ids):
            yield from self.place((doc, whole, ids[whole:]))

    def place(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        kind = self.capacity // size
        mates = self.open.setdefault(kind, [])
        mates.append(piece)
        if len(mates) == kind:
            del self.open[kind]
            yield from self.fill(mates)

    def spare(self) -> tuple | None:
        """The longest tail that waits, in no bin or in the open bin of the longest class."""
        if self.waiting:
            return heappop(self.waiting)[2]
        if not self.open:
            return None
        kind = min(self.open)
        piece = self.open[kind].pop()
        if not self.open[kind]:
            del self.open[kind]
        return piece

    def fill(self, pieces: list) -> Iterator[tuple]:
        """Completes a bin of its class with the heads of waiting tails."""
        lack = self.capacity - sum(len(p[2]) for p in pieces)
        rest = None
        while lack and (piece := self.spare()):
            doc, start, ids = piece
            pieces.append((doc, start, ids[:lack]))
            if len(ids) > lack:
                rest = (doc, start + lack, ids[lack:])
            lack -= min(lack, len(ids))
        if lack:  # nothing else waits
            self.waiting += [(-len(p[2]), next(self.tie), p) for p in pieces]
            heapify(self.waiting)
            return
        yield from self.close(pieces)
        if rest:
            yield from self.place(rest)

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        rest = [w[2] for w in sorted(self.waiting)] + [p for _, bin_ in sorted(self.open.items()) for p in bin_]
        self.waiting, self.open = [], {}
        left = sum(len(p[2]) for p in rest)
        room, pieces = 0, []
        for doc, start, ids in rest:
            while len(ids):
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                cut = min(room, len(ids))
                pieces.append((doc, start, ids[:cut]))
                start, ids, room, left = start + cut, ids[cut:], room - cut, left - cut
                if not room:
                    yield from self.close(pieces)
                    pieces = []


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", encoder: Callable = WordIds.of) -> DataFrame:
    """One row per piece of a document; pieces of a sequence lie gapless from offset 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        bins = Harmonic(capacity, TaskContext.get().partitionId() << 40)

        def rows(found) -> pa.RecordBatch:
            found = list(found)
            columns = (
                [doc[0] for doc, *_ in found],
                [start for _, start, *_ in found],
                [len(ids) for _, _, ids, *_ in found],
                [zlib.crc32(ids.tobytes()) for _, _, ids, *_ in found],
                [doc[1] for doc, *_ in found],
                [sequence for *_, sequence, _ in found],
                [offset for *_, offset in found],
            )
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[p.split()[0] for p in PIECES.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                ids = encode(part.column("text"), end)
                found = []
                for doc, own in zip(part.column("doc_id").to_pylist(), ids):
                    found += bins.add((doc, len(own)), own)
                yield rows(found)
        yield rows(bins.finish())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
