"""Token ids against the tokenizer itself, and the bins' class counts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from serixa.llm import packing, queries

ODD = ["İ", "ß", "é", "é", "É", "ÿ", "×", "÷", "ª", "µ", "Ÿ", "Ǆ", "ſ", "Σ", "ς", "я", "文", "١", "Ⅷ", "²", "̀", " ", "\x85", " ", "\t", "\r", "\x0b", "\x1c", "\0", "😀", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'LL", "'", "’", "_", "-", "...", "<", ">", "&", "0", "42", "A", "the", "Thing", "x", " ", "  ", "\n", "﻿", "�"]


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(queries.tokenizer_path())


def same(words, texts, end=1):
    want = [words.tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]
    assert [x.tolist() for x in words.encode(pa.array(texts, pa.string()), end)] == want


def test_ids_of_odd_texts(words):
    r = random.Random(4)
    assert words.wordwise
    same(words, [None, "", " ", "\n", *ODD, *("".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(800))])
    same(words, [])
    same(words, [None])


def test_ids_when_pieces_are_forgotten(words, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_KEPT", 20)
    r = random.Random(5)
    for _ in range(20):
        same(words, ["".join(r.choice(ODD) for _ in range(40)) for _ in range(10)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    same(packing.WordIds.of(queries.tokenizer_path()), texts)


def test_ids_of_all_latin_characters(words):
    same(words, [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c).upper()}.," for c in range(1, 0x500)])


def bins(sizes, capacity):
    found, own = [], packing.Harmonic(capacity, 0)
    for doc, n in enumerate(sizes):
        found += own.add(doc, np.full(n, doc, np.uint32))
        assert len(own.waiting) <= capacity and sum(len(b) for b in own.open.values()) <= capacity * 8
    return found, found + list(own.finish())


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_their_class_count(seed):
    """Plain version: a full bin of class k holds k whole tails of that class; what is cut only fills the rest."""
    r, capacity = random.Random(seed), 64
    mixed = seed % 2 == 0
    sizes = [r.choice([r.randint(1, 64), r.randint(30, 40), r.randint(1, 6), r.randint(60, 300)] if mixed else [r.randint(2, 31), r.randint(9, 16)]) for _ in range(600)]
    closed, found = bins(sizes, capacity)
    by_sequence = {}
    for doc, start, ids, sequence, offset in found:
        by_sequence.setdefault(sequence, []).append((doc, start, len(ids), offset))
    held = {s for *_, s, _ in closed}
    by_class = Counter()
    for sequence, own in by_sequence.items():
        assert sum(n for *_, n, _ in own) == capacity or sequence not in held
        total = sum(n for *_, n, _ in own)
        assert total == capacity or total & (total - 1) == 0
        if sequence in held and own[0][2] < capacity:
            kind = capacity // own[0][2]
            assert [capacity // n for _, _, n, _ in own[:kind]] == [kind] * kind
            by_class[kind] += 1
    assert by_class[1] and by_class[2] if mixed else len(by_class) > 4
    for doc, n in enumerate(sizes):
        at = 0
        for _, start, length, *_ in sorted((x[0], x[1], len(x[2])) for x in found if x[0] == doc):
            assert start == at
            at += length
        assert at == n
