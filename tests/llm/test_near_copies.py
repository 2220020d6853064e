"""The pipeline's near-copy stage against all pairs compared."""

import random

import numpy as np
import pytest

from serixa.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def survivors(rows, similarity=0.8):
    """rows: (id, text) of distinct ids; the smallest id of each group."""
    sets = [(i, shingles(t)) for i, t in sorted(rows)]
    label = {i: i for i, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a == b or a and b and len(a & b) / len(a | b) >= similarity:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return sorted(set(label.values()))


def changed(r, words, at_most):
    out = list(words)
    for at in r.sample(range(len(out)), r.randint(0, at_most)):
        out[at] = f"new{r.randint(0, 10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    """Groups on both sides of the similarity, chains, short and blank texts."""
    r = random.Random(11)
    rows = []
    for _ in range(40):
        words = [f"w{r.randint(0, 2000)}" for _ in range(r.randint(3, 200))]
        for _ in range(r.randint(1, 6)):
            words = changed(r, words, max(1, len(words) // 30))
            rows.append(" ".join(words))
    rows += ["", None, "  ", "One two", "one  TWO", "one two three"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_stage_keeps_one_at_similarity(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).repartition(5)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == survivors(texts)


def test_stage_on_given_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").limit(600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs.collect(), docs.schema), "")
    assert sorted(r.doc_id for r in found.collect()) == survivors(rows)


def test_bands_meet_at_similarity():
    """Sets at exactly 0.8 share a band's key nearly always."""
    r = np.random.default_rng(3)
    met = 0
    for _ in range(1000):
        x = r.integers(0, 1 << 64, 110, dtype=np.uint64)
        met += bool((near_copies.band_keys(x[:100]) == near_copies.band_keys(np.concatenate([x[:88], x[100:]]))).any())
        assert len(np.intersect1d(x[:100], np.concatenate([x[:88], x[100:]]))) == 88
    assert met >= 998


def test_stage_judges_null_and_repeated_ids(spark):
    say = lambda seed: " ".join(f"v{random.Random(seed).randint(0, 9)}{seed}x{i}" for i in range(40))
    rows = [(1, say(1)), (1, say(2)), (None, say(3)), (None, say(3)), (None, say(1)), (5, say(2)), (6, say(4)), (6, say(4)), (None, say(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    found = sorted(((r.doc_id, r.text) for r in near_copies.keep_one(docs).collect()), key=str)
    assert found == sorted([(1, say(1)), (1, say(2)), (None, say(3)), (6, say(4)), (None, say(5))], key=str)
