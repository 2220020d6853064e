"""Boxes of other writers, broken numbers, and features and keyframes against plain versions."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from serixa.llm import iso_media
from serixa.llm.iso_media import box, describe, full_box, read_payload, write

U = lambda *x: struct.pack(f">{len(x)}I", *x)


def movie(stbl, more=b"", track=1, mdhd=None):
    mdhd = full_box(b"mdhd", U(0, 0, 1000, 0), bytes(4)) if mdhd is None else mdhd
    tkhd = full_box(b"tkhd", U(0, 0, track, 0, 0), bytes(60))
    return box(b"moov", box(b"trak", tkhd, box(b"mdia", mdhd, full_box(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", box(b"stbl", stbl)))), more)


def tables(sizes, chunk, sync=None, compact=0, extra=b""):
    if compact == 4:
        raw = bytes((a << 4) | b for a, b in zip(sizes[::2], [*sizes[1::2], 0]))
    else:
        raw = b"".join(s.to_bytes(compact // 8, "big") for s in sizes) if compact else U(*sizes)
    size = full_box(b"stz2", bytes(3), bytes([compact]), U(len(sizes)), raw) if compact else full_box(b"stsz", U(0, len(sizes)), raw)
    out = full_box(b"stsd", U(1), box(b"abcd", bytes(16))) + full_box(b"stts", U(1, len(sizes), 40)) + full_box(b"stsc", U(1, 1, len(sizes), 1)) + size + full_box(b"stco", U(1, chunk)) + extra
    return out + (full_box(b"stss", U(len(sync), *sync)) if sync else b"")


@pytest.mark.parametrize("compact", [0, 4, 8, 16])
def test_sample_sizes(compact):
    payload = bytes(range(40))
    sizes = [3, 9, 15, 1, 12]
    data = box(b"mdat", payload) + movie(tables(sizes, 8, [1, 3], compact))
    (track,) = describe(data)
    assert [data[a : a + n] for a, n in track["keyframes"].tolist()] == [payload[:3], payload[12:27]]
    assert read_payload(data, track) == payload and track["duration"] == 200 and not track["shifted"]
    shifted = movie(tables(sizes, 8, [1], 0, full_box(b"ctts", U(2, 2, 0, 3, 80))))
    assert describe(box(b"mdat", payload) + shifted)[0]["shifted"]


def test_fragments():
    moov = movie(tables([], 8).replace(full_box(b"stsc", U(1, 1, 0, 1)), full_box(b"stsc", U(0))).replace(full_box(b"stco", U(1, 8)), full_box(b"stco", U(0))), box(b"mvex", full_box(b"trex", U(7, 1, 20, 4, 0x10000))), 7)
    data, want, body = moov, [], []
    r = random.Random(2)
    for _ in range(3):
        sizes = [r.randint(1, 9) for _ in range(4)]
        runs = lambda at: full_box(b"trun", U(4, at, 0), U(*sizes), flags=0x205) + full_box(b"trun", U(2))
        moof = lambda at: box(b"moof", full_box(b"mfhd", U(1)), box(b"traf", full_box(b"tfhd", U(7), flags=0x20000), runs(at)))
        size = len(moof(0))
        payload = bytes(r.randrange(256) for _ in range(sum(sizes) + 8))
        want.append(payload[: sizes[0]])  # only the first sample of the first run is marked as one of its own
        data += moof(size + 8) + box(b"mdat", payload)
        body.append(payload)
    (track,) = describe(data)
    assert track["samples"] == 18 and track["duration"] == 18 * 20 and read_payload(data, track) == b"".join(body)
    assert [data[a : a + n] for a, n in track["keyframes"].tolist()] == want
    for broken in (data[: -len(body[-1]) - 8 + 3], data.replace(U(7, 1, 20), U(9, 1, 20))[:0] + moov + box(b"moof", box(b"traf", full_box(b"trun", U(1)))), moov + box(b"moof", box(b"traf", full_box(b"tfhd", U(3))))):
        with pytest.raises(ValueError):
            describe(broken)


BROKEN = {
    "sync beyond the samples": movie(tables([1, 2], 8, [3])),
    "sync 0": movie(tables([1, 2], 8, [0])),
    "empty mdhd": movie(tables([1, 2], 8), mdhd=box(b"mdhd")),
    "empty stsd": movie(box(b"stsd") + tables([1], 8)),
    "huge count": movie(tables([1], 8).replace(full_box(b"stsz", U(0, 1), U(1)), full_box(b"stsz", U(1, 0xFFFFFFFF)))),
    "huge table": movie(tables([1], 8).replace(U(1, 1, 40), U(0xFFFFFFF0, 1, 40))),
    "chunk beyond the file": movie(tables([1, 2], 1 << 30)),
    "chunk runs from 0": movie(tables([1], 8).replace(U(1, 1, 1, 1), U(1, 0, 1, 1))),
    "chunk runs beyond": movie(tables([1], 8).replace(U(1, 1, 1, 1), U(1, 2, 1, 1))),
    "no tables": movie(b""),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_numbers(name):
    with pytest.raises(ValueError):
        describe(box(b"mdat", bytes(99)) + BROKEN[name])


def test_broken_bytes_never_break_a_column(spark):
    r = random.Random(9)
    good = write(bytes(range(256)) * 3, chunk_units=2, sync_every=3)
    rows = [(0, bytearray(good)), (1, None), (2, bytearray()), (3, bytearray(box(b"mdat", bytes(99)) + movie(tables([1, 2], 8), mdhd=full_box(b"mdhd", U(0, 0, 0, 0)))))]
    for i in range(400):
        data = bytearray(good)
        for _ in range(r.randint(1, 4)):
            data[r.randrange(len(data) - 768)] = r.choice([0, 1, 255, r.randrange(256)])
        rows.append((10 + i, data))
    found = iso_media.describe_column(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    by_id = {x.id: x for x in found}
    assert by_id[0].samples == 12 and by_id[3].error == "a timescale of 0" and 1 not in by_id and 2 not in by_id
    assert sum(x.error is not None for x in found) > 20


def test_digests_of_all_texts(spark, sf_dir):
    """Every document: features from the text's own bytes, keyframes hold every 16th block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = iso_media.store_texts(docs)
    media = {x.doc_id: bytes(x.media) for x in stored.collect()}
    found = {x.doc_id: x for x in iso_media.digests(stored).collect()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        raw = (text or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        row, blocks, centred = found[i], len(raw) // 64, [b - 128 for b in raw]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(centred, centred[1:]))
        level, loud = sum(centred) / len(raw), math.sqrt(sum(x * x for x in centred) / len(raw))
        assert row.feature == f"raw;{len(raw) / 8000:.6f}s;{blocks};{-(-blocks // 16)};{level:.4f};{loud:.4f};{max(map(abs, centred))};{crossings}"
        assert (row.media_bytes, row.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert [media[i][k.start : k.start + k.bytes] for k in row.keyframes] == [raw[64 * b : 64 * b + 64] for b in range(0, blocks, 16)]


def test_digests_of_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert iso_media.digests(iso_media.store_texts(docs)).collect() == []
    assert np.array_equal(iso_media.range_lists([]).to_pylist(), [])
