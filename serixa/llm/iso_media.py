"""ISO base media containers: writing, walking and reading by sample tables.

A container is a tree of boxes (size, four-letter type, body).  The reader walks
the boxes of the `moov` tree, decodes the sample tables (durations, sizes,
chunks, sync samples, fragments' track runs) into runs, and gives the codec, the duration
and the byte range of every keyframe; it touches no payload byte.  The payload is read
only where it is asked for, by the ranges of the tables.

Defined results: a null text is empty; an empty payload is one block of zeros; a
null id stays null; repeated rows get a row each; equal texts give equal files.
Broken or truncated boxes, and numbers that lead out of the file, raise ValueError in
`describe`, and `describe_column` reports them in its `error` column instead.  Ties can't
occur; an empty table gives no rows; texts of any length are stored whole; columns other
than those named are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_views, slices

#: Boxes that hold boxes, with the bytes before the first of them.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write(payload: bytes, unit: int = 64, chunk_units: int = 256, sync_every: int = 16, timescale: int = 8000, codec: bytes = b"raw ") -> bytes:
    """A file with one track of 8-bit mono samples; access units of `unit` samples, each unit a table entry."""
    count, tail = divmod(len(payload), unit)
    if tail or not count:
        raise ValueError("the payload must be a positive multiple of the unit")
    chunks, last = divmod(count, chunk_units)
    runs = [(1, chunk_units)] * bool(chunks) + [(chunks + 1, last)] * bool(last)
    duration = count * unit
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(base: int) -> bytes:
        places = np.arange(chunks + bool(last), dtype=np.int64) * (chunk_units * unit) + base
        wide = bool(len(places)) and int(places[-1]) >= 1 << 32
        offsets = full_box(b"co64" if wide else b"stco", struct.pack(">I", len(places)), places.astype(">u8" if wide else ">u4").tobytes())
        sync = np.arange(1, count + 1, sync_every).astype(">u4")
        entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, timescale << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, count, unit)),
            full_box(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full_box(b"stsz", struct.pack(">II", unit, count)),
            offsets,
        )
        dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), dinf, stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, duration & 0xFFFFFFFF, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">hhhh", 0, 0, 256, 0), MATRIX, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIII", 0, 0, timescale, duration & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    base = len(ftyp) + len(moov(0)) + head
    return ftyp + moov(base) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of each box, depth first."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield (*path, kind), start + head, start + size
        if kind in PARENTS and len(path) < 16:
            yield from walk(data, start + head + PARENTS[kind], start + size, (*path, kind))
        start += size


def _table(data: memoryview, start: int, end: int, kinds: str, skip: int = 4) -> np.ndarray:
    """The entries of a counted table as rows of unsigned integers."""
    (count,) = struct.unpack_from(">I", data, start + skip)
    record = np.dtype([(str(i), f">u{k}") for i, k in enumerate(kinds)])
    if start + skip + 4 + count * record.itemsize > end:
        raise ValueError("sample table leaves its box")
    rows = np.frombuffer(data, record, count, start + skip + 4)
    return np.stack([rows[n].astype(np.int64) for n in record.names], axis=1) if count else np.zeros((0, len(kinds)), np.int64)


def _field(data: memoryview, form: str, at: int, end: int) -> tuple:
    """Numbers at a place that must lie in their box."""
    if at + struct.calcsize(form) > end:
        raise ValueError("a field leaves its box")
    return struct.unpack_from(form, data, at)


def _sizes(data: memoryview, a: int, b: int, compact: bool) -> tuple[int, int, np.ndarray | None]:
    """(size of all or 0, count, sizes or None) of an stsz or stz2 box; a count is never believed before it is checked."""
    if not compact:
        same, count = _field(data, ">II", a + 4, b)
        return same, count, None if same else _table(data, a, b, "4", 8)[:, 0]
    bits, count = _field(data, ">xxxBI", a + 4, b)
    if bits not in (4, 8, 16) or a + 12 + (count * bits + 7) // 8 > b:
        raise ValueError("compact sample sizes leave their box")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, (count + 1) // 2, a + 12)
        return 0, count, np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:count].astype(np.int64)
    return 0, count, np.frombuffer(data, f">u{bits // 8}", count, a + 12).astype(np.int64)


def _run(data: memoryview, a: int, b: int, held: dict) -> dict:
    """The samples of a trun box: their place, sizes, durations and which can be decoded by themselves."""
    flags, count = _field(data, ">II", a, b)
    at, flags = a + 8, flags & 0xFFFFFF
    offset = first = None
    if flags & 1:
        (offset,), at = _field(data, ">i", at, b), at + 4
    if flags & 4:
        (first,), at = _field(data, ">I", at, b), at + 4
    names = [n for bit, n in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    if at + 4 * len(names) * count > b or not names and count > len(data):
        raise ValueError("a track run leaves its box")
    table = np.frombuffer(data, ">u4", len(names) * count, at).reshape(count, len(names)).astype(np.int64)
    column = lambda n: table[:, names.index(n)] if n in names else np.full(count, held.get(n, 0), np.int64)
    marks = column("flags").copy()
    if first is not None and count:
        marks[0] = first
    return {"offset": offset, "sizes": column("size"), "durations": column("duration"), "sync": marks & 0x10000 == 0, "shifted": "shift" in names}


def _fragment(data: memoryview, a: int, b: int, start: int, defaults: dict[int, dict], by_id: dict[int, dict]) -> None:
    """Adds the runs of a moof box, which begins at start, to their tracks."""
    track, base, held, after = None, start, {}, None
    for path, x, y in walk(data, a, b, (b"moof",)):
        if path[-1] == b"tfhd":
            flags, name = _field(data, ">II", x, y)
            track, base, held, after, at = by_id.get(name), start, dict(defaults.get(name, {})), None, x + 8
            if track is None:
                raise ValueError("a fragment of no track")
            for bit, form, what in ((1, ">Q", "base"), (2, ">I", "entry"), (8, ">I", "duration"), (16, ">I", "size"), (32, ">I", "flags")):
                if flags & bit:
                    (held[what],), at = _field(data, form, at, y), at + struct.calcsize(form)
            base = held.get("base", start)
        elif path[-1] == b"trun":
            if track is None:
                raise ValueError("a track run without a header")
            run = _run(data, x, y, held)
            begin = base + run["offset"] if run["offset"] is not None else base if after is None else after
            after = begin + int(run["sizes"].sum())
            if begin < 0 or after > len(data):
                raise ValueError("a track run leaves the file")
            track.setdefault("runs", []).append(run | {"begin": begin})


def describe(data: bytes | memoryview) -> list[dict]:
    """Per track: codec, timescale, duration, samples, shifted (whether samples are shown in another order than stored),
    keyframe ranges (n, 2) and chunk ranges (n, 2), in bytes; fragments are read too."""
    view = memoryview(data)
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    by_id: dict[int, dict] = {}
    for path, a, b in walk(view):
        kind = path[-1]
        if kind == b"trex":
            name, entry, duration, size, flags = _field(view, ">5I", a + 4, b)
            defaults[name] = {"duration": duration, "size": size, "flags": flags}
        elif path == (b"moof",):
            head = 16 if a >= 16 and view[a - 16 : a - 12] == b"\0\0\0\1" and view[a - 12 : a - 8] == b"moof" else 8
            _fragment(view, a, b, a - head, defaults, by_id)
        elif kind == b"trak":
            tracks.append({})
        elif not tracks or b"trak" not in path:
            continue
        elif kind == b"tkhd":
            (version,) = _field(view, ">B", a, b)
            by_id[_field(view, ">I", a + (20 if version == 1 else 12), b)[0]] = tracks[-1]
        elif kind == b"mdhd":
            (version,) = _field(view, ">B", a, b)
            scale, length = _field(view, ">IQ" if version == 1 else ">II", a + (20 if version == 1 else 12), b)
            tracks[-1] |= {"timescale": scale, "duration": length}
        elif kind == b"hdlr":
            tracks[-1]["handler"] = _field(view, ">4s", a + 8, b)[0].decode("latin-1")
        elif kind == b"stsd":
            tracks[-1]["codec"] = _field(view, ">4s", a + 12, b)[0].decode("latin-1")
        elif kind == b"stts":
            tracks[-1]["stts"] = _table(view, a, b, "44")
        elif kind == b"ctts":
            tracks[-1]["ctts"] = _table(view, a, b, "44")
        elif kind == b"stss":
            tracks[-1]["stss"] = _table(view, a, b, "4")[:, 0]
        elif kind == b"stsc":
            tracks[-1]["stsc"] = _table(view, a, b, "444")
        elif kind in (b"stco", b"co64"):
            tracks[-1]["chunks"] = _table(view, a, b, "4" if kind == b"stco" else "8")[:, 0]
        elif kind in (b"stsz", b"stz2"):
            tracks[-1]["sizes"] = _sizes(view, a, b, kind == b"stz2")
    return [_ranges(t, len(view)) for t in tracks]


def _ranges(track: dict, size: int) -> dict:
    """Sample places from the chunk runs; neighbouring samples of a chunk are adjacent."""
    if not {"sizes", "chunks", "stsc", "codec", "timescale"} <= track.keys():
        raise ValueError("a track lacks a sample table")
    same, count, sizes = track["sizes"]
    chunks, runs = track["chunks"], track["stsc"]
    if same and same * count > size or not same and count > 0 and sizes is None:
        raise ValueError("the samples exceed the file")
    firsts = runs[:, 0]
    if len(runs) and (firsts[0] != 1 or (np.diff(firsts) <= 0).any() or firsts[-1] > len(chunks)) or len(chunks) and not len(runs):
        raise ValueError("the chunk runs are out of order")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1))) if len(runs) else np.zeros(0, np.int64)
    if int(per_chunk.sum()) != count:
        raise ValueError("the chunk runs do not add up to the samples")
    if sizes is None:
        sizes = np.full(count, same, np.int64)
    first = np.cumsum(per_chunk) - per_chunk
    before = np.append(0, np.cumsum(sizes))
    starts = np.repeat(chunks - before[first], per_chunk) + before[:-1]
    chunk_ranges = np.stack([chunks, before[first + per_chunk] - before[first]], axis=1)
    if len(chunk_ranges) and (chunk_ranges.min() < 0 or chunk_ranges.sum(axis=1).max() > size):
        raise ValueError("a chunk leaves the file")
    sync = track.get("stss")
    if sync is not None and len(sync) and (sync.min() < 1 or sync.max() > count):
        raise ValueError("a sync sample is none of the samples")
    keys = np.arange(count) if sync is None else sync - 1
    length = int((track["stts"][:, 0] * track["stts"][:, 1]).sum()) if "stts" in track else track["duration"]
    keyframes = [np.stack([starts[keys], sizes[keys]], axis=1)]
    ranges = [chunk_ranges]
    for run in track.get("runs", ()):
        at = run["begin"] + np.cumsum(run["sizes"]) - run["sizes"]
        keyframes.append(np.stack([at, run["sizes"]], axis=1)[run["sync"]])
        ranges.append(np.array([[run["begin"], int(run["sizes"].sum())]], np.int64))
        count += len(at)
        length += int(run["durations"].sum())
    shifted = "ctts" in track and bool((track["ctts"][:, 1] != track["ctts"][:1, 1]).any()) or any(r["shifted"] for r in track.get("runs", ()))
    return {
        "codec": track["codec"],
        "handler": track.get("handler", ""),
        "timescale": track["timescale"],
        "duration": length,
        "samples": count,
        "shifted": shifted,
        "keyframes": np.concatenate(keyframes),
        "chunks": np.concatenate(ranges),
    }


def read_payload(data: bytes | memoryview, track: dict) -> bytes:
    view = memoryview(data)
    return b"".join(view[a : a + n] for a, n in track["chunks"].tolist())


def feature(track: dict, payload: bytes) -> str:
    """codec, duration in seconds, samples and keyframes from the tables; level, loudness, peak and crossings of the samples read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128  # 8-bit samples rest at 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    told = f"{track['codec'].strip()};{track['duration'] / track['timescale']:.6f}s;{track['samples']};{len(track['keyframes'])}"
    return f"{told};{x.sum() / len(x):.4f};{math.sqrt(int((x * x).sum()) / len(x)):.4f};{int(np.abs(x).max())};{crossings}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded with zeros to a positive multiple of the block, as a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, data = byte_views(part.column("text"))
                files = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    raw = data[a:b].tobytes()
                    files.append(write(raw + bytes(-len(raw) % block or (0 if raw else block))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<start:long,bytes:long>>"


def range_lists(tables: list[np.ndarray]) -> pa.Array:
    """Tables of (start, bytes) as a column of lists."""
    flat = np.concatenate([np.zeros((0, 2), np.int64), *tables])
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in (0, 1)], fields=list(RANGES.value_type))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(t) for t in tables])).astype(np.int32)), values)


def digests(stored: DataFrame) -> DataFrame:
    """What the stored files hold, read back by their sample tables; keyframes are byte ranges of the stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keyframes = [], []
            for doc, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
                raw = media.as_buffer()
                track = describe(memoryview(raw))[0]
                payload = read_payload(memoryview(raw), track)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(track, payload)))
                keyframes.append(track["keyframes"])
            names = [f.split()[0] for f in DIGEST.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DIGEST.split(", ")[:-1]]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), range_lists(keyframes)], names=names)

    return stored.mapInArrow(run, DIGEST)


def describe_column(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, track, codec, duration_s, samples, shifted, keyframes, error): one row per track; broken files, and a timescale of 0, give one row with an error."""
    schema = "id long, track int, codec string, duration_s double, samples long, shifted boolean, keyframes array<struct<start:long,bytes:long>>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.int64()), ("track", pa.int32()), ("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("shifted", pa.bool_()), ("keyframes", RANGES), ("error", pa.string())])
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist()):
                try:
                    own = describe(raw or b"")
                    if any(not t["timescale"] for t in own):
                        raise ValueError("a timescale of 0")
                    for i, t in enumerate(own):
                        rows.append({"id": name, "track": i, "codec": t["codec"], "duration_s": t["duration"] / t["timescale"], "samples": t["samples"], "shifted": t["shifted"], "keyframes": [{"start": a, "bytes": n} for a, n in t["keyframes"].tolist()], "error": None})
                except ValueError as error:
                    rows.append({"id": name, "error": str(error)})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, schema)
