"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suffix_digests(rows, span=200):
    """rows: (id, text); sorted digests."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(r[a : a + span] for _, r in raws for a in range(len(r) - span + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for a in range(len(r) - span + 1):
            if counts[r[a : a + span]] > 1:
                gone[a : a + span] = b"\1" * span
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def topk(rows, k=5, every=50, scale=256.0):
    """rows: (id, vector)."""
    good = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted((-int(v @ w), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def simhash_value(text, words=4):
    parts = [p for p in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if p]
    if not parts:
        return 0
    grams = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, radius=4):
    """rows: (id, text); (id, fingerprint, smallest id reachable)."""
    marks = [(i, simhash_value(t)) for i, t in rows]
    distinct = sorted({f for _, f in marks})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for a, x in enumerate(distinct):
        for y in distinct[a + 1 :]:
            if (x ^ y).bit_count() <= radius:
                parent[root(x)] = root(y)
    least = defaultdict(list)
    for i, f in marks:
        least[root(f)].append(i)
    rows = [(i, f"{f:016x}", min((x for x in least[root(f)] if x is not None), default=None)) for i, f in marks]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """sizes: {source: words}; the target of each by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        mass = sum(weight[s] for s in free)
        goal = {s: left * weight[s] / mass for s in free} if mass else {}
        over = [s for s in free if goal[s] > cap * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: cap * sizes[s] for s in over}


def url_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def url_rule(host, path):
    best = None
    for how, name, prefix in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == name or host.endswith("." + name)) and path.startswith(prefix) and (best is None or len(name + prefix) > len(best[0])):
            best = name + prefix, how
    return best or (None, None)


def check_packing(pieces, rows, encode, capacity=2048):
    """Asserts the packing contract; returns the padding in tokens."""
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(encode(t or "") + [1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, own in by_doc.items():
        assert len(ids[i]) >= 1
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i][0])
                assert p.ids_crc32 == zlib.crc32(np.array(ids[i][0][at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(ids[i][0])
        else:
            assert sum(p.length for p in own) == sum(map(len, ids[i]))
    assert set(by_doc) == set(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding
