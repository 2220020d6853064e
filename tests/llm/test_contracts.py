"""Each operator's query over a whole small table against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from serixa.llm import iso_media, langid, license_scan, mixing, packing, queries, simhash, suffix_dedup, topk, url_filter

from . import brute
from .test_near_copies import survivors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hard_texts():
    """Nulls, empty and tiny texts, long ones, exact copies, shared passages at all distances from other text."""
    r = random.Random(5)
    words = ["ab", "the", "Über", "x", "licence", "mit", "ñandú", "under", "cc", "by", "nc", "Apache", "license", "version", "2", "ij\u0130"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", "", "7", "q"]) for _ in range(n))
    shared, other = say(70), say(60)
    texts = [None, "", " ", "a", "é", "a" * 199, "b" * 200, "c" * 201, "c" * 450, "zz" * 300, say(30), say(3000)]
    for _ in range(12):
        texts.append(say(r.randint(0, 20)) + shared[r.randint(0, 150) :] + say(r.randint(0, 10)) + other[: r.randint(150, 400)])
    texts += [shared, shared, "Under the MIT License; under the mit license, CC-BY-NC", "apache license, version 2.0", texts[-3], texts[-4]]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s1", None, "s0", "hot", "hot", "hot"][i % 6], len(t or "")) for i, t in enumerate(hard_texts())]
    rows += [rows[-1], (None, "no id at all " * 20, None, None, 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def whole(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_suffix_dedup(spark, docs, empty, sf_dir):
    assert sorted(map(tuple, suffix_dedup.digests(docs).collect()), key=str) == brute.suffix_digests(pairs(docs))
    assert suffix_dedup.digests(empty).count() == 0
    found = queries.op2_suffix_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=str) == brute.suffix_digests(pairs(whole(spark, sf_dir)))


@pytest.mark.parametrize(("span", "gram", "letters"), [(20, 6, "ab"), (16, 16, "abc"), (40, 12, "aaab"), (256, 48, "ab")])
def test_suffix_dedup_of_dense_repeats(spark, span, gram, letters):
    """Few letters, so that anchors tie, runs overlap and most windows repeat somewhere."""
    r = random.Random(span)
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 400)))) for i in range(80)]
    rows += [(100 + i, (rows[i][1] + rows[i + 1][1])[r.randint(0, 60) :]) for i in range(40)]
    rows += [(200 + i, r.choice("ab") * r.randint(0, 500) + "b" * r.randint(0, 90)) for i in range(20)]
    rows += [(300 + i, "abcabcab" * r.randint(0, 60)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for crowd in (suffix_dedup.CROWD, 3):
        assert sorted(map(tuple, suffix_dedup.digests(docs, span, gram, crowd).collect()), key=str) == brute.suffix_digests(rows, span)


def test_suffix_dedup_of_many_equal_rows(spark):
    """Rows of one id and text, and rows without an id, however often they are repeated."""
    r = random.Random(17)
    say = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    once, twice, none = say(900), say(700), say(800)
    rows = [(1, once)] + [(2, twice)] * 300 + [(None, none)] * 300 + [(3, once[100:400] + say(50)), (None, say(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, suffix_dedup.digests(docs).collect()), key=str) == brute.suffix_digests(rows)


def test_suffix_cut_keeps_characters(docs, empty):
    out = suffix_dedup.cut(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and suffix_dedup.cut(empty).count() == 0
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_multikey_sort():
    r = random.Random(1)
    rows = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 30))) for _ in range(400)]
    data = np.frombuffer(b"".join(rows) + b"\0", np.uint8)
    sizes = np.array([len(x) for x in rows])
    order, lcp = suffix_dedup.multikey_sort(suffix_dedup.word_columns(data, np.cumsum(sizes) - sizes, sizes, False), sizes)
    assert [rows[i] for i in order] == sorted(rows)
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [share(rows[a], rows[b]) for a, b in zip(order, order[1:])]


def test_topk(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op3_topk_search(spark, sf_dir).collect()]
    assert sorted(found) == brute.topk([(r.vec_id, r.embedding) for r in table.collect()])


def test_topk_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) for _ in range(20)], 0) for i in range(120)]
    rows[7] = (7, None, 0)
    rows[50] = (50, [float("nan")] + [0.1] * 19, 0)
    rows[51] = (51, [None] + [0.1] * 19, None)
    rows[52] = (52, [float("inf")] + [0.1] * 19, None)
    rows[60:90] = [(i, [0.25] * 20, 1) for i in range(60, 90)]  # ties
    df = spark.createDataFrame(rows + [(None, [0.5] * 20, 2), (200, [1.0] * 3, 0), (201, [2.0] * 3, 0)], "vec_id long, embedding array<float>, label int")
    found = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df).collect())
    single = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    assert found == sorted(brute.topk(single) + [(200, 1, 201, 256 * 512 * 3)])
    none = topk.search(df.where("vec_id < 0"))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0


def test_topk_large_components_and_repeats(spark, monkeypatch):
    """Scores of any size rank exactly; rows of one id are candidates each; columns with other operators' names change nothing."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(130)]
    rows += [(3, [1e300] * 6), (4, [-1e300] + [0.0] * 5), (5, [1e308] * 6), (6, [3e7 + 0.3, -2.0, 0.5, 1e17, 0.0, 1.0]), (50, [0.9] * 6), (7, [-1e300] * 6), (8, [0.2] * 6), (8, [0.2] * 6)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "vec_id long, embedding array<double>, id int, q int, score int")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(df).collect())
    from fractions import Fraction
    from math import floor

    whole = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        own = min(v for (i, _), (_, v) in zip(rows, rows) if i == q)
        own = [floor(Fraction(x) * 256) for x in own]
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q)[:5]
        want += [(q, n + 1, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for n, (s, i) in enumerate(best)]
    assert got == want


def test_packing(spark, docs, empty, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for pieces, table in ((queries.op4_packing(spark, sf_dir), whole(spark, sf_dir)), (packing.pack(docs, queries.tokenizer_path()), docs)):
        assert brute.check_packing(pieces.collect(), pairs(table), encode) == 0
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_license_scan(spark, docs, empty, sf_dir):
    for found, table in ((license_scan.scan(docs), docs), (queries.op5_license_scan(spark, sf_dir), whole(spark, sf_dir))):
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found.collect()), key=str)
        assert got == sorted(((i, *license_scan.reference_scan(t)) for i, t in pairs(table)), key=str)
    assert license_scan.scan(empty).count() == 0


def test_license_notice_with_gaps(spark):
    words = license_scan.NOTICES["bsd"].split()
    near = " ".join(words[:10] + ["very", "new"] + words[10:25] + words[26:])
    rows = spark.createDataFrame([(1, near), (2, " ".join(words[:6])), (3, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in license_scan.scan(rows).collect()}
    assert got[1][:2] == ("bsd", "") and 0.7 <= got[1][2] < 1 and got[2][0] == "" and 0 < got[2][2] < 0.7 and got[3] == ("", "", 0.0)


def test_language_held_out(spark, sf_dir):
    big = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    fit, held = big.where("doc_id % 2 = 0"), big.where("doc_id % 2 = 1 and n_chars > 40")
    model = langid.fit_sample(fit.selectExpr("text", "lang label"), 300)
    rows = held.selectExpr("doc_id id", "text", "cast(null as string) declared", "cast(null as string) suffix", "source host")
    found = langid.identify(rows, model).join(held.selectExpr("doc_id id", "lang truth"), "id").collect()
    assert np.mean([r.lang == r.truth for r in found]) > 0.95


def test_language_rejects_only_what_has_no_letters(docs, empty):
    kept = {r.doc_id for r in langid.keep_identified(docs).collect()}
    assert kept == {i for i, t in pairs(docs) if t and any(c.isalpha() for c in t)}
    assert langid.keep_identified(empty).count() == 0 and langid.of_documents(empty).count() == 0


def test_language_evidence_of_pages(spark):
    model = langid.Model.fit(["the thing and that", "der die das und ich"], ["en", "de"])
    pages = spark.createDataFrame(
        [(i, f"http://h{i % 2}.de/x", "<html lang='de-AT'>12 34") for i in range(4)] + [(9, None, None), (10, "http://h0.de/", "<html>")], "page_id long, url string, html string"
    )
    got = {r.page_id: r for r in langid.of_pages(pages, model).collect()}
    assert got[0].lang == "de" and got[0].declared == "de" and got[0].text_lang is None and not got[0].accepted and got[9].declared is None


def test_mixing(spark, docs, empty, sf_dir):
    for table in (whole(spark, sf_dir), docs):
        found = mixing.mix(table).collect()
        sizes, taken = {}, {}
        for r in found:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        goal = brute.targets(sizes)
        assert all(abs(r.target - goal[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source] for r in found)
        most = max(r.size for r in found)
        assert all(abs(taken[s] - goal[s]) <= most for s in goal)
        again = mixing.mix(table.repartition(3)).collect()
        assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    emitted, want = mixing.emit(docs).count(), sum(r.taken // r.size for r in mixing.mix(docs.where("text is not null and trim(text) <> ''")).collect())
    assert abs(emitted - want) <= docs.count() * 0.2


def test_iso_media(spark, docs, empty, sf_dir):
    for found, table in ((queries.op8_iso_media(spark, sf_dir), whole(spark, sf_dir)), (iso_media.digests(iso_media.store_texts(docs)), docs)):
        want = []
        for i, t in pairs(table):
            raw = (t or "").encode()
            data = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want.append((i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
        assert sorted((tuple(r)[:5] for r in found.collect()), key=str) == sorted(want, key=str)
    assert iso_media.store_texts(empty).count() == 0


def test_iso_media_boxes(spark):
    data = iso_media.write(bytes(range(256)) * 20, chunk_units=7, sync_every=3)
    (track,) = iso_media.describe(data)
    assert (track["codec"], track["samples"], track["duration"]) == ("raw ", 80, 5120)
    assert iso_media.read_payload(data, track) == bytes(range(256)) * 20
    assert [data[a : a + n] for a, n in track["keyframes"].tolist()] == [(bytes(range(256)) * 20)[i * 64 : i * 64 + 64] for i in range(0, 80, 3)]
    boxes = {b for path, _, b in iso_media.walk(memoryview(data)) if len(path) == 1}
    for cut in (c for c in range(8, len(data), 41) if c not in boxes):
        with pytest.raises(ValueError):
            iso_media.describe(data[:cut])
    media = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"\0\0\0\x63moov")), (3, None)], "id long, media binary")
    got = {r.id: r for r in iso_media.describe_column(media, "id", "media").collect()}
    assert got[1].samples == 80 and got[1].error is None and got[2].error and 3 not in got


def test_simhash(spark, docs, empty, sf_dir):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, sf_dir).collect())
    assert got == brute.components(pairs(whole(spark, sf_dir)))
    named = docs.where("doc_id is not null")
    got = sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(named).collect())
    assert got == brute.components(pairs(named))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("count", [10, 1 << 22, 1 << 30])
def test_simhash_tables_meet_every_pair(count):
    ranges, tables = simhash.block_tables(count, 4)
    r = random.Random(count)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 4):
            y ^= 1 << b
        same = {i for i, (lo, hi) in enumerate(ranges) if (x ^ y) >> lo & (1 << hi - lo) - 1 == 0}
        assert any(set(t) <= same for t in tables)


def test_simhash_links_and_large_buckets(spark, monkeypatch):
    r = random.Random(9)
    bases = [r.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in bases for _ in range(20)}
    monkeypatch.setattr(simhash, "PART", 40)
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(simhash.forest_edges(rows, 4)).collect()}
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    groups, found = {}, {}
    for v in values:
        groups.setdefault(root(v), set()).add(v)
        found.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_url_filter(spark, sf_dir):
    got = {r.page_id: r for r in queries.op1_url_filter(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        host, path = brute.url_parts(p.url)
        rule, verdict = brute.url_rule(host, path)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.matched else "allow"))


def test_url_filter_mines_rules(spark):
    pages = [(i, f"http://{'cheap-pills' if i % 3 == 0 else 'good'}{i % 2}.example.com/en/{i}?a=1") for i in range(90)]
    pages += [(90, None), (91, "no scheme"), (92, "x://NET"), (93, "x://A.NET/q#://z"), (94, pages[0][1]), (None, pages[0][1])]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(60)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(table, labels).collect()}
    assert len(got) == len(pages)
    assert all(got[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(90))
    assert got[90].host == got[91].host == got[91].path == "" and got[92].rule is None and got[92].host == "net" and got[93].rule == "net/" and got[94].verdict == "block"
    assert {r.verdict for r in url_filter.judge(table, labels.where("doc_id < 0")).collect() if r.rule is None} == {"allow"}
    assert url_filter.judge(table.where("page_id < 0"), labels).count() == 0


CLASHES = ["k1", "k2", "rest", "runs", "gram", "context", "place", "fp", "root", "row", "key", "size", "copies", "id", "hash", "turn", "part", "at", "w", "host", "declared", "f_lang", "_kept", "a.b"]


def test_clashing_columns_and_stages(spark, docs, empty):
    """Every stage gives the same with extra columns that have the operators' own names, and hands these on."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, ""), stage(spark, wide, "")
        assert plain.columns == docs.columns and plain.dtypes == docs.dtypes, name
        assert more.columns == wide.columns, name
        rows = lambda df: sorted(map(str, df.select(*docs.columns).collect()))
        assert rows(plain) == rows(more), name
        assert [r["a.b"] for r in more.limit(1).collect()] == [len(CLASHES) - 1]
        assert stage(spark, empty, "").count() == 0
    pieces = lambda df: corpus_pipeline.STAGES[-1][1](spark, df, "").drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct()
    assert sorted(map(str, pieces(docs).collect())) == sorted(map(str, pieces(wide).collect()))
    queries_of = (suffix_dedup.digests, license_scan.scan, langid.of_documents, mixing.mix, lambda d: iso_media.digests(iso_media.store_texts(d)), simhash.near_duplicates)
    for f in queries_of:
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(wide).collect()))


def test_very_long_text(spark):
    r = random.Random(7)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(300_000))
    rows = [(1, long + " under the MIT license", "en", "s"), (2, long[1_000_000:1_000_500], "en", "s"), (3, "x", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in suffix_dedup.digests(docs).collect()}
    assert got[1].n_removed == got[2].n_removed == 500 and got[3].n_removed == 0
    scan = {x.doc_id: x for x in license_scan.scan(docs).collect()}
    assert scan[1].n_base == 1 and scan[1].first_word == scan[1].n_words - 4
    assert {x.doc_id: x.payload_bytes for x in iso_media.digests(iso_media.store_texts(docs)).collect()}[1] >= len(long)
    assert mixing.mix(docs).count() == simhash.near_duplicates(docs).count() == 3


def test_pipeline_end_to_end(spark, sf_dir):
    import corpus_pipeline

    docs = whole(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir)
        if name == "language_id":
            assert docs.count() == before.count()
        if name == "simhash":
            assert sorted(r.doc_id for r in docs.collect()) == survivors(pairs(before))
        if name == "suffix_dedup":
            cut = {i: n for i, _, n, *_ in brute.suffix_digests(pairs(before))}
            for r, b in zip(docs.orderBy("doc_id").collect(), before.orderBy("doc_id").collect()):
                assert 0 <= len(b.text.encode()) - len(r.text.encode()) <= cut[r.doc_id]
        if name == "packing":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            assert brute.check_packing(docs.collect(), pairs(before), lambda t: tokenizer.encode(t, add_special_tokens=False).ids) == 0
        docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_mixing_copies_by_systematic_sampling(spark):
    """Plain version: documents of a source by size and hash, one copy for each whole number that the running sum crosses."""
    import math

    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "b", "c", None])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    hashed = {x.doc_id: x for x in docs.select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"), F.md5(F.concat(F.lit("7/"), F.coalesce("source", F.lit("")))).alias("s"), mixing.word_count(F.col("text")).alias("n")).collect()}
    found = {x.doc_id: x for x in mixing.mix(docs).collect()}
    sizes = {}
    for x in hashed.values():
        sizes[x.source] = sizes.get(x.source, 0) + x.n
    goal = brute.targets(sizes)
    for source, size in sizes.items():
        own = sorted((x for x in hashed.values() if x.source == source), key=lambda x: (x.n, x.h, x.doc_id))
        rate, offset = goal[source] / size, int(own[0].s[:5], 16) / (1 << 20)
        for rank, x in enumerate(own):
            copies = math.floor(offset + rate * (rank + 1)) - math.floor(offset + rate * rank)
            assert found[x.doc_id].taken == copies * x.n


def test_simhash_of_null_and_repeated_ids(spark, docs):
    """Rows without an id are linked as others; their component is named by the least id that it has."""
    found = sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert found == sorted((str(a), b, str(c)) for a, b, c in brute.components(pairs(docs)))


def test_empty_tables_have_columns(spark, empty):
    assert iso_media.digests(iso_media.store_texts(empty)).columns[:3] == ["doc_id", "n_bytes", "payload_bytes"]
    assert suffix_dedup.digests(empty).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.of_both(empty, pages).count() == 0
    assert langid.of_both(empty, spark.createDataFrame([(1, "http://a.de/", "<p>x")], pages.schema)).collect()[0].lang is None


def test_very_long_text_elsewhere(spark):
    """One text of some megabytes in the operators that the other test leaves out."""
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(200_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string")
    pieces = packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) == next(p.doc_tokens for p in pieces if p.doc_id == 1) > 200_000
    assert langid.of_documents(docs).count() == 2
    pages = spark.createDataFrame([(1, "http://a.com/" + "x/" * 100_000, f"<p>{long}</p>")], "page_id long, url string, html string")
    from serixa.llm import html_text

    assert html_text.extract(pages).first().text == long
    judged = url_filter.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert judged.host == "a.com" and len(judged.path) == 200_001 and judged.verdict == "allow"
