"""Language identification rejects what is in none of its languages."""

import random

from serixa.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_text_of_no_known_language_is_rejected(spark, sf_dir):
    r = random.Random(4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)),
        "Привет, как дела, сегодня хорошая погода в городе. " * 4,
        "今天天气很好我们去公园吧" * 8,
        f"{r.getrandbits(1600):x}",
        "1234567 89012 3456 a " * 9,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    ]
    rows = [(10**9 + i, t, [None, "en"][i % 2], "src1", len(t)) for i, t in enumerate(odd * 2 + odd[:1])]
    model = langid.fit_sample(docs.selectExpr("text", "lang label"), 2000)
    table = docs.union(spark.createDataFrame(rows, SCHEMA))
    found = langid.identify(table.selectExpr("doc_id id", "text", "lang declared", "cast(null as string) suffix", "source host"), model)
    accepted = {x.id for x in found.where("accepted").collect()}
    assert accepted == {x.doc_id for x in docs.collect()}


def test_unseen_trigrams_favour_no_language():
    """Languages of very different samples are alike on what none has seen."""
    model = langid.Model.fit(["the thing and that " * 500, "der die das"], ["en", "de"])
    data = "xq jw vz".encode()
    import numpy as np

    logs, *_ = model.scores(np.array([0, len(data)]), np.frombuffer(data, np.uint8))
    assert abs(logs[0, 0] - logs[0, 1]) < 1e-6


def test_null_and_repeated_ids_are_judged(spark):
    rows = [(None, "12 34", "en", "s", 5), (None, "the thing", "en", "s", 9), (1, "56 78", "en", "s", 5), (1, "the other", "en", "s", 9)]
    kept = langid.keep_identified(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", "the other"), ("None", "the thing")]


def plain_fusion(rows, model, trust=0.9, weight=20.0):
    """rows: (key, text, declared, suffix, host); {key: (lang, confidence)} by loops over rows."""
    import math

    import numpy as np

    names, scored = model.languages, []
    for key, text, declared, suffix, host in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        logs, letters, _ = model.scores(np.array([0, len(data)]), data)
        odds = [math.exp(x - max(logs[0])) for x in logs[0]]
        scored.append((key, list(logs[0]), [o / sum(odds) for o in odds], bool(letters[0]), declared, suffix, host))

    def sums(at, value):
        own = [s for *s, in scored if s[3] and (at is None or s[at] == value)]
        return [sum(s[2][i] for s in own) for i in range(len(names))], len(own)

    known = {}

    def level(at, value):
        if (at, value) not in known:
            known[at, value] = sums(at, value)
        return known[at, value]

    total, n = level(None, None)
    overall = [(t + 1) / (n + len(names)) for t in total]
    out = {}
    for key, logs, shares, letters, declared, suffix, host in scored:
        above = overall
        if suffix:
            s, n = level(5, suffix)
            above = [(x + weight * o) / (n + weight) for x, o in zip(s, overall)]
        prior = overall
        if host:
            s, n = level(6, host)
            prior = [(x - letters * own + weight * a) / (n - letters + weight) for x, own, a in zip(s, shares, above)]
        fused = []
        for i, name in enumerate(names):
            said = 0.0 if declared not in names else math.log(trust) if declared == name else math.log((1 - trust) / (len(names) - 1))
            fused.append(logs[i] + math.log(max(prior[i], 1e-9)) + said)
        best = max(fused)
        out[key] = names[fused.index(best)], 1 / sum(math.exp(f - best) for f in fused)
    return out


def test_query_equals_plain_fusion(spark, sf_dir):
    """Every document and page of the query against the plain version; text alone agrees with what the pages' markup declares."""
    import re

    from serixa.llm import queries
    from serixa.llm.html_text import render

    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = langid.fit_documents(docs, 2000)
    rows = [(("d", r.doc_id), r.text, None, None, r.source) for r in docs.collect()]
    told = {}
    for r in pages.collect():
        host = re.search(r"://([^/?#:]*)", r.url)[1].lower()
        told[r.page_id] = re.search(r"<html[^>]* lang=\"?(\w+)", r.html)[1]
        rows.append((("p", r.page_id), render(r.html), told[r.page_id], host.rsplit(".", 1)[1], host))
    want = plain_fusion(rows, model)
    found = queries.op6_language_id(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        lang, confidence = want["d", r.doc_id] if r.page_id is None else want["p", r.page_id]
        assert r.lang == lang and abs(r.confidence - confidence) < 1e-9
    by_text = [r.text_lang == told[r.page_id] for r in found if r.page_id is not None]
    assert sum(by_text) > 0.95 * len(by_text)
