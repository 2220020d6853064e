"""Rules are mined from labels, not from declared verdicts."""

from serixa.llm import url_filter


def test_declared_verdicts_are_no_labels(spark):
    """Pages that only resemble what declared rules block stay, as their labels say."""
    pages = [(i, f"http://a{i}.example.com/de/x") for i in range(60)] + [(100 + i, f"http://b{i}.example.org/de/x") for i in range(20)]
    pages += [(200 + i, f"http://c{i}.example.org/en/x") for i in range(20)]
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert all(got[i].verdict == "block" and got[i].rule == "example.com/de/" for i in range(60))
    assert all(got[i].verdict == "allow" and got[i].matched is None for i in got if i >= 100)


def test_rules_of_many_tokens(spark):
    """Only all seven tokens together are sure: any six of them stand as often in good urls."""
    names = [f"t{i}" for i in range(7)]
    rows = [(names, True)] * 40 + [([t for t in names if t != out], False) for out in names for _ in range(15)]
    mined = url_filter.mine(spark.createDataFrame(rows, "items array<string>, bad boolean")).collect()
    assert [(r.antecedent, r.confidence) for r in mined] == [(names, 1.0)]


def plain_rules(rows, support, confidence, lift):
    """rows: (tokens, bad); every token set by brute force: {(verdict, tokens): confidence}."""
    from itertools import combinations

    n = len(rows)
    sets = {frozenset(c) for items, _ in rows for k in range(1, len(items) + 1) for c in combinations(sorted(set(items)), k)}
    held = {}
    for tokens in sets:
        having = [bad for items, bad in rows if tokens <= set(items)]
        for verdict, bad in (("block", True), ("allow", False)):
            both, base = sum(b == bad for b in having), sum(b == bad for _, b in rows)
            sure = both / len(having)
            if both >= support * n and sure >= confidence and sure / (base / n) >= lift:
                held[verdict, tokens] = sure
    spent = {k for k, sure in held.items() if any(held.get((k[0], k[1] - {t}), -1) >= sure for t in k[1])}
    return {k: v for k, v in held.items() if k not in spent}


def test_mining_and_matching_equal_brute_force(spark):
    import random

    r = random.Random(12)
    letters = "abcdefg"
    rows = []
    for _ in range(150):
        items = sorted(r.sample(letters, r.randint(1, 5)))
        bad = ("a" in items and "c" in items) or (r.random() < 0.25 and "g" not in items)
        rows.append((items, bad))
    mined = url_filter.mine(spark.createDataFrame(rows, "items array<string>, bad boolean"), 0.03, 4, 0.75, 1.1)
    want = plain_rules(rows, max(0.03, 4 / len(rows)), 0.75, 1.1)
    assert {(x.verdict, frozenset(x.antecedent)): round(x.confidence, 9) for x in mined.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert {v for v, _ in want} == {"block", "allow"} and max(len(t) for _, t in want) > 1
    urls = [(f"u{i}", sorted(r.sample(letters + "xyz", r.randint(0, 6)))) for i in range(200)]
    found = {x.row: (x.how, x.matched, round(x.confidence, 9)) for x in url_filter.match(spark.createDataFrame(urls, "row string, items array<string>"), mined).collect()}
    for row, items in urls:
        fits = [(sure, verdict, " ".join(sorted(tokens))) for (verdict, tokens), sure in want.items() if tokens <= set(items)]
        if not fits:
            assert row not in found
            continue
        sure, verdict, name = max(fits)
        assert found[row] == (verdict, name, round(sure, 9))
