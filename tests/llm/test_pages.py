"""Operators on pages and vectors against brute force."""

import gzip
import itertools
import math

import numpy as np
import pytest

from cellsieve.llm import topk_search, url_rules, warc

PAGES = [
    (1, "http://a.com/x", "p" * 1000),
    (2, "http://a.com/x", "p" * 1000),
    (3, None, "p" * 1000),
    (4, "HTTP://É.org/ü?q=1#f", "q" * 999),
    (5, "u r l\n", "q" * 999),
    (6, "", None),
    (7, "x://y", ""),
    (8, "x://y", "é" * 500 + "\r\n\r\nWARC/1.1\r\n"),
    (9, "x://z", "é" * 500 + "\r\n\r\nWARC/1.1\r\n"),
    (10, "x://z", "long " * 100_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "no", 1) for i, u, h in PAGES] + [(None, "x://n", "lost", "no", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n_bytes int").repartition(3)


def test_archives_give_back_every_page(spark, pages):
    import hashlib

    rows = {r["record_id"]: r for r in warc.archive_pages(spark, pages).collect()}
    assert len(rows) == len(PAGES) and all(r["reason"] is None for r in rows.values())
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in PAGES:
        payload = (h or "").encode()
        r = rows[f"urn:page:{i}"]
        again = len(payload) >= 1000 and last[h] != i
        assert r["record_type"] == ("revisit" if again else "response")
        assert r["refers_to"] == (f"urn:page:{last[h]}" if again else None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r["payload"] is None) == again and (again or bytes(r["payload"]) == payload)
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def members(n=6):
    raw = [warc.record_bytes(k, f"http://h/{k}", f"body {k} ".encode() * 50, __import__("hashlib").sha1(f"body {k} ".encode() * 50).hexdigest(), None) for k in range(n)]
    return raw, [gzip.compress(r, mtime=0) for r in raw]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_is_sound(packed):
    raw, zipped = members()
    parts = zipped if packed else raw
    begins = np.cumsum([0, *map(len, parts)]).tolist()
    found = lambda data: ([r["record_id"] for _, r, _ in warc.salvage(data) if r], [g for _, _, g in warc.salvage(data) if g])
    every = [f"urn:page:{k}" for k in range(len(parts))]
    assert found(b"".join(parts)) == (every, [])
    assert found(b"") == ([], [])
    # A flipped byte in one record.
    bad = bytearray(b"".join(parts))
    bad[begins[2] + len(parts[2]) // 2] ^= 255
    records, gaps = found(bytes(bad))
    assert records == every[:2] + every[3:] and [g[:2] for g in gaps] == [(begins[2], begins[3])]
    # Bytes missing between two records, junk in front, and a cut end.
    records, gaps = found(b"junk" + parts[0] + parts[1][:-20] + parts[2] + parts[3][:30])
    assert records == [every[0], every[2]] and len(gaps) == 3 and gaps[0][:2] == (0, 4)
    assert found(b"nothing here")[0] == []


def test_long_member_keeps_the_separator(spark, tmp_path):
    noise = "".join(chr(33 + b % 90) for b in np.random.default_rng(0).integers(0, 90, 17 * 1024 * 1024))
    pages = spark.createDataFrame([(1, "x://y", noise), (2, "x://y", "small")], "page_id long, url string, html string").coalesce(1)
    rows = warc.archive_pages(spark, pages).select("record_id", "payload_bytes", "reason").collect()
    assert {(r[0], r[1]) for r in rows if r[0]} == {("urn:page:1", len(noise)), ("urn:page:2", 5)}


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://WWW.Example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "https://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        (3, "https://a.example.com/en/1#f", "a.example.com", "/en/1", "example.com/en/", "block"),
        (4, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (5, "x://b.net/fr/", "b.net", "/fr/", "net/fr/", "block"),
        (6, "x://com", "com", "", None, "allow"),
        (7, None, "", "", None, "allow"),
        (8, "no scheme", "", "", None, "allow"),
        (9, "a?b://c/d://e", "c", "/d://e", None, "allow"),
        (10, "x://net?/es/", "net", "", None, "allow"),
        (10, "x://net?/es/", "net", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in rows], "page_id long, url string, host string")
    found = url_rules.judge_urls(pages, min_support=0.9).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, found)) == sorted((i, h, p, r, v) for i, _, h, p, r, v in rows)
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(120):
        tokens = sorted({f"t{k}" for k in rng.integers(0, 6, 4)})
        rows.append((tokens, "block" if "t1" in tokens and rng.random() < 0.9 else "allow"))
    want = []
    names = sorted({t for ts, _ in rows for t in ts})
    for size in range(1, 5):
        for combo in itertools.combinations(names, size):
            verdicts = [v for ts, v in rows if set(combo) <= set(ts)]
            for v in ("allow", "block"):
                if verdicts and verdicts.count(v) >= math.ceil(0.05 * len(rows)) and verdicts.count(v) / len(verdicts) >= 0.7:
                    want.append(url_rules.MinedRule(frozenset(combo), v, verdicts.count(v) / len(verdicts), verdicts.count(v) / len(rows)))
    want = [r for r in want if not any(s.tokens < r.tokens and s.verdict == r.verdict and s.confidence >= r.confidence for s in want)]
    found = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.7)
    key = lambda rules: sorted((sorted(r.tokens), r.verdict, round(r.confidence, 9), round(r.support, 9)) for r in rules)
    assert key(found) == key(want) and found
    index = url_rules.inverted_index(found)
    for tokens, _ in rows:
        best = next((n for n, r in enumerate(found) if r.tokens <= set(tokens)), None)
        assert url_rules.best_rule(frozenset(tokens), found, index) == best


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, []), (2005, [0.5, 0.5])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, v int").repartition(5)
    usable = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in [i for i in usable if i % 50 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:10]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    found = topk_search.exact_topk(table, table.where("vec_id % 50 = 0"), 10)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    few = table.where("vec_id < 4")
    assert topk_search.exact_topk(few, few, 10).count() == 12
    assert topk_search.exact_topk(few.limit(0), few.limit(0), 10).count() == 0
    assert topk_search.exact_topk(few.where("vec_id = 1"), few.where("vec_id = 1"), 10).count() == 0
