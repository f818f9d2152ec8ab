from __future__ import annotations

import random

import pytest

from quernstone.llm import url_filter as uf
from quernstone.llm.queries import ORACLE_SQL, op6_url_filter


def brute(url, entries, default="allow"):
    p = uf.parts(url)
    if p is None:
        return None, None
    best = None
    for entry, decision in entries:
        labels, segments = uf.entry_parts(entry)
        if tuple(p[0][: len(labels)]) == labels and tuple(p[1][: len(segments)]) == segments:
            rank = (len(labels), len(segments), decision == "block")
            if best is None or rank > best[0]:
                best = (rank, decision, ".".join(reversed(labels)) + "".join(f"/{s}" for s in segments))
    return best[1:] if best else (default, None)


def made():
    rng = random.Random(12)
    hosts = ["a.example", "b.a.example", "x.b.a.example", "example", "other.org", "A.Example"]
    entries = [(rng.choice(hosts) + "".join(f"/{rng.choice('pq')}" for _ in range(rng.randrange(3))), rng.choice(("allow", "block"))) for _ in range(25)]
    urls = [f"{rng.choice(('http', 'https'))}://{rng.choice(('', 'me@'))}{rng.choice(('', 'www.'))}{rng.choice(hosts)}{rng.choice(('', '.', ':80'))}" + "".join(f"/{rng.choice(('p', 'q', ''))}" for _ in range(rng.randrange(4))) + rng.choice(("", "?x=/p", "#/q")) for _ in range(300)]
    return entries, [*urls, None, "", "no url", "http://", "http:///p", "mailto:a@b", "http://./p"]


@pytest.mark.parametrize("max_bytes", [uf.MAX_BYTES, 3])
def test_same_as_brute_force(spark, max_bytes):
    entries, urls = made()
    pages = spark.createDataFrame([(n // 2, u, "x", "x") for n, u in enumerate(urls)] + [(None, urls[0], "x", None)] * 2, "page_id long, url string, entry string, decision string")
    table = spark.createDataFrame([*entries, (None, "block"), ("example", None), ("example", "perhaps")], "entry string, decision string")
    wanted = [(n // 2, *brute(u, entries)) for n, u in enumerate(urls)] + [(None, *brute(urls[0], entries))] * 2
    got = [tuple(r) for r in uf.decisions(pages, table, max_bytes=max_bytes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def test_the_longest_match_decides():
    t = uf.Trie([("example.org", "block"), ("example.org/ok", "allow"), ("sub.example.org", "allow"), ("both.org", "allow"), ("both.org", "block")])
    decide = lambda u: (t.decide(*uf.parts(u)) or (None,))[0]
    assert decide("http://example.org/x") == "block" and decide("http://example.org/ok/y") == "allow" and decide("http://example.org/okay") == "block"
    assert decide("http://a.sub.example.org/x") == "allow" and decide("http://both.org") == "block" and decide("http://notexample.org") is None


def test_addresses_long_urls_and_odd_names(spark):
    entries = spark.createDataFrame([("[2001:db8::1]", "block"), ("a.b", "block"), ("a.b/" + "x/" * 999 + "x", "allow")], "entry string, decision string")
    urls = ["http://[2001:db8::1]:8080/p", "http://[2001:db8::2]/", "http://a.b/" + "x/" * 50_000, "http://a.b/" + "y" * 1_000_000]
    pages = spark.createDataFrame([(n, "no", u) for n, u in enumerate(urls)], "`a.b` long, URL string, url string")
    for most in (uf.MAX_BYTES, 3):
        assert [r.decision for r in uf.decisions(pages, entries, "a.b", max_bytes=most).orderBy("`a.b`").collect()] == ["block", "allow", "allow", "block"]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    entries = spark.createDataFrame([("a.b", "block")], "entry string, decision string")
    assert uf.decisions(pages.limit(0), entries).count() == 0
    assert [tuple(r) for r in uf.decisions(pages, entries.limit(0)).collect()] == [(1, "allow", None)]


def test_same_as_sql(spark, table, same_as_sql):
    table("pages")
    same_as_sql(op6_url_filter(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op6_url_filter"])
