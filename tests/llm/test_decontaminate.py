from __future__ import annotations

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from quernstone.llm import decontaminate as dc
from quernstone.llm.queries import ORACLE_SQL, op3_benchmark_decontamination
from tests_llm_odd import LONG, ODD_COLUMNS, SAME


def brute(docs, items, window=dc.WINDOW):
    out = []
    for key, text in docs:
        flat = f" {dc.normalise(text)} "
        for item, own in items:
            w = dc.normalise(own).split(" ")
            strings = {" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))} if w != [""] else set()
            n = sum(f" {s} " in flat for s in strings)
            if n:
                out.append((key, item, n))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("patterns", [[b"ab"], [b" a b ", b" a b c d e ", b"xyzxyz"], [b"aaaa", b"aaaaaaaaaaaaab", b"baaa"]])
def test_search_finds_every_occurrence(patterns):
    rng = random.Random(6)
    engine = dc.WuManber(patterns)
    for size in (0, 1, 3, 50, 3000):
        text = bytes(rng.choice(b"ab cdexyz") for _ in range(size)) + rng.choice(patterns) * 2
        wanted = sorted((k, n) for n, p in enumerate(patterns) for k in range(len(text)) if text.startswith(p, k))
        assert sorted(engine.search(np.frombuffer(text, np.uint8))) == wanted


def made():
    rng = random.Random(7)
    words = "the of Über naïve 汉字 don't 42 and, «quote» x".split()
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.choice((1, 3, 8, 9, 30))))) for n in range(25)] + [(3, None), (40, ""), (41, "...")]
    docs = []
    for n in range(200):
        own = [rng.choice(words) for _ in range(rng.randrange(60))]
        if n % 3 == 0:
            part = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(part) + 1)
            own[len(own) // 2 : len(own) // 2] = part[a : a + 12]
        docs.append((n, "\n".join(own)))
    return docs, items


@pytest.mark.parametrize("table_bytes", [dc.TABLE_BYTES, 2000])
def test_same_as_brute_force(spark, table_bytes):
    docs, items = made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = brute(docs, items)
    assert got(dc.occurrences(d, b, table_bytes=table_bytes)) == wanted and wanted
    bad = {k for k, _, _ in wanted}
    assert sorted(r.doc_id for r in dc.clean_documents(d, b, table_bytes=table_bytes).collect()) == sorted(k for k, _ in docs if k not in bad)


def test_a_string_across_slices_of_a_very_long_text(spark):
    text = "filler " * 1_400_000 + "these eight words are found in one place " + "filler " * 10
    docs = spark.createDataFrame([(1, text), (2, "filler " * 50)], "doc_id long, text string")
    items = spark.createDataFrame([(9, "These EIGHT words, are found: in one place")], "item_id long, text string")
    assert got(dc.occurrences(docs, items)) == [(1, 9, 1)]


def test_a_short_string_does_not_slow_the_others():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    text = np.frombuffer(" ".join(rng.choice(words) for _ in range(300_000)).encode(), np.uint8)
    long = [f" {' '.join(rng.choice(words) for _ in range(8))} ".encode() for _ in range(3000)]

    def seconds(engine):
        began = time.perf_counter()
        return list(engine.search(text)), time.perf_counter() - began

    alone, with_short = seconds(dc.WuManber(long)), seconds(dc.WuManber([*long, b" zz "]))
    assert with_short[0] == alone[0] and with_short[1] < 10 * alone[1] + 2


def test_names_that_differ_in_case_or_have_dots(spark):
    docs = spark.createDataFrame([(1, "x", "one two three"), (2, "one two three", "x")], "`a.b` long, TEXT string, text string")
    items = spark.createDataFrame([(5, "one two three", "no")], "`i.d` long, text string, TEXT string")
    assert got(dc.occurrences(docs, items, "a.b", item_key="i.d")) == [(1, 5, 1)]
    kept = dc.clean_documents(docs, items, item_key="i.d")
    assert kept.columns == docs.columns and [r[0] for r in kept.collect()] == [2]


def test_texts_dont_run_into_each_other(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two three"), (4, "zone two threes")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, "one two three")], "item_id long, text string")
    assert got(dc.occurrences(docs, items)) == [(3, 5, 1)]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, SAME), (1, SAME), (2, None), (3, ""), (4, "É")], "item_id long, text string")
    n = len(SAME.replace(",", "").split()) - dc.WINDOW + 1
    assert got(dc.occurrences(odd, items)) == sorted([(k, 1, n) for k in (1, 2, 2, None) for _ in (0, 1)] + [(9, 4, 1)], key=repr)
    kept = dc.clean_documents(odd, items)
    assert kept.columns == ODD_COLUMNS
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 4, 5, 6, 7, 8, None], key=repr)
    assert dc.occurrences(none, items).count() == dc.clean_documents(none, items).count() == 0
    assert dc.occurrences(odd, items.limit(0)).count() == 0 and dc.clean_documents(odd, items.limit(0)).count() == odd.count()
    assert LONG.count(" ") > 50_000


def test_same_as_sql(spark, table, same_as_sql):
    table("documents")
    same_as_sql(op3_benchmark_decontamination(spark, "/root/testdata/sf0.01"), ORACLE_SQL["op3_benchmark_decontamination"])


def test_groups_by_item_are_all_items_of_a_string():
    strings = dc.test_strings([(1, "a b"), (2, "a b"), (3, "c")])
    owners = defaultdict(list, strings)
    assert owners[b" a b "] == [0, 1] and owners[b" c "] == [2]
