from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import simhash
from quernstone.llm.graph import components
from quernstone.llm.queries import op2_simhash_near_duplicates
from quernstone.llm.textkit import words
from tests_llm_odd import ODD_COLUMNS


def roots(n: int, edges) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def distances(prints: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1).astype(np.int32)
    return bits @ (1 - bits).T + (1 - bits) @ bits.T


def brute(rows, distance=simhash.DISTANCE):
    """(id, id that stays) of the rows that go: all pairs are compared."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints, has = simhash.fingerprint_batch(pa.array([t for _, t in rows], pa.string()))
    d = distances(prints)
    root = roots(len(rows), [(int(a), int(b)) for a, b in zip(*np.where(d <= distance)) if a < b and has[a] and has[b]])
    return sorted(((rows[k][0], rows[r][0]) for k, r in enumerate(root) if r != k), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n: int, seed: int = 5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))] for _ in range(n)]
    for _ in range(n):
        own = list(rng.choice(texts))
        for _ in range(rng.choice((0, 1, 2, 5, 20))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(own)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_fingerprint_is_the_sign_of_sums():
    text = "One two two three ÉÈ four"
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    h = np.unique(words(raw, np.array([0, len(raw)]))[0])
    assert len(h) == 5
    bits = np.concatenate([np.unpackbits(simhash.splitmix(h + np.uint64(7919 * (w + 1))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for w in range(3)], axis=1)
    wanted = np.packbits(2 * bits.sum(axis=0) > len(h), bitorder="little")
    got_, has = simhash.fingerprint_batch(pa.array([None, text, "", text.upper()]))
    assert has.tolist() == [False, True, False, True]
    assert (got_[1].view(np.uint8) == wanted).all() and (got_[1] == got_[3]).all()


def test_recall_against_all_pairs(spark):
    rows = made(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, wanted = set(got(simhash.near_duplicates(docs))), set(brute(rows))
    assert len(wanted) > 150
    assert len(found & wanted) >= 0.98 * len(wanted) and len(found - wanted) <= 0.02 * len(wanted)


def pairs_of(rows, spark, shape, family="0L"):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = simhash.numbered(simhash.fingerprints(docs, width=shape.words)).withColumn("family", F.expr(family))
    prints = np.array([[r.f0, r.f1, r.f2] for r in nodes.orderBy("node").collect()], dtype=np.int64)
    labels = [r.family for r in nodes.orderBy("node").collect()]
    return distances(prints), labels, [(r.a, r.b, r.distance) for r in simhash.near_pairs(nodes, shape).collect()]


@pytest.mark.parametrize("shape", [simhash.layout(240), simhash.Layout(8, 24), simhash.layout(10**9)])
def test_verified_pairs_are_within_the_distance(spark, shape):
    d, _, found = pairs_of(made(120, 8), spark, shape)
    pairs = {(a, b): x for a, b, x in found}
    assert len(pairs) == len(found) and all(a < b and d[a, b] == x <= simhash.DISTANCE for (a, b), x in pairs.items())
    wanted = {(int(a), int(b)) for a, b in zip(*np.where(d <= simhash.DISTANCE)) if a < b}
    assert len(pairs) >= 0.98 * len(wanted)
    if shape.segments * shape.width <= simhash.BITS:
        # by the pigeonhole principle all of these meet
        assert {(a, b) for a, b in wanted if d[a, b] < 3 * shape.segments} <= set(pairs)


def test_pairs_within_a_family_are_left_out_and_no_other(spark):
    shape = simhash.Layout(8, 16)
    d, labels, found = pairs_of(made(100, 3), spark, shape, "node % 3")
    pairs = {(a, b) for a, b, _ in found}
    wanted = {(int(a), int(b)) for a, b in zip(*np.where(d <= simhash.DISTANCE)) if a < b and (labels[a] == 0 or labels[a] != labels[b])}
    assert len(pairs) == len(found) and pairs <= wanted and {(a, b) for a, b in wanted if d[a, b] < 24} <= pairs


def test_layout():
    # by all ways to lay 5 differing bits into 3 segments of 4 and 3 bits behind them
    bits = range(15)
    none = sum(all(sum(x // 4 == k for x in c) > 2 for k in range(3)) for c in itertools.combinations(bits, 9))
    simhash.missed.cache_clear()
    old, simhash.BITS = simhash.BITS, 15
    try:
        assert simhash.missed(3, 4, 9) == none / len(list(itertools.combinations(bits, 9)))
    finally:
        simhash.BITS = old
        simhash.missed.cache_clear()
    for n in (1, 1000, 10**6, 10**9):
        shape = simhash.layout(n)
        assert simhash.missed(shape.segments, shape.width) <= simhash.MISSED and shape.words * 64 >= shape.segments * shape.width
    # what a fingerprint costs grows far slower than their number
    cost = [200 * s.entries() + s.comparisons(n) for n in (10**6, 10**9) for s in [simhash.layout(n)]]
    assert cost[1] < 8 * cost[0]


def test_same_words_are_the_same_fingerprint_at_any_length():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    texts = [base, base * 3, base * 25_000, "kappa " * 400_000 + base, "x" * 3_000_000 + " y", "y " + "x" * 3_000_000]
    prints, has = simhash.fingerprint_batch(pa.array(texts), 4)
    assert has.all() and (prints[:4] == prints[0]).all() and (prints[4] == prints[5]).all() and (prints[4] != prints[0]).any()


def test_a_family_of_a_thousand_copies(spark):
    base = made(40, 9)[0][1].split()
    rng = random.Random(2)
    rows = []
    for k in range(1000):
        own = list(base)
        own[rng.randrange(len(own))] = f"w{rng.randrange(5)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_same_as_brute_force_on_documents(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    found, wanted = set(got(op2_simhash_near_duplicates(spark, "/root/testdata/sf0.01"))), set(brute(rows))
    assert len(found & wanted) >= 0.98 * len(wanted) and len(found - wanted) <= 0.02 * max(1, len(wanted))


def test_odd_rows(odd, none):
    # texts without words are in no group; LONG and the letter have none like them
    assert got(simhash.near_duplicates(odd)) == [(2, 1), (2, 1), (None, 1)]
    kept = simhash.near_distinct(odd)
    assert kept.columns == ODD_COLUMNS
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None], key=repr)
    clash = odd.withColumns({"k2": F.col("doc_id")}).toDF(*ODD_COLUMNS, "TEXT")
    assert simhash.near_distinct(clash).columns == [*ODD_COLUMNS, "TEXT"] and simhash.near_distinct(clash).count() == 9
    dotted = odd.drop("a.b").withColumnRenamed("doc_id", "a.b")
    assert got(simhash.near_duplicates(dotted, "a.b")) == [(2, 1), (2, 1), (None, 1)]
    assert simhash.near_duplicates(none).count() == simhash.near_distinct(none).count() == 0


def test_a_repeated_row_that_stays_does_so_once(spark):
    docs = spark.createDataFrame([(1, "a few words of text", "x")] * 3 + [(2, "a few words of text", "y"), (None, "quite different things are here", "z")], "doc_id long, text string, keep_id string")
    assert got(simhash.near_duplicates(docs)) == [(1, 1), (1, 1), (2, 1)]
    assert got(simhash.near_distinct(docs).select("doc_id", "keep_id")) == [(1, "x"), (None, "z")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(n, n + 1) for n in range(400, 460)] + [(7, 7)]
    root = roots(461, edges)
    wanted = {k: r for k, r in enumerate(root) if any(k in e for e in edges if e[0] != e[1])}
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
