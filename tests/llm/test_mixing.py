from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quernstone.llm import mixing
from quernstone.llm.queries import op7_mixing
from tests_llm_odd import ODD_COLUMNS


def check(rows, weights=None, total=None, got=None):
    """What any result must hold. rows: (key, source); got: (key, source, rows, copies)."""
    units, sizes = Counter(rows), Counter(s for _, s in rows)
    w = {s: n**mixing.ALPHA for s, n in sizes.items()} if weights is None else {s: weights.get(s, 0) for s in sizes}
    w = {s: x for s, x in w.items() if x > 0}
    scale = max(sizes[s] / x for s, x in w.items()) if total is None else total / sum(w.values())
    assert {(k, s): n for k, s, n, _ in got} == {u: n for u, n in units.items() if u[1] in w} and len(got) == sum(u[1] in w for u in units)
    of = defaultdict(int)
    for _, s, n, c in got:
        mass = n * scale * w[s] / sizes[s]
        assert math.floor(mass + 1e-6) <= c <= math.ceil(mass - 1e-6)
        of[s] += c
    for s, x in w.items():
        assert abs(of[s] - scale * x) < 1 + 1e-6


def copies(docs, **options):
    return [tuple(r) for r in mixing.copies(docs, **options).collect()]


def test_pivotal_keeps_the_mass():
    out, left = mixing.pivotal([0.3, 0.9, 0.5, 0.0, 1.0, 0.4], [0.1, 0.7, 0.2, 0.5, 0.5, 0.9], None)
    rest = left[1] if left else 0
    assert sum(x for k, x in enumerate(out) if not left or k != left[0]) + rest == pytest.approx(3.1)
    assert all(x in (0.0, 1.0) for k, x in enumerate(out) if not left or k != left[0])


def test_each_source_gets_its_target(spark):
    rows = [(n, f"s{int(math.sqrt(n)) % 7}") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    check(rows, got=copies(docs.repartition(40)))
    weights = {"s0": 5, "s1": 1, "s2": 0, "s9": 4}
    check(rows, weights, 777.5, copies(docs.repartition(40), weights=weights, total=777.5))
    assert sorted(copies(docs.coalesce(1))) == sorted(copies(docs.coalesce(1)))


def test_the_probabilities_are_right(spark):
    rows = [(n, "a") for n in range(60)] + [(n, "b") for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(5)
    seen: Counter = Counter()
    runs = 60
    for seed in range(runs):
        for k, s, _, c in copies(docs, weights={"a": 3, "b": 1}, total=40, seed=seed):
            seen[k, s] += c
    # 0.5 each: 60 runs deviate by 3.9
    assert all(abs(seen[u] - runs / 2) < 5 * 3.9 for u in rows) and abs(sum(seen[u] for u in rows if u[1] == "a") - 30 * runs) <= runs


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.source) for r in odd.collect()]
    check(rows, got=copies(odd))
    out = mixing.mix(odd, total=30).select("*")
    assert out.columns == [c for c in ODD_COLUMNS if c != "copies"] + ["copies"]
    per = Counter()
    for r in out.collect():
        per[r.doc_id, r.source] += r.copies
    assert {u: c for u, c in per.items()} == {(k, s): c for k, s, _, c in copies(odd, total=30) if c}
    assert mixing.mix(none).count() == mixing.copies(none).count() == 0
    assert mixing.copies(odd, weights={}).count() == mixing.mix(odd, weights={"s": 0}).count() == 0
    check(rows, {None: 1, "s": 1}, 9, copies(odd, weights={None: 1, "s": 1}, total=9))


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a", "t")] * 3 + [(2, "a", "t")], "doc_id long, source string, text string")
    out = mixing.mix(docs, total=10).collect()
    assert sum(r.copies for r in out) == 10
    own = [r.copies for r in out if r.doc_id == 1]
    assert sum(own) in (7, 8) and max(own) - min(own) <= 1


def plain(rows, weights, total, seed):
    """The same by one list after the other: of each source in one partition, in order of hashes, whoever goes on."""
    sizes = Counter(s for _, s, *_ in rows)
    scale, out = total / sum(weights[s] for s in sizes), {}
    for source in sizes:
        own = sorted((h, k, u) for k, s, h, u in rows if s == source)
        rate = scale * weights[source] / sizes[source]
        base, p = math.floor(rate + mixing.TINY), rate - math.floor(rate + mixing.TINY)
        go = None
        for _, k, u in own:
            out[k, source] = base
            if not mixing.TINY < p < 1 - mixing.TINY:
                continue
            if go is None:
                go = (k, p)
                continue
            j, q = go
            if p + q < 1 - mixing.TINY:
                go = (k if u * (p + q) < p else j, p + q)
            elif p + q > 1 + mixing.TINY:
                win, go = (j, (k, p + q - 1)) if u * (2 - p - q) < 1 - p else (k, (j, p + q - 1))
                out[win, source] = out.get((win, source), base) + 1
            else:
                win, go = (k if u < p else j), None
                out[win, source] = out.get((win, source), base) + 1
        if go is not None:
            yield source, go
    yield None, out


def test_same_as_brute_force_in_one_partition(spark):
    rows = [(n, f"s{n % 3}") for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").coalesce(1)
    weights, total, seed = {"s0": 2.0, "s1": 1.0, "s2": 0.4}, 170.0, 5
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("u"), "doc_id", "source"), 11).cast("double") + 0.5) / float(1 << 53)
    last = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("last"), "source"), 11).cast("double") + 0.5) / float(1 << 53)
    given = docs.select("doc_id", "source", F.xxhash64(F.lit(7919), "doc_id"), u, last).collect()
    *left, (_, wanted) = plain([tuple(r)[:4] for r in given], weights, total, seed)
    of = {r.source: r[4] for r in given}
    for source, (k, q) in left:
        wanted[k, source] += of[source] < q
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {(k, s): c for k, s, _, c in copies(docs, weights=weights, total=total, seed=seed)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == wanted


def test_names_and_repeated_rows_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "a", f"t{n}", n, "old") for n in range(5)] + [(2, "a", "t", 0, "old")], "`a.b` long, source string, SOURCE string, COPIES long, copies string")
    outs = [sorted(map(tuple, mixing.mix(d, total=9, key="a.b").collect())) for d in (docs, docs.repartition(3))]
    assert outs[0] == outs[1] and sum(r[-1] for r in outs[0]) == 9
    assert mixing.mix(docs, key="a.b").columns == ["a.b", "source", "SOURCE", "COPIES", "copies"]


def test_documents(spark, table):
    rows = [(r.doc_id, r.source) for r in table("documents").select("doc_id", "source").collect()]
    check(rows, got=[tuple(r) for r in op7_mixing(spark, "/root/testdata/sf0.01").collect()])
