from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import language_id as li
from quernstone.llm.queries import op8_language_id
from tests_llm_odd import ODD

RNG = np.random.default_rng(3)


def network(n: int = 3) -> li.Network:
    def some(*shape):
        return RNG.standard_normal(shape).astype(np.float32)

    k = li.FILTERS * len(li.WIDTHS)
    return li.Network([f"l{i}" for i in range(n)], some(256, li.EMBED), [some(w, li.EMBED, li.FILTERS) for w in li.WIDTHS], some(k), some(k, n), some(n))


def test_tables_give_what_the_network_gives():
    net = network()
    x = RNG.integers(0, 256, (300, li.WINDOW)).astype(np.uint8)
    assert np.allclose(li.Tables(net).log_probabilities(x), net.log_probabilities(x), atol=1e-3)


def test_a_training_step_lowers_the_loss():
    x = RNG.integers(97, 105, (64, li.WINDOW)).astype(np.uint8)
    y = (np.arange(64) % 2).astype(int)
    x[y == 1, 100:103] = [65, 66, 67]
    net = li.Network.train(x, y, ["a", "b"], epochs=40)
    assert (net.log_probabilities(x).argmax(axis=1) == y).mean() > 0.95


def test_windows_are_the_whole_text():
    texts = [b"", b"a" * 5, b"b" * li.WINDOW, b"c" * (3 * li.WINDOW + 1)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    x, owner, length = li.windows_of(raw, np.cumsum([0, *map(len, texts)]))
    for n, t in enumerate(texts):
        assert b"".join(r[:k].tobytes() for r, k in zip(x[owner == n], length[owner == n])) == t


def test_batches_dont_matter():
    tables = li.Tables(network())
    texts = ["one text", None, "", "second " * 300, "x" * 5_000_000, "é汉字"]
    best, p, has = li.identify_batch(tables, pa.array(texts))
    for n, t in enumerate(texts):
        b, q, h = li.identify_batch(tables, pa.array([t], pa.string()))
        assert h[0] == has[n] == bool(t) and (not t or (b[0] == best[n] and abs(q[0] - p[n]) <= 2e-4))


def test_held_out_accuracy(table):
    docs = table("documents", "0.1").filter("lang is not null")
    held = F.xxhash64(F.lit(1), "doc_id") % 3 == 0
    net = li.fit(docs.filter(~held))
    got = li.identify(docs.filter(held), net).join(docs, "doc_id").filter("n_chars >= 50").select("language", "lang").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got)


def test_query_against_the_plain_network(spark, table):
    """Each document by itself: its windows one after the other through the network as it was trained, without tables or batches."""
    docs = table("documents")
    net = li.fit(docs)
    got = op8_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "language", "probability"]
    got, rows = {r.doc_id: r for r in got.collect()}, docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        if not raw:
            assert got[r.doc_id].language is None and got[r.doc_id].probability == 0
            continue
        total = np.zeros(len(net.languages))
        for i in range(0, len(raw), li.WINDOW):
            own = raw[i : i + li.WINDOW]
            total += len(own) * net.log_probabilities(np.frombuffer(own.ljust(li.WINDOW, b"\0"), np.uint8)[None])[0]
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        p /= p.sum()
        assert p[net.languages.index(got[r.doc_id].language)] >= p.max() - 1e-3 and abs(p.max() - got[r.doc_id].probability) <= 2e-3


def test_rare_languages_are_in_the_sample_and_ties_go_to_the_first(spark):
    rows = [(n, f"the one and the other {n}", "en") for n in range(3000)] + [(n, f"aqui y alla {n}", "es") for n in range(3000, 3003)] + [(1, "", "xx"), (2, None, "yy")]
    net = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert net.languages == ["en", "es"]
    flat = li.Network(["a", "b"], net.embed, net.filters, net.bias, np.zeros_like(net.out), np.zeros(2, np.float32))
    docs = spark.createDataFrame([(1, "whatever", "x")], "`a.b` long, text string, TEXT string")
    assert [tuple(r) for r in li.identify(docs, flat, "a.b").collect()] == [(1, "a", 0.5)]


def test_odd_rows(spark, odd, none):
    got = li.identify(odd, li.fit(odd)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[3].language is None and by[5].language is None and by[5].probability == 0 and by[8].language in ("en", "de", "fr", "es")
    assert li.identify(none, li.fit(none)).count() == 0
    assert li.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert li.identify(odd, None).filter("language is null and probability = 0").count() == len(ODD)
