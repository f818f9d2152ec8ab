from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import toxicity
from quernstone.llm.queries import op5_toxicity
from quernstone.llm.textkit import words
from tests_llm_odd import ODD


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


def pair_counts(texts, vocab, reach=toxicity.REACH) -> Counter:
    out: Counter = Counter()
    places = {h: n for n, h in enumerate(vocab.tolist())}
    for t in texts:
        own = [places[h] for h in word_hashes(t or "").tolist() if h in places]
        for i, a in enumerate(own):
            for b in own[i + 1 : i + 1 + reach]:
                out[min(a, b), max(a, b)] += 1
    return out


def walked(counts: Counter, v: int, start: dict[int, float], damping=toxicity.DAMPING, steps=toxicity.STEPS) -> list[float]:
    """One walk over the graph of these counts, edge by edge."""
    of, total = [0.0] * v, 0.0
    for (a, b), n in counts.items():
        of[a] += n
        of[b] += n * (a != b)
    total = sum(of)
    edges: dict[int, dict[int, float]] = defaultdict(dict)
    for (a, b), n in counts.items():
        weight = math.log(n * total / of[a] / of[b])
        if a != b and weight > 0:
            edges[a][b] = edges[b][a] = weight
    now = [start.get(n, 0.0) for n in range(v)]
    for _ in range(steps):
        after = [(1 - damping) * start.get(n, 0.0) for n in range(v)]
        for a, out in edges.items():
            for b, w in out.items():
                after[b] += damping * now[a] * w / sum(out.values())
        now = after
    return now


def letters(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(40))) for _ in range(60)] + [None, ""]


def test_cooccurrences_same_as_brute_force(spark, monkeypatch):
    texts, vocab = letters(11), np.unique(word_hashes("a c d e g h"))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(r.a, r.b): r.times for r in toxicity.cooccurrences(docs, vocab, "text").collect()}
    assert got == dict(pair_counts(texts, vocab))


def test_long_texts_count_whole(spark):
    rng = random.Random(8)
    long = " ".join(rng.choice("abcdefghij") for _ in range(1_300_000))  # 2.6 MB, three pieces
    vocab = np.unique(word_hashes("a c d e g h"))
    docs = spark.createDataFrame([(long,), ("a b c",)], "text string").coalesce(1)
    got = {(r.a, r.b): r.times for r in toxicity.cooccurrences(docs, vocab, "text").collect()}
    assert got == dict(pair_counts([long, "a b c"], vocab))
    counts = {r.word: (r.df, r.beside) for r in toxicity.word_counts(docs, word_hashes("b"), "text").collect()}
    one = {h: counts[int(h.view(np.int64))] for h in word_hashes("a b c d")}
    assert [one[h] for h in word_hashes("a b c d")] == [(2, 2), (2, 1), (2, 2), (1, 1)]


def test_word_counts_and_vocabulary(spark):
    texts = letters(5) + ["x y", "p q"] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    anchors = word_hashes("a x")
    df, beside = Counter(), Counter()
    for t in texts:
        own = word_hashes(t or "").tolist()
        near = {h for i, h in enumerate(own) if any(k != i and own[k] in anchors.tolist() for k in range(max(0, i - toxicity.BESIDE), min(len(own), i + toxicity.BESIDE + 1)))}
        df.update(set(own))
        beside.update(near)
    counts = toxicity.word_counts(docs, anchors, "text")
    assert {r.word: (r.df, r.beside) for r in counts.collect()} == {int(np.uint64(h).view(np.int64)): (n, beside[h]) for h, n in df.items()}
    share = sum(beside.values()) / sum(df.values())
    wanted = {h for h in df if beside[h] >= toxicity.LEAST_BESIDE and toxicity.wilson(np.array([beside[h]]), np.array([df[h]]), 2.0)[0] > share}
    assert set(toxicity.vocabulary(counts, word_hashes("p absent"), common=0).tolist()) == wanted | set(word_hashes("p").tolist())
    top = sorted(wanted, key=lambda h: (-beside[h], int(np.uint64(h).view(np.int64))))[:2]
    assert set(toxicity.vocabulary(counts, word_hashes("p"), max_words=2, common=1).tolist()) == {*top, *word_hashes("p").tolist(), min(df, key=lambda h: (-df[h], int(np.uint64(h).view(np.int64))))}


def test_polarities_same_as_brute_force(spark):
    texts, vocab = letters(12), np.unique(word_hashes("a b c d e f g h i"))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = pair_counts(texts, vocab)
    seeds = [(word_hashes("a b"), word_hashes("h i")), (word_hashes("c"), word_hashes("zz")), (word_hashes("zz"), word_hashes("a"))]
    word, got = toxicity.polarities(toxicity.ppmi(toxicity.cooccurrences(docs, vocab, "text")), vocab, seeds, least=-1.0)
    assert set(word.tolist()) == set(vocab.tolist())
    for k, pair in enumerate(seeds):
        places = [[int(n) for n in np.flatnonzero(np.isin(vocab, own))] for own in pair]
        t, n = (walked(counts, len(vocab), {x: 1 / len(own) for x in own}) for own in places)
        for w, p in zip(word.tolist(), got[k].tolist()):
            x = int(np.searchsorted(vocab, np.uint64(w)))
            wanted = (t[x] - n[x]) / max(t[x] + n[x], 1e-12) if places[0] else 0.0
            if places[0]:
                wanted = (wanted + 1) / 2 if x in places[0] else (wanted - 1) / 2 if x in places[1] else wanted
            assert abs(p - wanted) < 1e-5, (k, w)


def _held(spark, table, sf):
    docs, labels = table("documents", sf), table("labels", sf)
    held = F.xxhash64("doc_id") % 3 == 0
    lexicon = toxicity.induce(docs, labels.filter(~held))
    got = toxicity.scores(docs, lexicon).join(labels.filter(held & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("wanted")), "doc_id").collect()
    return np.array([[r.toxic, r.wanted >= 0.5] for r in got])


def test_held_out_precision_and_recall(spark, table):
    got = _held(spark, table, "0.1")
    hits = (got[:, 0] & got[:, 1]).sum()
    assert hits >= 0.9 * got[:, 1].sum() and hits >= 0.9 * got[:, 0].sum()


def test_scores_same_as_brute_force(spark, table):
    docs, labels = table("documents"), table("labels")
    lexicon = toxicity.induce(docs, labels)
    polarity = dict(zip(lexicon.word.tolist(), lexicon.polarity.tolist()))
    rows = docs.select("doc_id", "text").collect()
    wanted = {r.doc_id: sum(polarity.get(h, 0) for h in set(word_hashes(r.text or "").tolist())) for r in rows}
    got = {r.doc_id: r.score for r in op5_toxicity(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {k for k, s in wanted.items() if s >= lexicon.threshold} and got
    assert all(abs(s - wanted[k]) < 1e-5 for k, s in got.items())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for docs, want in ((odd, len(ODD)), (none, 0)):
        got = toxicity.scores(docs, toxicity.induce(docs, labels))
        assert got.columns == ["doc_id", "score", "toxic"] and got.count() == want and got.filter("toxic").count() == 0
        assert toxicity.toxic_documents(docs, labels.limit(0)).count() == 0
    rows = [(n, f"plain words of text number{n} " + ("nasty vile " if n % 4 == 0 else "kind good ")) for n in range(80)] * 2
    docs = spark.createDataFrame([*rows, (None, "plain nasty vile"), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(60)], "doc_id long, toxic int")
    got = Counter(r.doc_id for r in toxicity.toxic_documents(docs, labels).collect())
    assert got == Counter({**{n: 2 for n in range(0, 80, 4)}, None: 1})


def test_rare_words_without_labels_get_polarity_beside_seeds(spark):
    rng = random.Random(4)
    common = [f"plain{n}" for n in range(30)]

    def around(*own):
        out = [rng.choice(common) for _ in range(12)]
        out[6:6] = own
        return " ".join(out)

    rows = [around("nasty", "vile") if n % 4 == 0 else around("kind", "good") for n in range(800)]
    for n in range(200, 206):  # without labels, in 0.75 % of the documents
        rows[4 * n % 800] = around("nasty", "scurvy", "vile")
    rows[797], rows[799] = "scurvy", "kind"
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n in range(24, 400)], "doc_id long, toxic int")
    lexicon = toxicity.induce(docs, labels)
    polarity = dict(zip(lexicon.word.tolist(), lexicon.polarity.tolist()))
    assert {*word_hashes("nasty vile").tolist()} <= {*polarity}
    got = {r.doc_id: r.score for r in toxicity.scores(docs, lexicon).collect()}
    assert got[797] > 0 and got[799] == 0


def test_words_that_are_not_held_count_as_those_that_are(spark):
    rng = random.Random(8)
    texts = [*letters(5), *[f"x k{n} m{n} b k{n}" for n in range(4)] * 8, "p q", None]
    texts.append(" ".join(rng.choice(["a", "b", "e", "k1", "k2", "m0", "m3", "p"]) for _ in range(1_300_000)))  # 2.9 MB, three pieces
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = toxicity.word_counts(docs, word_hashes("x"), "text").cache()
    terms = word_hashes("p b")
    whole = toxicity.vocabulary(counts, terms, common=0)
    assert toxicity.beyond(counts, whole) is None
    held = toxicity.vocabulary(counts, terms, max_words=1, common=0)
    rest = toxicity.beyond(counts, held, max_words=1)
    further = {r.place: np.uint64(r.word % (1 << 64)) for r in rest.collect()}
    assert len(held) < len(whole) - 2 and sorted(further) == [*range(len(held), len(whole))]
    assert sorted([*held.tolist(), *(int(h) for h in further.values())]) == whole.tolist()
    word = dict(enumerate(held)) | further
    graph = toxicity.cooccurrences(docs, held, "text", rest=rest)
    got = Counter({tuple(sorted(int(np.searchsorted(whole, word[x])) for x in (r.a, r.b))): r.times for r in graph.collect()})
    assert got == pair_counts(texts, whole)
    seeds = [(word_hashes("b"), word_hashes("p zz")), (word_hashes("k1 m1"), word_hashes("k2 m2 b"))]  # held ones, and others
    some = toxicity.polarities(toxicity.ppmi(graph), held, seeds, least=-1.0, rest=rest)
    all_held = toxicity.polarities(toxicity.ppmi(toxicity.cooccurrences(docs, whole, "text")), whole, seeds, least=-1.0)
    assert some[0].tolist() == all_held[0].tolist() and np.abs(some[1] - all_held[1]).max() < 1e-5


def test_lexicon_is_the_same_however_many_words_are_held(spark, table, monkeypatch):
    docs, labels = table("documents"), table("labels")
    want, beyond, rest = toxicity.induce(docs, labels), toxicity.beyond, []
    monkeypatch.setattr(toxicity, "beyond", lambda *a: rest.append(beyond(*a)) or rest[-1])
    got = toxicity.induce(docs, labels, max_words=1)
    assert rest[0].count() > 0
    assert got.word.tolist() == want.word.tolist() and len(got.word)
    assert np.abs(got.polarity - want.polarity).max() < 1e-5 and abs(got.threshold - want.threshold) < 1e-4


def test_counts_are_added_up_in_little_memory():
    rng = np.random.default_rng(3)
    for keys, sent in ((1_500_000, 1), (1 << 40, 2)):  # few different ones: one part; all different: several
        parts = [np.unique(rng.integers(0, keys, 400_000), return_counts=True) for _ in range(12)]
        counted, got = toxicity.Counted(), []
        tracemalloc.start()
        for own, n in parts:
            got += counted.add(own.copy(), n.copy(), 2 * n)
        got += counted.rest()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 250e6 and len(got) >= sent
        for part in got:
            assert (np.diff(part[0]) > 0).all() and (part[2] == 2 * part[1]).all()
        word, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        all_words, all_at = np.unique(np.concatenate([part[0] for part in got]), return_inverse=True)
        assert (all_words == word).all()
        assert (np.bincount(all_at, np.concatenate([part[1] for part in got])) == np.bincount(at, np.concatenate([n for _, n in parts]))).all()
    assert toxicity.Counted().rest() == []


def test_thin_batches_have_all_rows_and_bounded_text():
    texts = [*["a b " * n for n in range(40)], None, "", "c" * 1000, None, "d", "e" * 99, "f"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "n"])
    got = [*toxicity.thin(iter([batch, batch.slice(3, 7), batch.slice(0, 0)]), most=100)]
    assert [x for b in got for x in b.column(1).to_pylist()] == [*range(len(texts)), *range(3, 10)]
    assert [x for b in got for x in b.column(0).to_pylist()] == texts + texts[3:10]
    assert all(len(b) == 1 or sum(len(x or "") for x in b.column(0).to_pylist()) <= 100 for b in got) and len(got) < len(texts)
