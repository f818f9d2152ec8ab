from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as cp
from quernstone.llm import decontaminate, quality
from test_decontaminate import brute as contaminated
from test_exact_dedup import brute as exact
from test_mixing import check
from test_quality import vote
from test_simhash import brute as near

SF = "/root/testdata/sf0.01"


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]


def test_same_as_brute_force(spark, table):
    docs, labels, bench = table("documents"), table("labels"), table("benchmark")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, labels)
    scored = {k: vote(model, r.text) for k, r in rows.items()}
    kept = [(k, rows[k].text) for k, s in scored.items() if s >= quality.THRESHOLD]
    gone = {k for k, _ in exact(kept)}
    kept = [r for r in kept if r[0] not in gone]
    gone = {k for k, _ in near(kept)}
    kept = [r for r in kept if r[0] not in gone]
    gone = {k for k, _, _ in contaminated(kept, [(r.item_id, r.text) for r in bench.collect()])}
    kept = {k for k, _ in kept if k not in gone}
    out = cp.run(spark, SF)
    assert out.columns == [*docs.columns, "copies"]
    got = out.collect()
    have = {r.doc_id for r in got}
    assert len(got) == len(have)
    # near-dedup is approximate, and votes may differ at a rounding step
    assert len(have ^ kept) <= 0.02 * len(kept)
    assert all(tuple(r)[:-1] == tuple(rows[r.doc_id]) and r.copies >= 1 for r in got)
    # whole numbers: at ALPHA every document has at least one copy
    check([(r.doc_id, r.source) for r in got], got=[(r.doc_id, r.source, 1, r.copies) for r in got])


def test_what_each_stage_does_to_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1), (8, 0), (7, 0), (9, 0), (None, 1), (99, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "several rows have, word for word, and nothing besides"), (2, None), (3, "...")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in docs.collect()]
    same = [r for r in rows if r[1] and r[1].startswith("one text")]
    assert len(same) == 4
    stages = dict(cp.STAGES)

    def kept(name):
        return sorted(map(repr, stages[name](spark, docs, str(tmp_path)).select(*docs.columns).collect()))

    def wanted(which):
        return sorted(repr(r) for r in docs.collect() if which(tuple(r)))

    good = {repr(r) for r in stages["quality classifier"](spark, docs, str(tmp_path)).collect()}
    assert all((repr(r) in good) == (r[1] is not None and r[1].startswith("one text")) for r in docs.collect() if r[1] is None or len(r[1]) < 3 or r[1].startswith("one text"))
    assert [r[0] for r in sorted(stages["exact dedup"](spark, docs, str(tmp_path)).collect(), key=lambda r: r.doc_id)] == [1, 3, 5, 7, 8, 9]
    assert kept("SimHash near-dedup") == wanted(lambda r: r not in same or r[0] == 1)
    assert kept("benchmark decontamination") == wanted(lambda r: r not in same)
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    assert sorted(map(repr, mixed.select(*docs.columns).collect())) == wanted(lambda r: True) and mixed.filter("copies < 1").count() == 0


@pytest.mark.parametrize("nth", range(len(cp.STAGES)))
def test_odd_documents_go_through_every_stage(spark, odd, none, tmp_path, nth, table):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name in ("labels", "benchmark"):
        table(name, "0.001").limit(0 if name == "labels" else 40).write.parquet(f"{tmp_path}/{name}.parquet")
    _, stage = cp.STAGES[nth]
    for frame in (docs, none.select(*docs.columns)):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns[:5] == docs.columns
        assert sum(Counter(map(repr, out.select(*docs.columns).collect())).values()) <= frame.count()


def test_an_empty_corpus(spark, odd, tmp_path, table):
    odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(name, "0.001").write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert decontaminate.WINDOW == 8
