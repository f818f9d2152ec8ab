from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.llm import quality
from quernstone.llm.queries import op9_quality_classifier
from tests_llm_odd import ODD, ODD_COLUMNS


def counts_of(text: str) -> np.ndarray:
    out = np.zeros(quality.TERMS, dtype=np.float32)
    b = text.encode()
    for k in range(len(b) - 2):
        out[((b[k] | b[k + 1] << 8 | b[k + 2] << 16) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    return out


def vote(model: quality.Neighbours, text: str | None) -> float:
    """By comparison with one vector after the other."""
    if len((text or "").encode()) < 3:
        return 0.0
    z = (np.log1p(counts_of(text)) * model.idf) @ model.space
    z = z / max(float(np.linalg.norm(z)), 1e-12)
    near = sorted(((round(float(z @ v) * (1 << 17)), float(y)) for v, y in zip(model.vectors, model.labels)), reverse=True)
    last = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
    voters = [(max(s, 0), y) for s, y in near if s >= last]
    return sum(s * y for s, y in voters) / max(sum(s for s, _ in voters), 1e-12)


def test_trigrams_dont_cross_texts_or_slices():
    texts = ["abcd", None, "", "ab", "xyz" * 400_000, "é汉字"]
    got = np.concatenate([c for _, _, c in quality.term_counts(pa.array(texts))])
    for t, row in zip(texts, got):
        assert (row == counts_of(t or "")).all()


def test_same_as_brute_force_on_documents(spark, table):
    docs, labels = table("documents"), table("labels")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in op9_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(got) == {r.doc_id for r in rows}
    off = [r.doc_id for r in rows if abs(got[r.doc_id].score - vote(model, r.text)) > 0.02]
    assert len(off) <= 0.01 * len(rows)  # where a neighbour is at a rounding step of the last place
    assert all(r.good == (r.score >= quality.THRESHOLD) for r in got.values())


def test_held_out_accuracy(table):
    docs, labels = table("documents", "0.1"), table("labels", "0.1").filter("quality is not null")
    held = F.xxhash64("doc_id") % 4 == 0
    got = quality.scores(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").select("good", "quality").collect()
    right = sum(r.good == (r.quality >= 0.5) for r in got) / len(got)
    most = max(sum(r.quality >= 0.5 for r in got), sum(r.quality < 0.5 for r in got)) / len(got)
    kept = sum(r.good for r in got if r.quality >= 0.5) / sum(r.quality >= 0.5 for r in got)
    assert right >= 0.95 and right > most and kept >= 0.97


def test_the_sample_is_bounded(table):
    model = quality.fit(table("documents"), table("labels"), max_labelled=50)
    assert 0 < len(model.labels) <= 50


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1.0), (1, 1.0), (8, 0.0), (7, None), (None, 1.0), (99, 0.0)], "doc_id long, quality double")
    got = quality.scores(odd, labels)
    assert got.columns == ["doc_id", "score", "good"] and got.count() == len(ODD)
    by = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert by[3].score == by[5].score == 0 and not by[3].good and by[1].good and by[2].good and by[8].score < 0.6
    kept = quality.good_documents(odd, labels)
    assert kept.columns == ODD_COLUMNS and {1, 2} <= {r.doc_id for r in kept.collect()}
    assert quality.scores(none, labels).count() == quality.good_documents(none, labels).count() == 0
    assert quality.good_documents(odd, labels.limit(0)).count() == len(ODD)
    assert quality.scores(odd, labels.limit(0)).filter("score is null and good").count() == len(ODD)
