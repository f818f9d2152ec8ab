"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed runs of three bytes. A bounded sample of labelled documents
(MAX_LABELLED) gives inverse document frequencies and, by a randomised singular value
decomposition in numpy, the latent-semantic space; their vectors are broadcast. Of every
document the cosines with all labelled vectors are computed exactly, in blocks, and the
NEIGHBOURS nearest vote with their similarity as weight.

Defined results:
- The score is the weighted mean label of the neighbours, from 0 (poor) to 1 (good). All that
  are as near as the last neighbour vote, so that ties don't depend on the order.
- A text of fewer than three bytes, or null, or with no similarity to any neighbour scores 0.
- Labels that are null or of unknown documents are ignored; several of one id are averaged.
- Without labelled documents scores are null and `good_documents` keeps every row.
- A text of any length counts whole: its runs of bytes are those of the whole text.
- Ids may repeat, as rows may; every row is scored, and in the sample one text of an id. An empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import by_place, cut, need, one_text, pick, sample_by_hash
from quernstone.llm.textkit import slices, utf8

#: Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 3000
TERMS = 4096
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.5
BLOCK = 512


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts) of the hashed byte trigrams, BLOCK rows at a time at most."""
    raw, offsets = utf8(column)
    for first in range(0, len(offsets) - 1, BLOCK):
        own = offsets[first : first + BLOCK + 1]
        out = np.zeros((len(own) - 1, TERMS), dtype=np.float32)
        last, tail = -1, raw[:0]
        for part, bounds, rows in slices(raw[own[0] : own[-1]], own - own[0]):
            if len(rows) == 1 and rows[0] == last:  # goes on in the same text: the runs across the cut count too
                part, bounds = np.concatenate([tail, part]), bounds + np.array([0, len(tail)])
            last, tail = int(rows[-1]), part[max(int(bounds[-2]), len(part) - 2) :]
            if len(part) < 3:
                continue
            b = part.astype(np.uint32)
            code = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(20)
            piece = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(bounds))
            inside = piece[:-2] == piece[2:]
            counts = np.bincount((piece[:-2].astype(np.int64) * TERMS + code)[inside], minlength=len(rows) * TERMS).reshape(len(rows), TERMS)
            out[rows[0] : rows[-1] + 1] += counts
        yield first, first + len(own) - 1, out


@dataclass
class Neighbours:
    """The space, and the labelled vectors in it."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        z = (np.log1p(counts) * self.idf) @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, z: np.ndarray) -> np.ndarray:
        # in steps of 2**-17, so that equal vectors are equally near whatever the order of the sums
        near = np.rint(z @ (self.vectors.T * np.float32(1 << 17)))
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= last, np.maximum(near, 0), 0)
        return (weight @ self.labels) / np.maximum(weight.sum(axis=1), 1e-12)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Neighbours:
        x = np.log1p(counts.astype(np.float32))
        idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rank = min(rank, *x.shape)
        # subspace iteration from a fixed start
        q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(x.T @ (x @ q))
        _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
        model = cls(idf, np.ascontiguousarray((q @ vt.T)[:, :rank]), np.zeros((0, rank), np.float32), labels.astype(np.float32))
        model.vectors = model.embed(counts)
        return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Neighbours | None:
    """The model of a sample of at most max_labelled labelled ids; None if no labelled document is found."""
    need(docs, key, text)
    need(labels, label_key, label)
    known = pick(labels, id=label_key, label=label).filter("label is not null and id is not null").groupBy("id").agg(F.avg("label").alias("label"))
    # a bounded number of rows: safe to broadcast
    chosen = F.broadcast(cut(sample_by_hash(cut(known), "id", max_labelled)))
    rows = one_text(pick(docs, id=key, text=text).join(chosen, "id"), "text", "id", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in term_counts(batch.column(2)):
                found = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(found, pa.list_(pa.int32())), pa.array([c[f] for c, f in zip(counts, found)], pa.list_(pa.float32()))], names=["id", "label", "terms", "counts"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("label", T.DoubleType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))])
    got = rows.mapInArrow(run, schema).toArrow()
    got = got.filter(pc.greater(pc.list_value_length(got["terms"]), 0))
    if not len(got):
        return None
    # the order must not depend on the tasks
    x = np.zeros((len(got), TERMS), dtype=np.float32)
    for n, (t, c) in enumerate(zip(got["terms"], got["counts"])):
        x[n, t.values.to_numpy()] = c.values.to_numpy()
    order = np.lexsort((x.sum(axis=1), got["id"].to_numpy()))
    return Neighbours.fit(x[order], got["label"].to_numpy()[order])


def _scorer(docs: DataFrame, model: Neighbours):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for i, j, counts in term_counts(column):
            out[i:j] = np.where(counts.any(axis=1), shared.value.vote(shared.value.embed(counts)), 0)
        return pa.array(np.round(out, 6))

    return score


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """(key, score, good) of every row of docs."""
    model = fit(docs, labels, key, text, **fitting)
    rows = pick(docs, key=key, text=text)
    score = F.lit(None).cast("double") if model is None else _scorer(docs, model)(F.col("text"))
    return rows.select("key", score.alias("score")).withColumn("good", F.coalesce(F.col("score") >= threshold, F.lit(True))).toDF(key, "score", "good")


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """docs without the rows that score below the threshold; all columns of docs."""
    model = fit(docs, labels, key, text, **fitting)
    if model is None:
        return docs
    rows, at = by_place(docs)
    return rows.filter(_scorer(docs, model)(F.col(at[text])) >= threshold).toDF(*docs.columns)
