"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of widths 2, 3 and 4 go over fixed-length windows of the text,
each filter's maximum over the window goes to a softmax. It is trained in numpy (back-
propagation, Adam) on windows of a bounded sample of labelled texts (PER_LANGUAGE of each language). To apply
it, what a filter makes of two neighbouring bytes is tabulated once, so that a filter's
output is a sum of one or two rows of tables. All windows of a text count, by their length.

Defined results:
- `language` is the one with the largest mean log probability over the text's windows, the first by
  name of equal ones; `probability` is that mean as softmax, rounded to 4 digits.
- A null or empty text has a null language and probability 0.
- Labels that are null are ignored; without any label every language is null. However rare a language is, its rows are in the sample.
- Ids may repeat, as rows may; every row counts, and equal ones once in the sample. Texts of any length count whole. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.llm.runtime import hashed, pick
from quernstone.llm.textkit import utf8

#: Bounds of the labelled sample that the network is trained on: rows of each language, and languages (the most common).
PER_LANGUAGE, MAX_LANGUAGES = 300, 256
#: Windows of each training text in an epoch, drawn from all of it.
TRAIN_WINDOWS = 4
WINDOW = 256
EMBED = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
EPOCHS = 8


def windows_of(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes with zeros behind the text's end, text of each, bytes of text in each)."""
    size = np.diff(offsets)
    count = -(-size // window)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * window
    length = np.minimum(window, offsets[text + 1] - start)
    at = start[:, None] + np.arange(window)
    inside = np.arange(window) < length[:, None]
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)] if len(raw) else 0, 0).astype(np.uint8), text, length


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: list[np.ndarray]  # for each width (width, EMBED, FILTERS)
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: np.ndarray

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Plain forward pass over windows of bytes, as in training."""
        return self._forward(x)[0]

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        top, where = [], []
        for f in self.filters:
            w = len(f)
            # (windows, places, width * EMBED): overlapping views, copied by the product
            view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * EMBED)
            y = view @ f.reshape(w * EMBED, -1)
            where.append(y.argmax(axis=1))
            top.append(np.take_along_axis(y, where[-1][:, None], axis=1)[:, 0])
        hidden = np.maximum(np.concatenate(top, axis=1) + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), hidden, where, e

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, batch: int = 32, rate: float = 5e-3, text: np.ndarray | None = None) -> Network:
        """text: number of the text that each window is from; of each some are drawn for every epoch. None: all windows are used."""
        rng = np.random.default_rng(0)

        def init(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        n = FILTERS * len(WIDTHS)
        net = cls(languages, init(256, EMBED, scale=0.3), [init(w, EMBED, FILTERS, scale=0.3) for w in WIDTHS], np.zeros(n, np.float32), init(n, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
        weights = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            if text is not None:
                order = order[np.argsort(text[order], kind="stable")]  # of each text its windows in any order
                own = text[order]
                order = order[np.arange(len(own)) - np.searchsorted(own, own) < TRAIN_WINDOWS]
                order = order[rng.permutation(len(order))]
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                xb = x[rows]
                logp, hidden, where, e = net._forward(xb)
                dz = np.exp(logp)
                dz[np.arange(len(rows)), y[rows]] -= 1
                dz /= len(rows)
                dh = (dz @ net.out.T) * (hidden > 0)
                de = np.zeros_like(e)
                df = []
                for k, f in enumerate(net.filters):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    at = where[k][:, :, None] + np.arange(len(f))  # (rows, filters, width)
                    patch = e[np.arange(len(rows))[:, None, None], at]
                    df.append(np.einsum("bf,bfwe->wef", d, patch))
                    np.add.at(de, (np.arange(len(rows))[:, None, None], at), d[:, :, None, None] * f.transpose(2, 0, 1))
                dembed = np.zeros_like(net.embed)
                np.add.at(dembed, xb, de)
                grads = [dembed, *df, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return net


class Tables:
    """A network with its filters tabulated for pairs of bytes."""

    def __init__(self, net: Network) -> None:
        self.net = net
        taps = [[net.embed @ f[k] for k in range(len(f))] for f in net.filters]  # (256, FILTERS) each

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # row: first byte * 256 + second
            return (a[:, None] + b[None]).reshape(65536, -1).astype(np.float32)

        self.two = pair(*taps[0])
        self.three, self.third = pair(*taps[1][:2]), taps[1][2].astype(np.float32)
        self.four, self.fourth = pair(*taps[2][:2]), pair(*taps[2][2:])

    def log_probabilities(self, x: np.ndarray, at_once: int = 128) -> np.ndarray:
        """The same as the network's."""
        net, hidden = self.net, np.empty((len(x), FILTERS * len(WIDTHS)), dtype=np.float32)
        for i in range(0, len(x), at_once):
            b = x[i : i + at_once].astype(np.int32)
            p = b[:, :-1] << 8 | b[:, 1:]
            own = hidden[i : i + at_once]
            own[:, :FILTERS] = self.two.take(p, axis=0).max(axis=1)
            y = self.three.take(p[:, :-1], axis=0)
            y += self.third.take(b[:, 2:], axis=0)
            own[:, FILTERS : 2 * FILTERS] = y.max(axis=1)
            y = self.four.take(p[:, :-2], axis=0)
            y += self.fourth.take(p[:, 2:], axis=0)
            own[:, 2 * FILTERS :] = y.max(axis=1)
        z = np.maximum(hidden + net.bias, 0) @ net.out + net.out_bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network trained on at most per_language rows of each label, chosen by hash among the rows with a label and text; None if there are none."""
    known = pick(docs, key=key, text=text, label=label).filter("label is not null and key is not null and text <> ''").withColumn("label", F.col("label").cast("string"))
    sizes = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    # first by a share of the hashes that leaves some more than wanted, then exactly; the texts of the first choice only are moved
    h = hashed("key", "text")
    upto = F.create_map(*(F.lit(v) for r in sizes for v in (r["label"], min(2**63 - 1, int(2**64 * min(1.0, (per_language + 5 * per_language**0.5 + 5) / r["count"])) - 2**63))))
    first = known.filter(h <= upto[F.col("label")]).withColumn("h", h).dropDuplicates(["label", "h"])
    place = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    got = first.withColumn("place", place).filter(F.col("place") <= per_language).select("label", "h", "text").toArrow().to_pylist()
    if not got:
        return None
    got = sorted(got, key=lambda r: (r["label"], r["h"]))
    languages = sorted({r["label"] for r in got})
    x, owner, _ = windows_of(*utf8(pa.array([r["text"] for r in got], pa.string())))
    return Network.train(x, np.array([languages.index(r["label"]) for r in got])[owner], languages, text=owner)


def identify_batch(tables: Tables, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, probability, whether there is text) of each text."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    total, i = np.zeros((n, len(tables.net.languages))), 0
    while i < n:  # texts of about 2 MB at a time; a longer one in windows of its own
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (2 << 20), side="right")) - 1)
        for a in range(int(offsets[i]), int(offsets[j]), 2 << 20) if j == i + 1 else [int(offsets[i])]:
            b = min(a + (2 << 20), int(offsets[j])) if j == i + 1 else int(offsets[j])
            bounds = np.array([0, b - a]) if j == i + 1 else offsets[i : j + 1] - a
            x, owner, length = windows_of(raw[a:b], bounds)
            if len(x):
                np.add.at(total, i + owner, tables.log_probabilities(x) * length[:, None])
        i = j
    size = np.diff(offsets)
    mean = total / np.maximum(size, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    best = mean.argmax(axis=1)
    return best, np.round(p[np.arange(n), best] / p.sum(axis=1), 4), size > 0


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, probability) of every row of docs."""
    rows = pick(docs, key=key, text=text)
    if net is None:
        return rows.select("key", F.lit(None).cast("string"), F.lit(0.0)).toDF(key, "language", "probability")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(shared.value)
        for batch in batches:
            best, p, has = identify_batch(tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.languages[b] if h else None for b, h in zip(best.tolist(), has.tolist())], pa.string()), pa.array(np.where(has, p, 0.0))], names=[key, "language", "probability"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType())]))
