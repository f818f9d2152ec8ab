"""Toxicity by lexicon induction: random walks over a graph of words.

1. A bounded sample of labelled documents (MAX_LABELLED; of near copies one) gives labelled seed
   terms: toxic ones, most of whose documents surely are, and neutral ones, common ones most of whose documents surely aren't.
2. The vocabulary is the COMMON words that most documents have, the seeds, rare terms that may be toxic (all labelled documents that have them are), of which the
   graph tells more than the labels, and, labelled or not, frequent or rare, all words that stand within BESIDE words of
   toxic seeds, or of such terms, in LEAST_BESIDE documents or more, and surely in a larger share of theirs than words do on the whole.
3. Co-occurrences of vocabulary words within REACH of one another, over all documents, give the positive pointwise
   mutual information (PPMI) graph: a table of edges in the shared folder.
4. Random walks with restart over that table, from the toxic and from the neutral seeds, give each word the
   polarity (toxic - neutral) / (toxic + neutral), a seed the mean of that and 1 or -1. Words from a
   least polarity on are the lexicon.
5. A document's score is the sum of the polarities of its different lexicon words. It is toxic from a
   threshold on. Of those whose F1 on the labelled sample is within 1 % of the best it has the highest least
   polarity and the lowest threshold; there, the seeds come from other documents than those scored (FOLDS folds).

A word is known by a 64-bit hash of its lower-cased form. Counts, graph and walks are tables; the driver holds the
labelled sample, the lexicon, and the hashes of the held vocabulary, which is broadcast, 8 bytes a word: if more than
MAX_WORDS words stand beside toxic terms, those that do in most documents. All others are a table, which the words of the
documents are joined with; the result is the same.

Defined results:
- A null, empty or wordless text scores 0. Null labels and labels of unknown documents are ignored; of several
  documents of a labelled id one is in the sample.
- Without toxic seeds (no labels, or no term that tells) every score is 0 and nothing is toxic.
- A text of any length is one document: a word counts once in it, and words across pieces of it stand beside one another.
- Ids may repeat, as rows may; every row counts. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import cut, need, one_text, pick, sample_by_hash, small
from quernstone.llm.textkit import SLICE_BYTES, distinct_words, slices, splitmix, utf8, words

#: Bound of the labelled sample for seeds and threshold.
MAX_LABELLED = 12000
REACH = 5
#: Words are in the vocabulary if they stand within so many words of a toxic seed in so many documents.
BESIDE, LEAST_BESIDE = 10, 3
#: Bound of the words that are held (on the driver and broadcast) for that; further ones are a table.
MAX_WORDS = 8_000_000
#: So many of the words that most documents have are in the vocabulary whatever they stand beside: walks go on through them.
COMMON = 3000
#: Least polarities of the lexicon that are tried.
POLARITIES = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
FOLDS = 3
#: Probability that a walk goes on instead of returning to a seed, its steps, and how many of these are one job.
DAMPING, STEPS, AT_ONCE = 0.85, 12, 6
#: Edges in a partition of the graph: each sends a row for every word that it reaches.
EDGES = 2_000_000


def distinct_words_beside(column: pa.Array, anchors: np.ndarray, reach: int = BESIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, whether another word within reach of it is an anchor) of the different words of each text, some texts at a time. anchors: sorted."""
    own, held, context = -1, None, None
    for part, bounds, rows in slices(*utf8(column, lower=True)):
        h, _, piece = words(part, bounds)
        goes_on = len(rows) == 1 and rows[0] == own
        if held is not None and not goes_on:
            yield held
            held = None
        if goes_on and context is not None:
            h, piece = np.concatenate([context, h]), np.zeros(len(context) + len(h), dtype=np.int64)
        own = int(rows[0]) if len(rows) == 1 else -1
        context = h[-2 * reach :] if own >= 0 else None  # those at the end are looked at again, with what follows
        if not len(h):
            continue
        beside = np.zeros(len(h), dtype=bool)
        if len(anchors):
            is_one = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
            if is_one.any():
                before, n = np.append(0, np.cumsum(is_one)), np.arange(len(h))
                low, high = np.maximum(n - reach, np.searchsorted(piece, piece)), np.minimum(n + reach + 1, np.searchsorted(piece, piece, side="right"))
                beside = before[high] - before[low] - is_one > 0
        if held is not None:
            h, beside, piece = np.concatenate([held[0], h]), np.concatenate([held[1], beside]), np.zeros(len(held[0]) + len(h), dtype=np.int64)
        order = np.lexsort((h, piece))
        h, piece, beside = h[order], piece[order], beside[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (piece[1:] != piece[:-1])))
        found = h[first], np.logical_or.reduceat(beside, first)
        if own >= 0:
            held = found
        else:
            yield found
    if held is not None:
        yield held


def wilson(hits: np.ndarray, of: np.ndarray, z: float) -> np.ndarray:
    """Bound of a share: the lower one for z > 0, the upper one for z < 0."""
    of = np.maximum(of, 1)
    p = hits / of
    return (p + z * z / (2 * of) - z * np.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


@dataclass
class Labelled:
    """Different words of labelled documents: toxic (n,), and the words of each one after the other."""

    toxic: np.ndarray
    word: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, sets: list[np.ndarray], toxic: list[float]) -> Labelled:
        """Leaves out copies: documents of which three minimum hashes in a row, of twelve, are those of an earlier one.

        Only words of few documents count for that.
        """
        terms, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
        rare = terms[df <= max(2, 0.02 * len(sets))]
        seen: set[tuple] = set()
        keep = []
        for n, s in enumerate(sets):
            own = s[rare[np.minimum(np.searchsorted(rare, s), len(rare) - 1)] == s] if len(rare) else rare
            least = [int(splitmix(own + np.uint64(k + 1)).min()) for k in range(12)] if len(own) else [0] * 12
            bands = {(k, *least[k : k + 3]) for k in range(0, 12, 3)} if len(own) else {tuple(s.tolist())}
            if not bands & seen:
                keep.append(n)
            seen |= bands
        own = [sets[n] for n in keep]
        return cls(np.array([toxic[n] for n in keep]) >= 0.5, np.concatenate(own) if own else np.zeros(0, np.uint64), np.repeat(np.arange(len(own)), [len(s) for s in own]))

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(toxic seeds, neutral seeds, terms that may be toxic but are too rare here to tell), as hashes."""
        if not len(self.word):
            return (np.zeros(0, np.uint64),) * 3
        terms, inverse = np.unique(self.word, return_inverse=True)
        of = np.bincount(inverse)
        hits = np.bincount(inverse, weights=self.toxic[self.owner])
        base = self.toxic.mean()
        toxic = (of >= 4) & (wilson(hits, of, 2.0) >= max(0.5, 2 * base))
        return terms[toxic], terms[(of >= 0.02 * len(self.toxic)) & (wilson(hits, of, -2.0) < 0.5)], terms[~toxic & (of >= 2) & (wilson(hits, of, 1.0) >= max(0.5, 2 * base))]

    def without(self, fold: int) -> Labelled:
        """The documents that aren't in this one of FOLDS folds."""
        kept = np.arange(len(self.toxic)) % FOLDS != fold
        own = kept[self.owner]
        return Labelled(self.toxic[kept], self.word[own], (np.cumsum(kept) - 1)[self.owner[own]])


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, label: str, max_labelled: int) -> Labelled:
    known = pick(labels, id=label_key, label=label).filter("label is not null and id is not null").groupBy("id").agg(F.avg("label").alias("label"))
    chosen = F.broadcast(cut(sample_by_hash(cut(known), "id", max_labelled)))  # a bounded number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [b""] * len(batch)
            for rows, h in distinct_words(batch.column(2)):
                at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, int)
                for n, own in zip(rows[at].tolist(), np.split(h, at[1:])):
                    packed[n] = own.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "words"])

    rows = one_text(pick(docs, id=key, text=text).join(chosen, "id"), "text", "id", "label")
    got = rows.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("label", T.DoubleType()), T.StructField("words", T.BinaryType())])).toArrow().to_pylist()
    got = sorted((r for r in got if r["words"]), key=lambda r: r["id"])
    return Labelled.of([np.frombuffer(r["words"], np.uint64) for r in got], [r["label"] for r in got])


class Counted:
    """Counts by key that a task adds up before it sends them; in parts if they are many.

    Two workers share an executor's memory with its JVM: a merge makes no more copies than it needs, and is of `more` new keys at a time.
    """

    def __init__(self, most: int = 2_000_000, more: int = 1_000_000) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []  # sorted different keys first, then what isn't merged yet
        self.size, self.most, self.more = 0, most, more

    def add(self, keys: np.ndarray, *counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """What has to be sent now."""
        self.held.append((keys, *counts))
        self.size += len(keys)
        if self.size <= self.more:
            return []
        self.held, self.size = self.rest(), 0
        return self.rest() if len(self.held[0][0]) > self.most else []  # so many are added up by the shuffle

    def rest(self) -> list[tuple[np.ndarray, ...]]:
        if len(self.held) > 1:
            columns = [*zip(*self.held)][::-1]
            self.held = []
            keys = np.concatenate(columns.pop())
            order = np.argsort(keys, kind="stable")  # fast for runs that are sorted
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            merged = [keys[first]]
            del keys
            while columns:
                c = np.concatenate(columns.pop())[order]
                merged.append(np.add.reduceat(c, first) if len(first) else c)
            self.held = [tuple(merged)]
        own, self.held, self.size = self.held, [], 0
        return own


def _batches(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for i in range(0, len(part[0]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 17)].view(np.int64)) for x in part], names=names)


def thin(batches: Iterator[pa.RecordBatch], most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches whose first column is text, so many bytes of it at a time, or one longer text: it is lower-cased as a whole."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            yield batch.slice(i, j - i)
            i = j


def word_counts(docs: DataFrame, anchors: np.ndarray, text: str) -> DataFrame:
    """(word, df, beside) of every word: in how many documents it is, and stands beside an anchor; kept in the shared folder."""
    anchors = np.unique(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted()
        for batch in thin(batches):
            for h, beside in distinct_words_beside(batch.column(0), anchors):
                h, inverse, df = np.unique(h, return_inverse=True, return_counts=True)
                yield from _batches(counted.add(h, df, np.bincount(inverse, weights=beside).astype(np.int64)), ["word", "df", "beside"])
        yield from _batches(counted.rest(), ["word", "df", "beside"])

    counts = pick(docs, text=text).mapInArrow(run, "word long, df long, beside long")
    return cut(counts.groupBy("word").agg(F.sum("df").alias("df"), F.sum("beside").alias("beside")))


def beside_words(counts: DataFrame) -> DataFrame:
    """(word, df, beside) of the words that surely stand beside anchors more than words do on the whole."""
    share = counts.agg((F.sum("beside") / F.sum("df")).alias("share")).first()["share"] or 0.0
    of, p = F.col("df"), F.col("beside") / F.col("df")
    surely = (p + 2 / of - 2 * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / of + 1 / (of * of))) / (1 + 4 / of)  # wilson(beside, df, 2.0)
    return counts.filter((F.col("beside") >= LEAST_BESIDE) & (surely > share))


def vocabulary(counts: DataFrame, terms: np.ndarray, max_words: int = MAX_WORDS, common: int = COMMON) -> np.ndarray:
    """The held vocabulary: sorted hashes of the given terms that occur, of the most common words, and of the words beside anchors.

    Of these it has the max_words ones beside anchors in most documents; `beyond` has all others.
    """
    spark = counts.sparkSession
    given = spark.createDataFrame(pa.table({"word": pa.array(np.unique(terms).view(np.int64))}))  # of the sample, so bounded
    beside = beside_words(counts).orderBy(F.desc("beside"), "word").limit(max_words)
    found = counts.join(F.broadcast(given), "word", "left_semi").select("word").union(beside.select("word")).union(counts.orderBy(F.desc("df"), "word").limit(common).select("word")).distinct().toArrow()
    return np.unique(found["word"].to_numpy().astype(np.int64).view(np.uint64))


def beyond(counts: DataFrame, vocab: np.ndarray, max_words: int = MAX_WORDS) -> DataFrame | None:
    """(word, place) of the words beside anchors that aren't held: their places follow those of vocab; kept in the shared folder. None if all are held."""
    if len(vocab) < max_words:  # so few that none was left out
        return None
    found = beside_words(counts)
    if found.count() <= max_words:
        return None
    held = counts.sparkSession.createDataFrame(pa.table({"word": pa.array(vocab.view(np.int64))}))
    found = cut(found.select("word").join(held, "word", "left_anti"))
    sizes = dict(found.groupBy(F.spark_partition_id().alias("part")).count().collect())
    places, first = [], len(vocab)
    for part in sorted(sizes):
        places += [F.lit(part), F.lit(first).cast("long")]
        first += sizes[part]
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut(found.select("word", (F.element_at(F.create_map(*places), F.spark_partition_id()) + in_part).alias("place"))) if sizes else None


def words_beyond(texts: DataFrame, vocab: np.ndarray, rest: DataFrame) -> DataFrame:
    """texts (key, text; key: a hash of text), with the (word, place) of rest that texts of the key have, or null, as `further`."""
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for rows, h in distinct_words(batch.column(1)):
                other = held[np.minimum(np.searchsorted(held, h), len(held) - 1)] != h
                yield from _batches([(keys[rows[other]], h[other])], ["key", "word"])

    found = texts.mapInArrow(run, "key long, word long").join(small(rest), "word")
    return texts.join(found.groupBy("key").agg(F.collect_set(F.struct("word", "place")).alias("further")), "key", "left")


def cooccurrences(docs: DataFrame, vocab: np.ndarray, text: str, reach: int = REACH, rest: DataFrame | None = None) -> DataFrame:
    """(a, b, times), a <= b: how often vocabulary words stand within `reach` vocabulary words of one another, over all documents.

    vocab: sorted; words are their places in it. rest: further (word, place), if any. Kept in the shared folder.
    """
    held, texts = len(vocab), pick(docs, text=text)
    v = held + (rest.count() if rest is not None else 0)
    if v * v >= 1 << 63:
        raise ValueError(f"{v} words are too many to number pairs of them")
    if rest is not None:
        texts = words_beyond(texts.filter("text is not null").select(F.xxhash64("text").alias("key"), "text"), vocab, rest).select("text", "further")
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, known_words = Counted(), shared.value
        for batch in thin(batches):
            own, tail = -1, np.zeros(0, np.int64)
            if batch.num_columns > 1:
                ends, further = batch.column(1).offsets.to_numpy(), batch.column(1).values
                further_words, further_places = further.field(0).to_numpy().view(np.uint64), further.field(1).to_numpy()
            for part, bounds, rows in slices(*utf8(batch.column(0), lower=True)):
                h, _, piece = words(part, bounds)
                at = np.minimum(np.searchsorted(known_words, h), held - 1)
                known = known_words[at] == h
                if batch.num_columns > 1:  # what one of these texts has is in the vocabulary for all of them
                    of_these = slice(ends[rows[0]], ends[rows[-1] + 1])
                    more, first = np.unique(further_words[of_these], return_index=True)
                    if len(more):
                        n = np.minimum(np.searchsorted(more, h), len(more) - 1)
                        at = np.where(known, at, further_places[of_these][first][n])
                        known |= more[n] == h
                at, piece, old = at[known], piece[known], 0
                if len(rows) == 1 and rows[0] == own:  # goes on in the same text
                    at, old = np.concatenate([tail, at]), len(tail)
                    piece = np.zeros(len(at), dtype=np.int64)
                own = int(rows[0]) if len(rows) == 1 else -1
                tail = at[-reach:] if own >= 0 else at[:0]
                codes = []
                for d in range(1, reach + 1):
                    near = piece[d:] == piece[:-d]
                    near[: max(0, old - d)] = False  # those among the carried ones are counted
                    a, b = at[:-d][near], at[d:][near]
                    codes.append(np.minimum(a, b) * v + np.maximum(a, b))
                yield from _batches(counted.add(*np.unique(np.concatenate(codes), return_counts=True)), ["code", "times"])
        yield from _batches(counted.rest(), ["code", "times"])

    counts = texts.mapInArrow(run, "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    a = F.expr(f"code div {v}")
    return cut(counts.select(a.alias("a"), (F.col("code") - a * v).alias("b"), "times"))


def ppmi(counts: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions: positive pointwise mutual information, as shares of the sum of its a; kept in the shared folder."""
    both = counts.union(counts.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "times"))
    of = cut(both.groupBy("a").agg(F.sum("times").cast("double").alias("of")))  # a row a word
    total, = of.agg(F.sum("of")).first()
    graph = both.filter("a <> b").join(small(of), "a").join(small(of.toDF("b", "other")), "b")
    graph = cut(graph.select("a", "b", F.log(F.col("times") * F.lit(total) / F.col("of") / F.col("other")).alias("weight")).filter("weight > 0"))
    sums, n = cut(graph.groupBy("a").agg(F.sum("weight").alias("sum"))), graph.count()
    shares = graph.join(small(sums), "a").select("a", "b", (F.col("weight") / F.col("sum")).alias("weight"))
    return cut(shares.coalesce(-(-n // EDGES)) if 0 < n // EDGES + 1 < shares.rdd.getNumPartitions() else shares)


def walk(graph: DataFrame, starts: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(node, and each other column of starts): where walks that begin as starts says (probabilities of nodes) are after some steps."""
    names = [c for c in starts.columns if c != "node"]
    starts = cut(starts)
    restart = starts.select("node", *((F.col(c) * (1 - damping)).alias(c) for c in names))
    now = starts
    for k in range(steps):
        side = small(now) if k % AT_ONCE == 0 else now
        moved = graph.join(side, graph["a"] == side["node"]).select(F.col("b").alias("node"), *((F.col("weight") * F.col(c) * damping).alias(c) for c in names))
        now = moved.union(restart).groupBy("node").agg(*(F.sum(c).alias(c) for c in names))
        if k % AT_ONCE == AT_ONCE - 1 or k == steps - 1:
            now = cut(now)
    return now


def polarities(graph: DataFrame, vocab: np.ndarray, seeds: list[tuple[np.ndarray, np.ndarray]], least: float = POLARITIES[0], rest: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, polarity of each for every pair of toxic and neutral seeds) of the words that have at least that polarity for some pair."""
    spark = graph.sparkSession
    columns = {f"{kind}{k}": own for k, pair in enumerate(seeds) for kind, own in zip(("t", "n"), pair)}
    asked = np.unique(np.concatenate(list(columns.values())))  # of the sample, so bounded
    seeded = np.flatnonzero(np.isin(vocab, asked))
    seeds_at = vocab[seeded]
    if rest is not None:  # seeds of a fold needn't be seeds of all, so some may not be held
        more = rest.join(F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(asked.view(np.int64))}))), "word").select("word", "place").toArrow()
        seeded, seeds_at = np.append(seeded, more["place"].to_numpy()), np.append(seeds_at, more["word"].to_numpy().view(np.uint64))
    start = {name: np.isin(seeds_at, own) for name, own in columns.items()}
    first = {name: x / max(1, x.sum()) for name, x in start.items()}
    starts = spark.createDataFrame(pa.table({"node": pa.array(seeded.astype(np.int64)), **{c: pa.array(x) for c, x in first.items()}}))
    reached = walk(graph, starts).join(F.broadcast(starts.toDF("node", *(f"s{c}" for c in columns))), "node", "left")

    def polarity(k: int) -> Column:
        t, n = F.col(f"t{k}"), F.col(f"n{k}")
        p = (t - n) / F.greatest(t + n, F.lit(1e-12))
        # of a seed the label tells as much as the graph, which has common words around every word
        p = F.when(F.col(f"st{k}") > 0, (p + 1) / 2).when(F.col(f"sn{k}") > 0, (p - 1) / 2).otherwise(p)
        return F.round(p if first[f"t{k}"].any() else F.lit(0.0), 6).alias(f"p{k}")

    got = reached.select("node", *(polarity(k) for k in range(len(seeds))))
    got = got.filter(F.greatest(*(F.col(f"p{k}") for k in range(len(seeds))), F.lit(-1.0)) >= least)
    got = (got.withColumn("word", F.lit(0)) if rest is None else got.join(small(rest.withColumnRenamed("place", "node")), "node", "left").fillna(0, ["word"])).toArrow()
    node, other = got["node"].to_numpy(), got["word"].to_numpy().astype(np.int64).view(np.uint64)
    word = np.where(node < len(vocab), vocab[np.minimum(node, len(vocab) - 1)], other)
    order = np.argsort(word)
    return word[order], np.stack([got[f"p{k}"].to_numpy()[order] for k in range(len(seeds))])


@dataclass
class Lexicon:
    """Words (sorted hashes), their polarities, and from what score on a document is toxic."""

    word: np.ndarray
    polarity: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from the (text, word) pairs, all different."""
        if not len(self.word):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        known = self.word[at] == h
        return np.bincount(rows[known], weights=self.polarity[at[known]], minlength=n)


def induce(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> Lexicon:
    need(docs, key, text)
    need(labels, label_key, label)
    sample = labelled_sample(docs, labels, key, text, label_key, label, max_labelled)
    toxic, neutral, likely = sample.seeds()
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.inf)
    if not len(toxic):
        return empty
    anchors = np.union1d(toxic, likely)
    counts = word_counts(docs, anchors, text)
    vocab = vocabulary(counts, np.union1d(anchors, neutral), max_words)
    if not len(vocab):
        return empty
    rest = beyond(counts, vocab, max_words)
    graph = ppmi(cooccurrences(docs, vocab, text, rest=rest))
    # each document is scored by the lexicon of the other folds, or its own words would seem to tell more than they do
    word, polarity = polarities(graph, vocab, [(toxic, neutral), *(sample.without(fold).seeds()[:2] for fold in range(FOLDS))], rest=rest)
    cross = np.zeros((len(POLARITIES), len(sample.toxic)))
    for fold in range(FOLDS):
        own = np.arange(len(sample.toxic)) % FOLDS == fold
        for row, least in zip(cross, POLARITIES):
            polar = polarity[fold + 1] >= least
            row[own] = Lexicon(word[polar], polarity[fold + 1][polar], np.inf).score(sample.owner, sample.word, len(sample.toxic))[own]
    least, threshold = best_cut(cross, sample.toxic)
    polar = polarity[0] >= least
    return Lexicon(word[polar], polarity[0][polar], threshold)


def best_cut(cross: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The highest least polarity, and for it the lowest threshold, half-way between two scores, whose F1 is within 1 % of the best of all."""
    tried = []
    for least, s in zip(POLARITIES, cross):
        order = np.argsort(-s, kind="stable")
        ranked = np.append(s[order], 0.0)
        f1 = 2 * np.cumsum(toxic[order]) / (toxic.sum() + np.arange(1, len(s) + 1))
        ends = np.flatnonzero(ranked[:-1] > ranked[1:])  # a threshold is between different scores
        tried += [(least, float(ranked[n] + ranked[n + 1]) / 2, float(f1[n])) for n in ends]
    best = max((f for _, _, f in tried), default=0.0)
    good = [(least, -threshold) for least, threshold, f in tried if f > 0 and f >= 0.99 * best]
    return (max(good)[0], -max(good)[1]) if good else (POLARITIES[-1], np.inf)


def scores(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, toxic) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            total = np.zeros(len(batch))
            pairs = []
            for part, bounds, rows in slices(*utf8(batch.column(1), lower=True)):
                h, _, piece = words(part, bounds)
                at = np.minimum(np.searchsorted(lex.word, h), max(0, len(lex.word) - 1))
                known = lex.word[at] == h if len(lex.word) else np.zeros(len(h), bool)
                if known.any():
                    pairs.append(np.stack([rows[piece[known]], at[known]]))
            if pairs:
                rows, at = np.unique(np.concatenate(pairs, axis=1), axis=1)
                total += np.bincount(rows, weights=lex.polarity[at], minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(total, 6)), pa.array(total >= lex.threshold)], names=[key, "score", "toxic"])

    return pick(docs, key=key, text=text).mapInArrow(run, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))


def toxic_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """(key, score) of the rows of docs that are toxic."""
    return scores(docs, induce(docs, labels, key, text, **fitting), key, text).filter("toxic").select(key, "score")
