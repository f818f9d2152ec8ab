"""Near-duplicate groups by SimHash and multi-index hashing.

A fingerprint is the signs of sums over the text's different words (as lower-cased). Two texts
are near duplicates if their first 192 bits differ in at most DISTANCE; the bits behind these
only help to find such pairs. The fingerprint is cut into segments, whose width goes with the
logarithm of the number of documents (`layout`), so that a table slot has about as many entries
at every size. Every fingerprint is entered in the tables under all values within one bit of
each of its segments, and looked up under the same values: two fingerprints whose segments
differ in up to two bits meet half-way. There are as many segments as are needed for at most
MISSED of the pairs that differ in DISTANCE bits not to meet; of nearer pairs fewer are missed.
Complete distances are then verified. Pairs are joined to groups (connected components).

Each meeting is counted once: of the two half-way values only one is taken. 113 of the 192 bits
travel with an entry, and those that differ in more than DISTANCE of them are dropped within the
join, which drops no pair within it. Families of copies are found beforehand, by comparing
those with a segment in common with one of them. In a table slot, the entries of the family with
most entries meet all others but not one another, so that a family costs as much as it has members.

Defined results:
- A text without words (null, empty, only signs) has no fingerprint and is in no group.
- However long texts are and however often words repeat, equal sets of words are equal fingerprints.
- Equal fingerprints are one entry however many documents have them.
- Of a group the smallest id stays, a null id last; of rows equal in id and text, one.
- Ids may repeat. An empty table gives an empty result. Other columns are carried along
  by `near_distinct`, whatever their names; names that begin with `__quern_` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.llm.graph import components
from quernstone.llm.runtime import by_place, cut, pick, small
from quernstone.llm.textkit import distinct_words, splitmix

#: Bits that decide, and largest number of them in which near duplicates differ.
BITS = 192
DISTANCE = 28
#: Largest share of pairs at DISTANCE that have no segment within two bits.
MISSED = 0.005
#: Tables are laid out for so many fingerprints at least: fewer need no narrower ones.
LEAST = 1 << 20
#: What an entry costs against one comparison in a slot: it is made, shuffled, sorted and counted (about 2 microseconds against 10 nanoseconds).
ENTRY_COST = 200

# _SPREAD[v] has bit k of v in its k-th byte: sums of up to 255 of them are eight counts at once
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class Layout:
    """segments of `width` bits each in fingerprints of `words` x 64 bits."""

    segments: int
    width: int

    @property
    def words(self) -> int:
        return max(BITS // 64, -(-self.segments * self.width // 64))

    def entries(self) -> int:
        """Table entries of a fingerprint."""
        return self.segments * (self.width + 1)

    def comparisons(self, n: int) -> float:
        """Expected entries of others that a fingerprint's entries find in their slots by chance, of n fingerprints."""
        return self.segments * (self.width + 1) ** 2 * n / 2.0**self.width


@lru_cache(maxsize=None)
def missed(segments: int, width: int, distance: int = DISTANCE) -> float:
    """Share of the pairs that differ in `distance` of BITS bits (and alike in the bits behind) all of whose segments differ in three bits or more."""
    free, total = max(0, BITS - segments * width), max(BITS, segments * width)
    differ = round(total * distance / BITS)
    ways = [math.comb(free, j) for j in range(min(free, differ) + 1)]
    for _ in range(segments):
        more = [0] * min(differ + 1, len(ways) + width)
        for i, x in enumerate(ways):
            for j in range(3, min(width + 1, len(more) - i)):
                more[i + j] += x * math.comb(width, j)
        ways = more
    return (ways[differ] if differ < len(ways) else 0) / math.comb(total, differ)


@lru_cache(maxsize=64)
def layout(n: int, distance: int = DISTANCE, most: float = MISSED) -> Layout:
    """The cheapest segments for n fingerprints that miss no more than `most` of the pairs at the distance."""

    def least(width: int) -> int:
        high = 1
        while missed(high, width, distance) > most:
            high *= 2
        low = high // 2 + 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if missed(mid, width, distance) <= most else (mid + 1, high)
        return low

    n = max(n, LEAST)
    log = int(math.log2(n))
    return min((Layout(least(w), w) for w in range(log - 2, log + 5)), key=lambda s: ENTRY_COST * s.entries() + s.comparisons(n))


def _counts(hashes: np.ndarray, starts: np.ndarray, word: int) -> np.ndarray:
    """How often each of the 64 bits of that word is set among each run of hashes (runs begin at starts)."""
    ends = np.append(starts[1:], len(hashes))
    blocks = -(-(ends - starts) // 255)
    first = np.cumsum(blocks) - blocks
    at = np.repeat(starts, blocks) + 255 * (np.arange(int(blocks.sum())) - np.repeat(first, blocks))
    out = np.empty((len(starts), 64), dtype=np.int64)
    own = splitmix(hashes + np.uint64(7919 * (word + 1))).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[own[:, k]], at)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def fingerprint_batch(texts: pa.Array, width: int = BITS // 64) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, width) as int64, and whether the text has words."""
    out, has = np.zeros((len(texts), width), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for rows, h in distinct_words(texts):
        if not len(h):
            continue
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        at, size = rows[starts], np.diff(np.append(starts, len(h)))
        has[at] = True
        for w in range(width):
            out[at, w] = np.packbits(2 * _counts(h, starts, w) > size[:, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out, has


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = BITS // 64) -> DataFrame:
    """(key, h, f0, f1, ...) of the rows of docs whose text has words; h is a hash of the text."""
    rows = pick(docs, key=key, text=text)
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("h", T.LongType()), *(T.StructField(f"f{k}", T.LongType()) for k in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, has = fingerprint_batch(batch.column(2), width)
            at = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(prints[has, k])) for k in range(width))], names=schema.names)

    return rows.select("key", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


def _bits(first: int, width: int) -> F.Column:
    """`width` bits of the fingerprint, from that bit on, as a number."""
    word, bit = divmod(first, 64)
    low = F.shiftrightunsigned(F.col(f"f{word}"), bit)
    if bit + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col(f"f{word + 1}"), 64 - bit))
    return low.bitwiseAND(F.lit((1 << width) - 1))


def _slots(count: int, width: int) -> F.Column:
    """(slot) for each of the first `count` segments: the segment's number and value."""
    return F.explode(F.array(*(F.lit(k << width).cast("long").bitwiseOR(_bits(k * width, width)) for k in range(count))))


def _words(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "f" and c[1:].isdigit()]


def numbered(nodes: DataFrame) -> DataFrame:
    """The different fingerprints among f0, f1, ..., each with a dense number `node`; kept in the shared folder."""
    f = _words(nodes)
    place = "place"
    nodes = cut(nodes.select(*f).distinct().withColumn(place, F.monotonically_increasing_id()))
    part, within = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = nodes.groupBy(part.alias("part")).count()
    # one row a partition
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")
    return cut(nodes.join(F.broadcast(before), part == F.col("part")).select((F.col("before") + within).alias("node"), *f))


def _verified(pairs: DataFrame, nodes: DataFrame, distance: int) -> DataFrame:
    """The (a, b) of pairs whose first BITS bits differ in at most `distance`, with that number."""
    f = range(BITS // 64)
    full = [nodes.select(F.col("node").alias(x), *(F.col(f"f{k}").alias(f"{x}{k}") for k in f)) for x in "ab"]
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in f), F.lit(0))
    return pairs.join(full[0], "a").join(full[1], "b").select("a", "b", apart.alias("distance")).filter(F.col("distance") <= distance)


def families(nodes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """(node, label): groups found without pairing everything, by one comparison with the first and last of those that have a segment in common.

    A family of thousands of copies has millions of pairs; most of its members are joined here, in
    a number of steps that grows with the documents. These segments are 6 bits wider than the
    logarithm of n, so that those who share one are seldom strangers.
    """
    width = min(BITS // 2, max(16, math.ceil(math.log2(max(2, n))) + 6))
    rows = nodes.select("node", _slots(BITS // width, width).alias("slot"))
    # counted before the shuffle, and joined with one row a slot: a slot that many have is split among tasks
    ends = rows.groupBy("slot").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")
    met = rows.join(ends, "slot").select(F.col("node").alias("a"), F.explode(F.array("first", "last")).alias("b")).filter("a <> b").distinct()
    return components(_verified(met, nodes, distance).select("a", "b"))


def near_pairs(nodes: DataFrame, shape: Layout, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance), a < b, of the fingerprints (node, family, f0, f1, ...) within that distance that aren't of one family.

    node: below 2**39. family: positive; 0 for fingerprints that are in none.
    """
    # nothing is null, and said to be so: else filters go into one side of the join, and the sides' shuffle isn't one
    nodes = nodes.select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("node", "family", *_words(nodes))))
    # 113 bits of the fingerprint travel: 24 behind the node's number, 31, and 58 behind which the way has six
    node, some = F.shiftleft("node", 24).bitwiseOR(F.shiftrightunsigned("f0", 40)), F.col("f1").bitwiseAND(F.lit((1 << 31) - 1))
    base = nodes.select(node.alias("node"), "family", some.cast("int").alias("some"), F.col("f2").bitwiseAND(F.lit(~63)).alias("rest"), _slots(shape.segments, shape.width).alias("slot"))
    # way 0 leaves a segment as it is; way k flips its bit k - 1
    flips = F.explode(F.array(*(F.struct(F.lit(way).cast("long").alias("way"), F.lit(1 << way - 1 if way else 0).cast("long").alias("flip")) for way in range(shape.width + 1))))
    entries = base.select("*", flips.alias("x")).select(F.col("slot").bitwiseXOR(F.col("x.flip")).alias("slot"), "node", "family", "some", F.col("rest").bitwiseOR(F.col("x.way")).alias("rest"))
    # both sides are renamed alike, so that their shuffle is one
    a, b = (entries.toDF("slot", f"n{x}", f"f{x}", f"s{x}", f"r{x}") for x in "ab")
    slot = Window.partitionBy("slot").orderBy("fb").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the family with most of a slot's entries, if any: its entries meet the others' on one side only
    b = b.withColumn("low", F.first("fb").over(slot)).withColumn("high", F.last("fb").over(slot)).withColumn("n", F.count("*").over(slot)).filter("n > 1 and (low < high or high = 0)")
    b = b.withColumn("n", F.when(F.col("fb") > 0, F.count("*").over(Window.partitionBy("slot", "fb"))).otherwise(0))
    b = b.withColumn("most", F.max(F.struct("n", "fb")).over(slot)["fb"]).filter("fb = 0 or fb <> most").drop("low", "high", "n")
    ways = [F.col(f"r{x}").bitwiseAND(F.lit(63)) for x in "ab"]
    first = F.col("na") < F.col("nb")
    once = F.when(first, (ways[0] == 0) | (ways[0] < ways[1])).otherwise((ways[1] == 0) | (ways[1] < ways[0]))
    apart = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("ra").bitwiseXOR(F.col("rb")).bitwiseAND(F.lit(~63))) + F.bit_count(F.col("na").bitwiseXOR(F.col("nb")).bitwiseAND(F.lit((1 << 24) - 1)))
    strangers = (F.col("fa") == 0) | (F.col("fa") != F.col("fb"))
    meet = a.join(b, "slot").filter((apart <= distance) & strangers & (((F.col("fa") > 0) & (F.col("fa") == F.col("most"))) | first) & once)
    numbers = [F.shiftrightunsigned(c, 24) for c in (F.least("na", "nb"), F.greatest("na", "nb"))]
    return _verified(meet.select(*(c.alias(x) for c, x in zip(numbers, "ab"))).distinct(), nodes, distance)


def _members(docs: DataFrame, key: str, text: str, distance: int) -> DataFrame:
    """(key, h, keep_key, keep_h, copies): the rows in groups of several, with the one that stays and how many rows are equal to this one."""
    n = docs.count()
    shape = layout(n, distance)
    prints = cut(fingerprints(docs, key, text, shape.words))
    nodes = numbered(prints)
    # families are numbered from 1 on; a fingerprint in none has its own number as label
    known = cut(nodes.join(families(nodes, n, distance), "node", "left").select(*nodes.columns, F.coalesce(F.col("label") + 1, F.lit(0).cast("long")).alias("family")))
    labels = known.select("node", F.when(F.col("family") > 0, F.col("family") - 1).otherwise(F.col("node")).alias("label"), *_words(known))
    of = labels.select("node", "label")
    linked = near_pairs(known, shape, distance).join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b")
    wider = components(linked.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("wider"))
    f = _words(known)
    grouped = labels.join(wider, "label", "left").select(*f, F.coalesce("wider", "label").alias("label"))
    # copies are counted first: a group of any number of rows is as many as it has different ids and texts
    counted = prints.groupBy(*f, "key", "h").agg(F.count("*").alias("copies"))
    of = counted.join(grouped, f).select("key", "h", "copies", "label")
    # min of (is null, key, h): a null key comes last
    ends = of.groupBy("label").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("stays"), F.sum("copies").alias("size")).filter("size > 1")
    return of.join(ends, "label").select("key", "h", "copies", F.col("stays.key").alias("keep_key"), F.col("stays.h").alias("keep_h"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each document that doesn't stay in a group of near duplicates: its id, and keep_id of the one that stays."""
    m = _members(docs, key, text, distance)
    stays = F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("h") == F.col("keep_h"))
    gone = F.col("copies") - F.when(stays, 1).otherwise(0)
    return m.select("key", "keep_key", F.explode(F.array_repeat(F.lit(0), gone.cast("int"))).alias("n")).select(F.col("key").alias(key), F.col("keep_key").alias("keep_id"))


def near_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group of near duplicates; all columns of docs."""
    m = cut(_members(docs, key, text, distance))
    stays = F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("h") == F.col("keep_h"))
    gone = small(m.filter(~stays).select(F.col("key").alias("k"), F.col("h").alias("h")))
    again = m.filter(stays & (F.col("copies") > 1)).select(F.col("key").alias("k"), F.col("h").alias("h"))
    rows, at = by_place(docs)
    k, t = F.col(at[key]), F.col(at[text])

    def same(right: DataFrame) -> F.Column:
        return k.eqNullSafe(right["k"]) & (F.xxhash64(t) == right["h"])

    out = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        again = small(again)
        own = "__quern_h"
        one = out.join(again, same(again), "left_semi").withColumn(own, F.xxhash64(t)).dropDuplicates([at[key], own]).drop(own)
        out = out.join(again, same(again), "left_anti").union(one)
    return out.toDF(*docs.columns)
