"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are all runs of `window` words of each benchmark item, or the whole item
if it has fewer words. Texts and items are normalised alike: lower case, and every run
of bytes that aren't ASCII letters, digits or part of a longer character becomes one
space. A block is 8 bytes. The shift table, by a hash of a block, says how far the
search may move on; where it says 0, the bucket of the block's hash gives the test
strings, which are compared byte by byte. A text is searched in lanes, so that numpy
moves thousands of cursors at once.

Defined results:
- A null or empty text contains nothing; a text of any length is searched whole. Null or wordless items contain no test string.
- Repeated items, and items with strings in common, each count.
- Ids may repeat, as rows may; every row is searched. Empty tables give empty results.
- Other columns don't matter to the search and are carried along by `clean_documents`.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import by_place, need, pick
from quernstone.llm.textkit import WORD_BYTE, slices, utf8

WINDOW = 8
BLOCK = 8
LANE = 512
#: Bytes of the tables that are broadcast, with what Python needs for each string; more items are searched for in several passes.
TABLE_BYTES, STRING_BYTES = 128 << 20, 250
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """The text as it is searched; brute force and SQL do the same."""
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", (text or "").lower()).strip(" ")


def test_strings(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[bytes, list[int]]:
    """Test string, with a space on either side -> numbers of the items that have it."""
    out: dict[bytes, list[int]] = defaultdict(list)
    for n, (_, text) in enumerate(items):
        w = normalise(text).split(" ")
        if w != [""]:
            for s in {" ".join(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}:
                out[f" {s} ".encode()].append(n)
    return dict(out)


class WuManber:
    """Tables of the given byte strings, one for each class of lengths: a short string shortens the shifts of its own class only."""

    def __init__(self, patterns: list[bytes]) -> None:
        classes: dict[int, list[int]] = defaultdict(list)
        for n, p in enumerate(patterns):
            classes[min(len(p), 64).bit_length()].append(n)
        self.tables = [(Table([patterns[n] for n in own]), own) for own in classes.values()]

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence in the bytes."""
        for table, own in self.tables:
            for start, k in table.search(text):
                yield start, own[k]


class Table:
    """Shift and bucket tables of byte strings."""

    def __init__(self, patterns: list[bytes]) -> None:
        self.patterns = patterns
        self.least = min(map(len, patterns))
        self.block = min(BLOCK, self.least)
        self.bits = max(12, int(np.ceil(np.log2(1 + len(patterns) * max(1, self.least - self.block + 1)))) + 3)
        far = self.least - self.block + 1
        self.shift = np.full(1 << self.bits, far, dtype=np.int32)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), dtype=np.uint8).reshape(len(patterns), self.least)
        for end in range(self.block, self.least + 1):
            np.minimum.at(self.shift, self._hash_rows(heads[:, end - self.block : end]), self.least - end)
        self.bucket: dict[int, list[int]] = defaultdict(list)
        for n, h in enumerate(self._hash_rows(heads[:, self.least - self.block :]).tolist()):
            self.bucket[h].append(n)
        self.bucket = dict(self.bucket)

    def _hash_rows(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), 8), dtype=np.uint8)
        wide[:, : self.block] = rows
        return self._hash(wide.view("<u8").reshape(-1))

    def _hash(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence in the bytes."""
        n, m = len(text), self.least
        if n < m:
            return
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        blocks = np.ndarray(shape=(n,), dtype="<u8", buffer=padded, strides=(1,))
        cover = np.uint64((1 << 8 * self.block) - 1)
        # a lane has the windows that start in it; a cursor is a window's start
        at = np.arange(0, n - m + 1, LANE)
        to = np.minimum(at + LANE, n - m + 1)
        while len(at):
            h = self._hash(blocks[at + (m - self.block)] & cover)
            step = self.shift[h]
            for start, bucket in zip(at[step == 0].tolist(), h[step == 0].tolist()):
                for k in self.bucket.get(bucket, ()):
                    p = self.patterns[k]
                    if padded[start : start + len(p)].tobytes() == p:
                        yield start, k
            at = at + np.maximum(step, 1)
            more = at < to
            at, to = at[more], to[more]


def _flatten(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with each run of separators as one space, a space on either side of each text and a zero between texts; where each text starts."""
    n = len(offsets) - 1
    inside = WORD_BYTE[raw]
    keep = inside.copy()
    if len(raw):
        keep[1:] |= inside[:-1] & ~inside[1:]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[starts] = inside[starts]
    counts = np.concatenate([[0], np.cumsum(keep)])
    lengths = counts[offsets[1:]] - counts[offsets[:-1]]
    out = np.full(int(lengths.sum()) + 3 * n, 32, dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths + 3)])
    place = np.arange(int(lengths.sum())) + np.repeat(begin[:-1] + 1 - (np.cumsum(lengths) - lengths), lengths)
    out[place] = np.where(inside, raw, 32)[keep]
    out[begin[1:] - 1] = 0
    return out, begin


def _hits(column: pa.Array, engine: WuManber) -> Iterator[tuple[int, int, int]]:
    """(row, start within the normalised text, pattern number)."""
    raw, offsets = utf8(column, lower=True)
    i, n = 0, len(offsets) - 1
    while i < n:
        # whole texts of about 1 MB at a time; one text above that by itself
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), side="right")) - 1)
        flat, begin = _flatten(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for start, k in engine.search(flat):
            row = int(np.searchsorted(begin, start, side="right")) - 1
            yield i + row, start - int(begin[row]), k
        i = j


def _passes(benchmark: DataFrame, item_key: str, item_text: str, table_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in parts of bounded size: a benchmark above it takes several passes instead of one large broadcast."""
    rows = pick(benchmark, item=item_key, text=item_text).filter("text is not null")
    # a string begins at each word and has WINDOW of them
    total = rows.agg(F.sum(F.size(F.split("text", " ")) * (STRING_BYTES + WINDOW * F.octet_length("text") / F.size(F.split("text", " "))))).first()[0] or 0
    parts = max(1, math.ceil(total / table_bytes))
    for k in range(parts):
        part = [tuple(r) for r in (rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == k) if parts > 1 else rows).collect()]
        if any(normalise(t) for _, t in part):
            yield part


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For each row of docs and item with test strings in common: the document's id, the item's, and how many of the item's different strings occur."""
    rows = pick(docs, key=key, text=text)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item_key, benchmark.schema[item_key].dataType), T.StructField("n_strings", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for part in _passes(benchmark, item_key, item_text, table_bytes):
        strings = test_strings(part, window)
        engine, owners, names = docs.sparkSession.sparkContext.broadcast(WuManber(list(strings))), list(strings.values()), [a for a, _ in part]

        def run(batches: Iterator[pa.RecordBatch], engine=engine, owners=owners, names=names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found: dict[tuple[int, int], set[int]] = defaultdict(set)
                for row, _, k in _hits(batch.column(1), engine.value):
                    for item in owners[k]:
                        found[row, item].add(k)
                if found:
                    at = pa.array([r for r, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([names[i] for _, i in found]), pa.array([len(s) for s in found.values()], pa.int64())], names=[key, item_key, "n_strings"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def _is_clean(docs: DataFrame, tables: WuManber):
    engine = docs.sparkSession.sparkContext.broadcast(tables)

    @F.arrow_udf(T.BooleanType())
    def clean(column: pa.Array) -> pa.Array:
        ok = np.ones(len(column), dtype=bool)
        for row, _, _ in _hits(column, engine.value):
            ok[row] = False
        return pa.array(ok)

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows that contain a test string; all columns of docs."""
    need(docs, text)
    rows, at = by_place(docs)
    for part in _passes(benchmark, item_key, item_text, table_bytes):
        rows = rows.filter(_is_clean(docs, WuManber(list(test_strings(part, window))))(F.col(at[text])))
    return rows.toDF(*docs.columns)
