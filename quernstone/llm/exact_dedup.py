"""Exact deduplication by Grace hash partitioning.

Hashes are counted first, in each task before they are shuffled: a record whose hash no other has is no copy, and its
content goes nowhere. Of the others each task drops its own copies, so that of a content that a third of all rows have
one record a task is left. Spark's shuffle is then the first partitioning: records go by the hash of their content
to partitions, each sorted by id, so that the first record of a content to arrive is the one that stays. A
task looks every record up in an open-addressing table that compares complete content. When a table is full, records
that aren't in it go to spill files by further bits of the hash, and each file is treated the same way in turn,
until what is left of it fits. Copies of what a table holds are never spilled.

Defined results:
- Content is equal if the bytes are, however long it is; null is one content, and the empty text another.
- Of equal contents the smallest id stays, a null id last; of rows that are equal in both, one.
- Ids may repeat, as rows may; every row counts. An empty table gives an empty result.
- Other columns are carried along whatever their names, dotted or equal but for case; names that begin with `__quern_` are reserved.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import by_place, cut, need, pick, shared_dir, small

#: Bytes of distinct content that one table holds before it spills.
TABLE_BYTES = 128 << 20
FAN_OUT_BITS = 4


class OpenTable:
    """Open addressing with linear probing: hash and complete content -> the id first put in."""

    def __init__(self) -> None:
        self._slots = [-1] * (1 << 10)
        self._hashes: list[int] = []
        self.contents: list[bytes | None] = []
        self.ids: list[object] = []
        self.bytes = 0

    def _grow(self) -> None:
        mask = 2 * len(self._slots) - 1
        slots = [-1] * (mask + 1)
        for n, h in enumerate(self._hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n
        self._slots = slots

    def find(self, h: int, content: bytes | None) -> int:
        """Number of the entry, or the free slot's place as -1 - place."""
        slots, mask = self._slots, len(self._slots) - 1
        at = h & mask
        while (n := slots[at]) >= 0:
            if self._hashes[n] == h and self.contents[n] == content:
                return int(n)
            at = (at + 1) & mask
        return -1 - at

    def put(self, place: int, h: int, content: bytes | None, key: object) -> None:
        self._slots[-1 - place] = len(self.ids)
        self._hashes.append(h)
        self.contents.append(content)
        self.ids.append(key)
        self.bytes += len(content or b"") + 200
        if 2 * len(self.ids) > len(self._slots):
            self._grow()


def _grace(batches: Iterator[pa.RecordBatch], level: int, limit: int, folder: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple[int, object]]]]:
    """For each batch: the rows that stay, and (row, id that stays instead) of the others. The first columns are hash, content and id."""
    table = OpenTable()
    files: dict[int, tuple[str, object, pa.RecordBatchStreamWriter]] = {}
    where = None
    try:
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            contents, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            stay, gone, spilled = [], [], []
            for n, (h, content, own) in enumerate(zip((hashes & 0x7FFFFFFFFFFFFFFF).tolist(), contents, ids)):
                found = table.find(h, content)
                if found >= 0:
                    gone.append((n, table.ids[found]))
                elif table.bytes < limit or level >= 60 // FAN_OUT_BITS:
                    table.put(found, h, content, own)
                    stay.append(n)
                else:
                    spilled.append(n)
            yield batch, stay, gone
            if spilled:
                if where is None:
                    where, root = fs.FileSystem.from_uri(folder)
                    root = f"{root}/grace-{uuid.uuid4().hex}"
                    where.create_dir(root, recursive=True)
                part = (hashes[spilled] >> (62 - FAN_OUT_BITS * (level + 1))) & ((1 << FAN_OUT_BITS) - 1)
                for b in np.unique(part).tolist():
                    if b not in files:
                        out = where.open_output_stream(f"{root}/{b}")
                        files[b] = (f"{root}/{b}", out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")))
                    files[b][2].write_batch(batch.take(pa.array(np.asarray(spilled)[part == b])))
        table = None
        for path, out, writer in files.values():
            writer.close()
            out.close()
        for path, _, _ in files.values():
            with where.open_input_stream(path) as source:
                yield from _grace(iter(pa.ipc.open_stream(source)), level + 1, limit, folder)
            where.delete_file(path)
    finally:
        if where is not None:
            where.delete_dir(root)


def _hash(content: pa.Array) -> list[int]:
    return [h & 0x7FFFFFFFFFFFFFFF for h in content.to_pylist()]


def _merged(batches: Iterator[pa.RecordBatch], limit: int, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """(hash, content, id, others) of the contents of a task: the smallest id, and those of the copies within the task.

    When `limit` bytes of contents are held, others go on by themselves.
    """
    table, hashes, others = OpenTable(), [], []
    names, kind = ["h", "content", "id", "others"], None

    def made(h: list, content: list, ids: list, rest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(content, pa.binary()), pa.array(ids, kind), pa.array(rest, pa.list_(kind))], names=names)

    for batch in batches:
        kind = batch.column(2).type
        single = []
        for raw, h, content, own in zip(batch.column(0).to_pylist(), _hash(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = table.find(h, content)
            if found < 0 and table.bytes < limit:
                table.put(found, h, content, own)
                hashes.append(raw)
                others.append([])
            elif found < 0:
                single.append((raw, content, own, []))
            else:
                first = table.ids[found]
                if own is not None and (first is None or own < first):
                    table.ids[found], own = own, first
                others[found].append(own)
        if single:
            yield made(*map(list, zip(*single)))
    for i in range(0, len(hashes), most):
        j = min(len(hashes), i + most)
        yield made(hashes[i:j], table.contents[i:j], table.ids[i:j], others[i:j])


def _firsts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task that aren't copies of earlier ones; all, once `limit` bytes of contents are held, that aren't copies of these."""
    table = OpenTable()
    for batch in batches:
        stay = []
        for n, (h, content) in enumerate(zip(_hash(batch.column(0)), batch.column(1).to_pylist())):
            found = table.find(h, content)
            if found < 0:
                stay.append(n)
                if table.bytes < limit:
                    table.put(found, h, content, None)
        if stay:
            yield batch if len(stay) == len(batch) else batch.take(pa.array(stay, pa.int64()))


def _repeated(rows: DataFrame) -> DataFrame:
    """(h) of the hashes that several rows have; rows has the column h."""
    return small(cut(rows.select("h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each document whose content another has too and that doesn't stay: its id, and keep_id of the one that stays."""
    rows = pick(docs, content=text, id=key).select(F.xxhash64("content").alias("h"), F.col("content").cast("binary").alias("content"), "id")
    folder, kind = shared_dir(docs.sparkSession), docs.schema[key].dataType
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("id", kind), T.StructField("others", T.ArrayType(kind))])
    merged = rows.join(_repeated(rows), "h", "left_semi").select("h", "content", "id").mapInArrow(lambda batches: _merged(batches, table_bytes), schema)
    # Spark's own partitioning uses another hash (Murmur3) of this one, so all its bits remain for the files.
    routed = merged.repartition("h").sortWithinPartitions(F.col("id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stay, gone in _grace(batches, 0, table_bytes, folder):
            own, others, keep, pairs = batch.column(2).to_pylist(), batch.column(3).to_pylist(), dict(gone), []
            for n in [*stay, *keep]:
                stays = keep.get(n, own[n])
                pairs += [(x, stays) for x in (*others[n], own[n])[: None if n in keep else -1]]
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs[i : i + (1 << 16)]], batch.schema.field("id").type) for k in (0, 1)], names=[key, "keep_id"])

    return routed.mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("keep_id", kind)]))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows whose content a row that stays has; all columns of docs."""
    need(docs, key, text)
    rows, at = by_place(docs)
    rows = rows.withColumn("h", F.xxhash64(at[text]))
    repeated, folder = _repeated(rows), shared_dir(docs.sparkSession)
    single = rows.join(repeated, "h", "left_anti").select(*rows.columns[:-1])
    others = [c for c in rows.columns[:-1] if c not in (at[text], at[key])]
    several = rows.join(repeated, "h", "left_semi").select("h", F.col(at[text]).cast("binary").alias("content"), F.col(at[key]).alias("id"), *others)
    order = F.col("id").asc_nulls_last()
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in several.schema.fields])
    several = several.sortWithinPartitions(order).mapInArrow(lambda batches: _firsts(batches, table_bytes), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, stay, _ in _grace(batches, 0, table_bytes, folder):
            if stay:
                yield batch.select(batch.schema.names[1:]).take(pa.array(stay, pa.int64()))

    kept = several.repartition("h").sortWithinPartitions(order).mapInArrow(run, T.StructType(schema.fields[1:]))
    back = {at[text]: F.col("content").cast(docs.schema[text].dataType), at[key]: F.col("id")}
    return single.union(kept.select(*(back.get(c, F.col(c)).alias(c) for c in rows.columns[:-1]))).toDF(*docs.columns)
