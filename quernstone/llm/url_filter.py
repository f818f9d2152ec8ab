"""URL filters: a trie over reversed host labels and path segments.

An entry is a host, which stands for its subdomains too, with or without the beginning of
a path in whole segments: `example.org`, `blog.example.org/shop`. Of the entries that match
a URL the longest decides: the one with most host labels, of these the one with most path
segments; if the same entry is in both lists, block. The trie is broadcast. Lists whose trie
may take more than MAX_BYTES aren't: then every URL's host suffixes and path beginnings are joined with them.

Defined results:
- `decision` is allow or block, or what `default` says where no entry matches (`entry` is null then).
- A URL without a scheme and host, or a null one, has a null decision.
- A host in brackets (an IPv6 address) is one label. URLs and paths may be of any length.
- Scheme, user, port, query, fragment, empty segments, a final dot of the host and the case of the host don't matter.
- Ids may repeat, as rows may; every row gets a decision. An empty table or list is fine. Other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.runtime import OWN, pick

#: Largest trie that is broadcast, and what a node of it takes at most besides its label: a list, two dictionaries and their slots.
MAX_BYTES, NODE_BYTES = 64 << 20, 600

#: Lists that the query uses; a deployment gives its own.
ENTRIES = (
    ("spam-farm.example.org", "block"),
    ("cheap-pills.example.com", "block"),
    ("casino-win.example.com", "block"),
    ("casino-win.example.com/de", "allow"),
    ("m.casino-win.example.com/de", "block"),
    ("blog.example.net", "block"),
    ("example.net/es", "allow"),
    ("therea.example.net", "block"),
    ("therea.example.net/en", "allow"),
    ("blog.tionsh.example.com/fr", "block"),
    ("example.org/de", "block"),
    ("www.therti.example.org", "allow"),
)

_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)(?::\d*)?(/[^?#]*)?")


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """Reversed host labels and path segments."""
    m = _URL.match(url or "")
    host = m[1].lower() if m else ""
    labels = [host] if host.startswith("[") else [x for x in host.split(".") if x]
    return (labels[::-1], [s for s in (m[2] or "").split("/") if s]) if labels else None


def entry_parts(entry: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    host, _, path = entry.partition("/")
    return tuple(x for x in reversed(host.lower().split(".")) if x), tuple(s for s in path.split("/") if s)


class Trie:
    """A node is [children by label, children by segment, (decision, entry)]."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        self.root: list = [{}, {}, None]
        for entry, decision in entries:
            node = self.root
            labels, segments = entry_parts(entry)
            for x in labels:
                node = node[0].setdefault(x, [{}, {}, None])
            for x in segments:
                node = node[1].setdefault(x, [{}, {}, None])
            if node[2] is None or (decision == "block") > (node[2][0] == "block"):
                node[2] = (decision, ".".join(reversed(labels)) + "".join(f"/{s}" for s in segments))

    def decide(self, labels: list[str], segments: list[str]) -> tuple[str, str] | None:
        node, best = self.root, None
        for x in labels:
            node = node[0].get(x)
            if node is None:
                break
            own, below = node[2], node
            for s in segments:
                below = below[1].get(s)
                if below is None:
                    break
                own = below[2] or own
            best = own or best
        return best


def _schema(pages: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("decision", T.StringType()), T.StructField("entry", T.StringType())])


def decisions(pages: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(key, decision, entry) for every row of pages. entries: columns entry and decision."""
    rows = pick(pages, key=key, url=url)
    entries = pick(entries, entry="entry", decision="decision").filter("entry is not null and decision in ('allow', 'block')")
    nodes = F.size(F.split("entry", "[./]")) * NODE_BYTES + 2 * F.octet_length("entry")
    if (entries.agg(F.sum(nodes)).first()[0] or 0) > max_bytes:
        return _joined(rows, entries, key, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in entries.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            found = [trie.value.decide(*p) if p else None for p in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(f[0] if f else default) if p else None for f, p in zip(found, split)], pa.string()), pa.array([f and f[1] for f in found], pa.string())], names=[key, "decision", "entry"])

    return rows.mapInArrow(run, _schema(pages, key))


def _joined(pages: DataFrame, entries: DataFrame, key: str, default: str) -> DataFrame:
    """The same by a join: each URL with the entries that could match it: of no more labels and segments than any entry has, so that long URLs are no matter."""
    most = entries.select(F.max(F.size(F.split("entry", "/"))), F.max(F.size(F.split(F.substring_index("entry", "/", 1), "[.]")))).first()
    deepest, widest = (most[0] or 1) - 1, most[1] or 0

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [parts(u) for u in batch.column(2).to_pylist()]
            own = [[(f"{'.'.join(reversed(p[0][:i]))}{''.join(f'/{s}' for s in p[1][:j])}", i, j) for i in range(1, min(len(p[0]), widest) + 1) for j in range(min(len(p[1]), deepest) + 1)] if p else [("", 0, 0)] for p in split]
            rows = pa.array([n for n, f in enumerate(own) for _ in f], pa.int64())
            flat = [x for f in own for x in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32())))], names=["row", "key", "form", "labels", "segments"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [entry_parts(e) for e in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([".".join(reversed(a)) + "".join(f"/{s}" for s in b) for a, b in both], pa.string()), batch.column(1)], names=["form", "decision"])

    # rows are told apart by what they hold: equal rows get equal decisions
    rows = pages.groupBy("key", "url").agg(F.count("*").alias("n"))
    spread = rows.select(F.struct("key", "url").alias("row"), "key", "url").mapInArrow(forms, T.StructType([T.StructField("row", T.StructType([T.StructField("key", pages.schema["key"].dataType), T.StructField("url", T.StringType())])), T.StructField("key", pages.schema["key"].dataType), T.StructField("form", T.StringType()), T.StructField("labels", T.IntegerType()), T.StructField("segments", T.IntegerType())]))
    known = entries.mapInArrow(plain, T.StructType([T.StructField("form", T.StringType()), T.StructField("decision", T.StringType())])).groupBy("form").agg(F.max("decision").alias("decision"))
    best = spread.join(known, "form", "left").groupBy("row").agg(F.max(F.when(F.col("decision").isNotNull(), F.struct("labels", "segments", "decision", "form"))).alias("best"), F.max("labels").alias("labels"))
    decided = best.select(F.col("row.key").alias("k"), F.col("row.url").alias("u"), F.when(F.col("labels") > 0, F.coalesce("best.decision", F.lit(default))).alias("decision"), F.col("best.form").alias("entry"))
    joined = rows.join(decided, F.col("key").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")))
    return joined.withColumn(f"{OWN}n", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(F.col("key").alias(key), "decision", "entry")


def default_entries(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(ENTRIES), "entry string, decision string")
