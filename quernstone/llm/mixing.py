"""Mixing sources to target weights by pivotal dependent rounding.

A source's expected copies of each of its documents are `total * weight / documents`.
The whole part is given to each document; the fractional parts are rounded by the pivotal
method: two of them exchange mass at random until one is 0 or 1, and the other goes on.
A partition does so with its documents of a source, one after the other, and is left with
one fraction at most. These residuals meet in groups of FAN_IN, those of the groups again,
until one task has what is left of a source. So every document gets the whole number below
or above its expectation, with the right probability, and each source gets its target number
of copies to within one. The random numbers are hashes of ids: a task that runs again decides alike.

Defined results:
- A unit is an id and source; `rows` of them in docs have that many times the mass, and
  copies are spread over such repeated rows evenly, those that are left over by the rows' hashes. A null id or source is one like any other.
- A source without a weight, or with 0, gets no copies; a weight without documents is ignored.
- An empty table, or no positive weight, gives an empty result.
- A column `copies` in docs is replaced; others are carried along whatever their names are and however long. Names that begin with `__quern_` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernstone.llm.runtime import OWN, by_place, cut, hashed, pick, small

#: Weights are documents ** ALPHA where none are given: small sources count for more than their share.
ALPHA = 0.5
FAN_IN = 32
#: Fractions nearer than this to 0 or 1 are taken as such.
TINY = 1e-9


def pivotal(fractions: list[float], random: list[float], carried: tuple[int, float] | None) -> tuple[list[float], tuple[int, float] | None]:
    """Rounds fractions one after the other. carried: place and fraction of the one that goes on; so the last to go on is returned.

    The result has 0.0 or 1.0 for those that are decided and the fraction that came for
    the one that goes on. A carried place below 0 is one of an earlier call.
    """
    out = list(fractions)
    for n, (p, u) in enumerate(zip(fractions, random)):
        if p <= TINY or p >= 1 - TINY:
            out[n] = float(round(p))
            continue
        if carried is None:
            carried = (n, p)
            continue
        place, q = carried
        mass = p + q
        if mass < 1 - TINY:  # one of the two gets all, the other nothing
            won = u * mass < p
            lose, go = (place, n) if won else (n, place)
            out[lose] = 0.0
            carried = (go, mass)
        elif mass > 1 + TINY:  # one of the two gets 1, the other the rest
            first = u * (2 - mass) < 1 - p
            win, go = (place, n) if first else (n, place)
            out[win] = 1.0
            carried = (go, mass - 1)
        else:
            out[n], out[place] = (1.0, 0.0) if u < p else (0.0, 1.0)
            carried = None
    return out, carried


def with_columns(batch: pa.RecordBatch, **values: list[float] | np.ndarray) -> pa.RecordBatch:
    """batch with other numbers in the columns named, its schema as it was."""
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else c for f, c in zip(batch.schema, batch.columns)], schema=batch.schema)


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounds the column `fraction` within runs of equal `run`; `open` is the fraction of the one left over of each run.

    A unit that goes on may lie in an earlier batch than the one that decides it; its row is held back until then.
    """
    held: pa.RecordBatch | None = None  # the one row that is carried
    run, carried = None, None

    def made(batch: pa.RecordBatch, decided: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
        return with_columns(batch, fraction=decided, open=left)

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        runs = batch.column("run").to_numpy(zero_copy_only=False)
        fractions, random = batch.column("fraction").to_numpy().copy(), batch.column("random").to_numpy()
        decided, left = fractions.copy(), np.zeros(len(runs))
        bounds = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1, [len(runs)]])
        skip = None
        for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            out, carried = pivotal(fractions[i:j].tolist(), random[i:j].tolist(), None)
            decided[i:j] = out
            if carried is not None:
                if j == len(runs):
                    skip = (i + carried[0], carried[1])
                else:
                    decided[i + carried[0]], left[i + carried[0]] = 0.0, carried[1]
        held = None
        if skip is not None:
            held = with_columns(batch.slice(skip[0], 1), fraction=[skip[1]])
            keep = pa.array(np.delete(np.arange(len(runs)), skip[0]))
            yield made(batch.take(keep), np.delete(decided, skip[0]), np.delete(left, skip[0]))
        else:
            yield made(batch, decided, left)
    if held is not None:
        yield made(held, np.zeros(1), held.column("fraction").to_numpy())


def copies(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """(key, source, rows, copies) for each id and source: how many rows it has in docs, and how many copies it gets in all.

    weights: of sources, in any unit; None: documents ** ALPHA of each. total: copies of all
    sources together; None: as many as leave no source with less than one copy of each document on average.
    """
    spark = docs.sparkSession
    units = cut(pick(docs, key=key, source=source).groupBy("key", "source").agg(F.count("*").alias("rows")))
    sizes = units.groupBy("source").agg(F.sum("rows").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(ALPHA)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], T.StructType([T.StructField("s", T.StringType()), T.StructField("w", T.DoubleType())]))
        weighed = sizes.join(given, F.col("source").cast("string").eqNullSafe(F.col("s")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = cut(weighed.filter("w > 0"))
    whole, most = weighed.agg(F.sum("w"), F.max(F.col("n") / F.col("w"))).first()
    result = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(source, docs.schema[source].dataType), T.StructField("rows", T.LongType()), T.StructField("copies", T.LongType())])
    if whole is None:
        return spark.createDataFrame([], result)
    scale = most if total is None else total / whole
    rates = weighed.select(F.col("source").alias("of"), (F.lit(float(scale)) * F.col("w") / F.col("n")).alias("rate"))
    mass = F.col("rows") * F.col("rate")
    base = F.floor(mass + F.lit(TINY))
    random = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("u"), "key", "source"), 11).cast("double") + 0.5) / float(1 << 53)
    rated = units.join(small(rates), F.col("source").eqNullSafe(F.col("of"))).select("key", "source", "rows", base.alias("base"), F.greatest(mass - base, F.lit(0.0)).alias("fraction"), random.alias("random"), F.lit(0.0).alias("open"))
    columns = "key source rows base fraction random open".split()

    def level(df: DataFrame, node: F.Column, spread: bool) -> DataFrame:
        """One level of the tree: runs are the units of a source below a node."""
        df = df.withColumn("node", node.cast("long")).withColumn("run", F.xxhash64("source", "node"))
        df = df.repartition("run") if spread else df
        df = df.sortWithinPartitions("run", "source", hashed("key"), "key").select(*columns, "node", "run")
        return cut(df.mapInArrow(_round, T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])))

    now = level(rated, F.spark_partition_id(), False)
    done = [now.filter("open = 0")]
    nodes = (now.agg(F.max("node")).first()[0] or 0) + 1
    for _ in range(math.ceil(math.log(nodes, FAN_IN)) if nodes > 1 else 0):
        now = level(now.filter("open > 0").select(*columns[:4], F.col("open").alias("fraction"), "random", F.lit(0.0).alias("open"), "node"), F.expr(f"node div {FAN_IN}"), True)
        done.append(now.filter("open = 0"))
    # what is left of a source that has no whole number of copies in all
    last = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("last"), "source"), 11).cast("double") + 0.5) / float(1 << 53)
    done.append(now.filter("open > 0").withColumn("fraction", F.when(last < F.col("open"), 1.0).otherwise(0.0)))
    out = done[0].select(*columns)
    for df in done[1:]:
        out = out.union(df.select(*columns))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "rows", (F.col("base") + F.col("fraction").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, total: float | None = None, key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """The rows of docs that get copies, with their number in the column `copies`."""
    k, s, m, c = (f"{OWN}{x}" for x in ("key", "source", "rows", "copies"))
    decided = copies(docs, weights, total, key, source, seed).toDF(k, s, m, c)
    many = cut(decided.filter(F.col(c) > 0))
    names = [c for c in docs.columns if c != "copies"]
    rows, at = by_place(docs)
    rows = rows.select(*(f"{OWN}{n}" for n, c in enumerate(docs.columns) if c != "copies"))
    joined = rows.join(small(many), F.col(at[key]).eqNullSafe(many[k]) & F.col(at[source]).eqNullSafe(many[s]))
    if many.filter(F.col(m) > 1).isEmpty():
        return joined.select(*rows.columns, c).toDF(*names, "copies")
    # copies of repeated rows: the first few get one more
    place = F.row_number().over(Window.partitionBy(k, s).orderBy(F.xxhash64(*rows.columns)))
    more = joined.filter(F.col(m) > 1).withColumn(f"{OWN}place", place)
    extra = F.when(F.col(f"{OWN}place") <= F.col(c) % F.col(m), 1).otherwise(0)
    more = more.select(*rows.columns, (F.expr(f"`{c}` div `{m}`") + extra).alias(c)).filter(F.col(c) > 0)
    return joined.filter(F.col(m) == 1).select(*rows.columns, c).union(more).toDF(*names, "copies")
