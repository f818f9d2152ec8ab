"""What the operators of this subpackage share: checkpoints, size checks, samples, columns whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.storage import materialised, shared_dir

__all__ = ["OWN", "by_place", "cut", "hashed", "need", "one_text", "pick", "sample_by_hash", "shared_dir", "small"]

#: Prefix of the columns that operators add for themselves and drop again.
OWN = "__quern_"

#: A side is broadcast up to so many bytes, as a hash table has them; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row of fixed-width columns in such a table, besides 8 for each column.
ROW_BYTES = 48

#: The data once computed and kept in the shared folder: what follows survives lost executors and doesn't compute it again.
cut = materialised


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (cut before, so that it can be measured), with a broadcast hint if it takes at most that many bytes; else without, for a shuffled join."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    size = F.lit(float(ROW_BYTES + 8 * len(df.columns))) + sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by their places, and the new names of the old ones: names with dots, or that differ in case only, are nothing special."""
    places = [f"{OWN}{n}" for n in range(len(df.columns))]
    return df.toDF(*places), dict(zip(df.columns[::-1], places[::-1]))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Those columns of df under the given names, found by their exact names (of several of one name the first)."""
    need(df, *columns.values())
    rows, at = by_place(df)
    return rows.select(*(F.col(at[c]).alias(name) for name, c in columns.items()))


def hashed(*columns: str | Column) -> Column:
    """A number that orders rows at random, always the same way."""
    return F.xxhash64(F.lit(7919), *columns)


def sample_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of df whose key is among the `rows` smallest by hash: a sample that is the same on every run.

    The threshold is found from the key column alone; the wide columns are read for the sampled rows only. Repeated
    keys take places among the `rows`, and all of their rows are returned: `one_text` leaves one of each.
    """
    h = hashed(F.col(key))
    top = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.filter(h <= F.lit(top)) if top is not None else df.limit(0)


def one_text(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, text): of rows of equal keys the text with the smallest hash, so that a sample of keys is one of rows; merged before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(text, F.xxhash64(text)).alias(text))
