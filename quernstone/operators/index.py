"""The inverted index as tables.

    documents      id, lang and the original columns
    fields         id, prop, lang, text          (one row for each searchable property of a document)
    field_lengths  id, prop, len
    postings       prop, term, id, tf, len       (tf: share of the field's tokens)
    term_stats     prop, term, df
    field_stats    prop, avg_len, n_docs

A document's tokens are counted in its own row, so that nothing is shuffled for postings but fields
whose id is repeated, and for term_stats only terms with their counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import PropertyNotSearchable
from quernstone.functions.analyzer import analyze_by
from quernstone.storage import materialised, stored

#: Ids are broadcast up to so many bytes, as a hash table has them; beyond it the join is shuffled. What an id takes there besides itself.
BROADCAST_BYTES = 64 << 20
ID_BYTES = 56


def string_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all string columns, nested ones too, by name."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += string_paths(f.dataType, f"{path}.")
        elif isinstance(f.dataType, T.StringType):
            out.append(path)
    return sorted(out)


def column(path: str) -> F.Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def check_properties(schema: T.StructType, properties: list[str]) -> list[str]:
    known = set(string_paths(schema))
    for p in properties:
        if p not in known:
            raise PropertyNotSearchable(p)
    return list(properties)


def flatten(documents: DataFrame, properties: list[str], id_col: str = "id", lang_col: str = "lang") -> DataFrame:
    """(id, prop, lang, text): a row for each document and property. A missing text is an empty one."""
    # an exploded array of the texts: one pass over the documents, whatever the number of properties
    texts = F.array(*(F.struct(F.lit(p).alias("prop"), F.coalesce(column(p), F.lit("")).alias("text")) for p in properties))
    return documents.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.explode(texts).alias("f")).select("id", "f.prop", "lang", "f.text")


@dataclass(frozen=True)
class Analysis:
    stemming: bool = True
    stop_words: bool = True


def tokenized(fields: DataFrame, languages: list[str], analysis: Analysis) -> DataFrame:
    """(id, prop, tokens) with repeats."""
    tokens = analyze_by(F.col("text"), F.col("lang"), languages, stemming=analysis.stemming, stops=analysis.stop_words)
    return fields.select("id", "prop", tokens.alias("tokens"))


def field_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("id", "prop", F.size("tokens").alias("len"))


def counted_in_rows(rows: DataFrame, keys: list[str], ends: bool = False) -> DataFrame:
    """(keys, term, n) of rows of keys and an array `tokens`: how often each token is in the row. ends: and for each row one without a term."""
    rows = rows.select(*keys, F.sort_array("tokens").alias("tokens"))
    size, zero = F.size("tokens"), F.array(F.lit(0))
    # where another token begins, and the end
    others = F.when(size > 1, F.filter(F.sequence(F.lit(1), size - 1), lambda i: F.get("tokens", i) != F.get("tokens", i - 1))).otherwise(F.array().cast("array<int>"))
    places = F.when(size > 0, F.concat(zero, others, F.array(size))).otherwise(zero)
    # outer, else Spark computes the array once more to leave out empty ones
    rows = rows.select(*keys, "tokens", places.alias("places")).select(*keys, "tokens", "places", F.posexplode_outer("places").alias("k", "at"))
    rows = rows if ends else rows.filter(F.col("at") < size)
    return rows.select(*keys, F.get("tokens", F.col("at")).alias("term"), (F.get("places", F.col("k") + 1) - F.col("at")).cast("long").alias("n"))


def repeated_ids(ids: DataFrame) -> DataFrame | None:
    """The ids (one column) that several rows have; None if there is none."""
    out = materialised(ids.groupBy(*ids.columns).count().filter("count > 1").drop("count"))
    return None if out.isEmpty() else few(out)


def few(ids: DataFrame) -> DataFrame:
    """ids (one column, materialised), with a broadcast hint if they take `BROADCAST_BYTES` at most."""
    own = F.octet_length(F.col(f"`{ids.columns[0]}`").cast("string"))
    return F.broadcast(ids) if (ids.agg(F.sum(F.coalesce(own, F.lit(0)) + ID_BYTES)).first()[0] or 0) <= BROADCAST_BYTES else ids


def counted(rows: DataFrame, keys: list[str], repeated: DataFrame | None) -> DataFrame:
    """(keys, term, n): how often each token is in the rows of equal keys; the first key is the id, and repeated has those of several rows."""
    if repeated is None:
        return counted_in_rows(rows, keys)
    again = repeated.toDF("__again")
    same = F.col(keys[0]).eqNullSafe(F.col("__again"))
    several = rows.join(again, same, "left_semi").select(*keys, F.explode_outer("tokens").alias("term")).filter("term is not null")
    return counted_in_rows(rows.join(again, same, "left_anti"), keys).unionByName(several.groupBy(*keys, "term").agg(F.count("*").alias("n")))


def token_counts(tokens: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(id, prop, len, term, n): how often each token occurs in a field."""
    return counted(tokens.select("id", "prop", F.size("tokens").alias("len"), "tokens"), ["id", "prop", "len"], repeated)


def postings(tokens: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """repeated: as `repeated_ids` has it."""
    return _frequencies(token_counts(tokens, repeated))


def _frequencies(counts: DataFrame) -> DataFrame:
    return counts.select("prop", "term", "id", (F.col("n") / F.col("len")).alias("tf"), "len")


def stored_postings(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """postings and field_lengths of fields of different ids, both from one pass over them, in the shared folder."""
    both = tokens.select("id", "prop", F.size("tokens").alias("len"), "tokens")
    both = stored(_frequencies(counted_in_rows(both, ["id", "prop", "len"], ends=True)))
    return both.filter("term is not null"), stored(both.filter("term is null").select("id", "prop", "len"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("prop", "term").agg(F.count("*").alias("df"))


def field_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("prop").agg(F.avg("len").alias("avg_len"), F.count("*").alias("n_docs"))


def dictionary_sizes(stats: DataFrame) -> DataFrame:
    """(prop, terms): different terms of each property."""
    return stats.groupBy("prop").agg(F.count("*").alias("terms"))


@dataclass
class Index:
    """dictionary: (prop, term) of all terms that a tolerant search needs, where term_stats hasn't these; else None."""

    lengths: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    dictionary: DataFrame | None = None

    @classmethod
    def build(cls, fields: DataFrame, languages: list[str], analysis: Analysis, keep: bool = True, repeated: DataFrame | None = None) -> Index:
        """keep: whether postings and lengths are computed now, once, in the shared folder. repeated: ids of several documents, if there are any."""
        tokens = tokenized(fields, languages, analysis)
        if keep and repeated is None:
            return cls.of(*stored_postings(tokens))
        post, lengths = postings(tokens, repeated), field_lengths(tokens)
        return cls.of(stored(post), stored(lengths)) if keep else cls.of(post, lengths)

    @classmethod
    def of(cls, post: DataFrame, lengths: DataFrame) -> Index:
        return cls(lengths, post, term_stats(post), field_stats(lengths))

    def without(self, ids: DataFrame) -> Index:
        """ids: one column, id."""
        return Index.of(self.postings.join(ids, "id", "left_anti"), self.lengths.join(ids, "id", "left_anti"))

    def plus(self, other: Index) -> Index:
        return Index.of(self.postings.unionByName(other.postings), self.lengths.unionByName(other.lengths))

    def write(self, folder: str, properties: list[str] | None = None) -> None:
        """Postings by property and sorted by term, so that a search reads the row groups of its terms only. properties: all there are, if they are known."""
        spark = self.postings.sparkSession
        properties = properties or [r[0] for r in self.lengths.select("prop").distinct().collect()]
        _write_sorted(self.postings, properties, f"{folder}/postings")
        # written first: what follows is computed from the files
        _write_sorted(term_stats(spark.read.parquet(f"{folder}/postings")), properties, f"{folder}/term_stats")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/field_lengths")
        self.field_stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/field_stats")

    @classmethod
    def read(cls, spark: SparkSession, *folders: str) -> Index:
        """Of several folders, each with the postings of other documents, as one; the last has the field_stats of all."""
        one = {name: reduce(DataFrame.unionByName, (spark.read.parquet(f"{f}/{name}").select(*columns) for f in folders)) for name, columns in _TABLES.items()}
        stats = one["term_stats"] if len(folders) == 1 else one["term_stats"].groupBy("prop", "term").agg(F.sum("df").alias("df"))
        return cls(one["field_lengths"], one["postings"], stats, spark.read.parquet(f"{folders[-1]}/field_stats"))


_TABLES = {"field_lengths": ("id", "prop", "len"), "postings": ("prop", "term", "id", "tf", "len"), "term_stats": ("prop", "term", "df")}


def _write_sorted(table: DataFrame, properties: list[str], folder: str) -> None:
    """As `partitionBy("prop")` does, a property at a time: rows are sorted by the term alone, whose first bytes decide most comparisons."""
    escaped = table.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for p in properties:
        own = table.filter(F.col("prop") == p).drop("prop")
        own.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/prop={escaped(p)}")
