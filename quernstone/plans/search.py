"""Search as one lazy plan: match, collapse, score, add up, order.

Postings go to partitions by document once; the collapse by token and the sum by document both
use that. For whole-token matches there is nothing to collapse. The page is cut by Spark's top-k
operator, and only its documents are looked up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scoring import DEFAULT_RELEVANCE, Relevance, bm25, page_bounds
from quernstone.operators import match
from quernstone.operators.index import Index, field_stats, term_stats
from quernstone.storage import materialised

#: Hits of a page are joined with the documents by broadcast up to so many, of an id and a score each; ids are taken for 100 bytes at most.
PAGE_BROADCAST = 10_000


def mode_of(exact: bool, tolerance: int, tolerance_mode: str) -> str:
    if exact:
        return match.EXACT
    return tolerance_mode if tolerance > 0 else match.PREFIX


def matching_index(analysed: DataFrame, tokens: list[str], mode: str, tolerance: int = 0) -> Index:
    """The part of an index that a search for these tokens needs, of documents that have none; computed in one pass without a shuffle.

    analysed: id, prop, tokens. Of each field its length is kept and its tokens that may match; only these are
    made postings. The tree mode needs of the dictionary the terms that begin as a token does; these are kept besides.
    """
    if not tokens:
        kept = F.filter("tokens", lambda t: F.lit(False))
    else:
        # a query token itself counts for the document frequency, whatever the mode
        kept = F.filter("tokens", lambda t: reduce(lambda a, b: a | b, [t.isin(tokens), *match.conditions(t, tokens, mode, tolerance)]))
    near = []
    if mode == match.TREE and tokens:
        near = [F.array_distinct(F.filter("tokens", lambda t: F.substring(t, 1, 1).isin(sorted({x[:1] for x in tokens})))).alias("near")]
    rows = materialised(analysed.select("id", "prop", F.size("tokens").alias("len"), kept.alias("kept"), *near))
    # in the row itself: a field has few tokens that match
    counted = F.transform(F.array_distinct("kept"), lambda t: F.struct(t.alias("term"), F.size(F.filter("kept", lambda u: u == t)).alias("n")))
    postings = rows.filter(F.size("kept") > 0).select("id", "prop", "len", F.inline(counted)).select("prop", "term", "id", (F.col("n") / F.col("len")).alias("tf"), "len")
    lengths = rows.select("id", "prop", "len")
    terms = rows.select("prop", F.explode("near").alias("term")).distinct() if near else None
    return Index(lengths, postings, term_stats(postings), field_stats(lengths), terms)


def scores(index: Index, tokens: list[str], properties: list[str], mode: str = match.PREFIX, tolerance: int = 0, relevance: Relevance = DEFAULT_RELEVANCE) -> DataFrame:
    """(id, score) of every document that a token matches. A property that is named twice counts twice."""
    tokens = list(dict.fromkeys(tokens))
    names = sorted(set(properties))
    own = F.col("prop").isin(names)
    dictionary = index.term_stats if index.dictionary is None else index.dictionary
    hits = match.matches(index.postings.filter(own), tokens, mode, tolerance, dictionary.filter(own).select("prop", "term"))
    if mode != match.EXACT:
        # of several terms of a document that match a token the last by name counts
        hits = hits.repartition("id").groupBy("id", "prop", "token").agg(F.max_by(F.struct("tf", "len"), "term").alias("m")).select("id", "prop", "token", "m.tf", "m.len")
    # df is that of the token itself: 0 if it isn't a term. At most tokens x properties rows.
    known = index.term_stats.filter(own & F.col("term").isin(tokens)).select("prop", F.col("term").alias("token"), "df")
    hits = hits.join(F.broadcast(known), ["prop", "token"], "left").join(F.broadcast(index.field_stats), "prop")
    times = reduce(lambda c, p: c.when(F.col("prop") == p, float(properties.count(p))), names, F) if len(names) < len(properties) else F.lit(1.0)
    score = bm25(F.col("tf"), F.coalesce("df", F.lit(0)), F.col("len"), F.col("avg_len"), F.col("n_docs"), relevance) * times
    return hits.groupBy("id").agg(F.sum(score).alias("score"))


def page(scored: DataFrame, offset: int = 0, limit: int = 10, digits: int | None = None) -> DataFrame:
    """The hits from offset on, by score and then id. digits: scores are rounded before they are compared."""
    page_bounds(offset, limit, 0)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def with_documents(hits: DataFrame, documents: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Hits with the documents' columns as `data`; hits without a document are left out."""
    data = documents.select(F.col(id_col).alias("id"), F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != id_col)).alias("data"))
    side = F.broadcast(hits) if limit <= PAGE_BROADCAST else hits
    return data.join(side, "id").select("id", "data", "score").orderBy(F.desc("score"), "id")
