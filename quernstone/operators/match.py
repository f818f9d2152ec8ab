"""Which terms of the dictionary a query token matches.

Tokens are few and known when the plan is made, so they go into it as literals: Parquet then
prunes row groups by `=`, `IN` and `startsWith`, and no join with the tokens is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, PREFIX, DOCUMENTED, TREE = "exact", "prefix", "documented", "tree"


def exact(term: Column, token: str) -> Column:
    return term == token


def prefix(term: Column, token: str) -> Column:
    return term.startswith(F.lit(token))


def fuzzy(term: Column, token: str, tolerance: int) -> Column:
    """Terms within the tolerance, in characters; the lengths are compared first."""
    return F.length(term).between(max(0, len(token) - tolerance), len(token) + tolerance) & (F.levenshtein(term, F.lit(token), tolerance) >= 0)


def conditions(term: Column, tokens: list[str], mode: str, tolerance: int = 0) -> list[Column]:
    """For each token, whether the term may match it; in the mode `tree` a term below the right prefix does."""
    if mode == EXACT:
        return [exact(term, t) for t in tokens]
    if mode == PREFIX:
        return [prefix(term, t) for t in tokens]
    return [fuzzy(term, t, tolerance) for t in tokens]


def tree_prefixes(terms: DataFrame, tokens: list[str]) -> DataFrame:
    """(prop, token, head): below which prefix of the compressed prefix tree of the terms a tolerant search looks for candidates.

    terms: prop, term; of those that begin as no token does none is needed. No row where there are no candidates. The
    tree's nodes are the empty string, the terms, and the prefixes behind which terms part. With L the longest beginning
    of the token that a term has: if it is the whole token, it is the prefix; if it is a node, there is no such branch,
    so nothing; else the longest node above it. A shorter beginning is a node just if some term has no more than that
    in common with the token; so of all terms only these lengths are needed, a few rows a property and token.
    """
    common = F.array(*(F.struct(F.lit(t).alias("token"), sum((prefix(F.col("term"), t[:n]).cast("int") for n in range(1, len(t) + 1)), F.lit(0)).alias("n")) for t in tokens))
    rows = terms.select("prop", "term", F.inline(common)).filter("n > 0")
    following = F.when(F.length("term") > F.col("n"), F.substring("term", F.col("n") + 1, F.lit(1)))
    lengths = rows.groupBy("prop", "token", "n").agg((F.max(following.isNull()) | F.coalesce(F.min(following) != F.max(following), F.lit(False))).alias("node"))
    lengths = lengths.groupBy("prop", "token").agg(F.max(F.struct("n", "node")).alias("last"), F.sort_array(F.collect_list("n"), asc=False).alias("n"))
    head = F.when(F.col("last.n") == F.length("token"), F.col("token")).when(~F.col("last.node"), F.substring(F.col("token"), F.lit(1), F.coalesce(F.get("n", 1), F.lit(0))))
    return lengths.select("prop", "token", head.alias("head")).filter("head is not null")


def matches(table: DataFrame, tokens: list[str], mode: str, tolerance: int = 0, terms: DataFrame | None = None) -> DataFrame:
    """table (with prop and term) with a column `token`: a row for each token that the row's term matches.

    terms: prop and term of the whole dictionary, for the mode `tree`.
    """
    term = F.col("term")
    if not tokens:
        return table.limit(0).withColumn("token", term)
    if mode == EXACT:
        return table.filter(term.isin(tokens)).withColumn("token", term)
    own = dict(zip(tokens, conditions(term, tokens, mode, tolerance)))
    which = F.filter(F.array(*(F.when(c, F.lit(t)) for t, c in own.items())), lambda x: x.isNotNull())
    found = table.filter(reduce(Column.__or__, own.values())).withColumn("token", F.explode(which))
    if mode != TREE:
        return found
    # tokens x properties rows
    below = F.broadcast(tree_prefixes(table.select("prop", "term") if terms is None else terms, tokens).withColumnRenamed("token", "of"))
    return found.join(below.withColumnRenamed("prop", "in"), (F.col("prop") == F.col("in")) & (F.col("token") == F.col("of")) & term.startswith(F.col("head"))).select(*table.columns, "token")
