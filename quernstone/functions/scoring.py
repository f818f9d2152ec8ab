"""BM25 with an additive term, edit distance and page bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relevance:
    """Parameters of the score. `DEFAULT_RELEVANCE` is what a request without any gets."""

    k: float = 0.0
    b: float = 0.0
    d: float = 0.0


DEFAULT_RELEVANCE = Relevance(k=1.2, b=0.75, d=0.5)


def bm25(tf: Column, df: Column, length: Column, average: Column, n: Column, relevance: Relevance = DEFAULT_RELEVANCE) -> Column:
    """Score of a document with the share tf of its `length` tokens being the term, which df of n documents have."""
    k, b, d = (F.lit(float(x)) for x in (relevance.k, relevance.b, relevance.d))
    one, half = F.lit(1.0), F.lit(0.5)
    idf = F.log(one + (n.cast("double") - df + half) / (df.cast("double") + half))
    return idf * ((d + tf * (k + one)) / (tf + k * (one - b + b * length / average)))


def bounded_levenshtein(a: Column, b: Column, tolerance: int) -> Column:
    """Edit distance in characters, -1 where it is above the tolerance."""
    return F.levenshtein(a, b, tolerance)


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common beginning, by characters."""
    short = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), short), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.substring(a, F.lit(1), F.array_max(same))


def count_tokens(tokens: Iterable[str]) -> dict[str, int]:
    return dict(Counter(tokens))


def page_bounds(offset: int, limit: int, n: int) -> tuple[int, int]:
    """First and end place of a page in a list of n."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit can't be negative")
    start = min(offset, n)
    return start, min(start + limit, n)
