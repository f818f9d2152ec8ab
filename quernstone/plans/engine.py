"""The search engine: documents with an index, changed as a whole and searched.

Every change makes new tables first and takes them over in one assignment: one that fails leaves the
engine as it was, and a search sees the tables as they were when it was planned. The index is
what a rebuild from the documents would be. An engine may do without a kept index (`keep_index`): then
a search analyses the documents in one pass and keeps only what its tokens match.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import DocumentAlreadyExists, DocumentNotFound, DocumentsDiffer, PropertyNotSearchable
from quernstone.functions.analyzer import LANGUAGES, analyze_text, check_language
from quernstone.functions.scoring import DEFAULT_RELEVANCE, Relevance
from quernstone.operators.index import Analysis, Index, check_properties, few, field_stats, flatten, string_paths, tokenized
from quernstone.operators.match import DOCUMENTED, TREE
from quernstone.plans import search as plan
from quernstone.storage import discard, exists, listed, materialised, stored, touch

#: After so many changes the tables are written anew, else plans grow with their number.
COMPACT_AFTER = 16
#: A saved version is made up of so many at most; then it is written whole.
MOST_PARTS = 16
_VERSION = re.compile(r"v(\d{9})$")


@dataclass
class SearchResult:
    """hits: id, data, score of the page. count: of all hits. elapsed: microseconds."""

    hits: DataFrame
    count: int
    elapsed: int

    def to_dict(self) -> dict[str, Any]:
        return {"count": self.count, "hits": [{"id": r["id"], "data": r["data"].asDict(recursive=True), "score": r["score"]} for r in self.hits.collect()], "elapsed": self.elapsed}

    def to_json(self) -> DataFrame:
        """The hits as JSON objects, one a row."""
        return self.hits.select(F.to_json(F.struct("*")).alias("hit"))

    def envelope(self) -> DataFrame:
        """One row as a response has it: count, hits (an array of id, data and score, in order), elapsed."""
        hits = self.hits.agg(F.collect_list(F.struct(F.col("score"), "id", "data")).alias("h"))  # a page
        order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["id"] < b["id"], -1).otherwise(1))
        one = F.transform(F.array_sort("h", order), lambda x: F.struct(x["id"].alias("id"), x["data"].alias("data"), x["score"].alias("score")))
        return hits.select(F.lit(self.count).cast("long").alias("count"), one.alias("hits"), F.lit(self.elapsed).cast("long").alias("elapsed"))


@dataclass(frozen=True)
class Saved:
    """Versions in a folder that make up a state, together with documents that came since, and their index."""

    folder: str
    parts: tuple[int, ...]
    documents: DataFrame | None = None
    index: Index | None = None

    def plus(self, documents: DataFrame, index: Index | None) -> Saved | None:
        if index is None:
            return None
        if self.documents is None or self.index is None:
            return replace(self, documents=documents, index=index)
        return replace(self, documents=self.documents.unionByName(documents), index=self.index.plus(index))


@dataclass(frozen=True)
class State:
    documents: DataFrame | None = None
    index: Index | None = None
    changes: int = 0
    saved: Saved | None = None


class SearchEngine:
    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, id_col: str = "id", properties: Sequence[str] | None = None, default_language: str = "en", stemming: bool = True, stop_words: bool = True, lang_col: str | None = None, tolerance_mode: str = DOCUMENTED, keep_index: bool = True) -> None:
        """documents: with ids in id_col (made if there is no such column). lang_col: language of each document, if they differ.

        properties: dotted paths of the searchable string columns; None: all of them.
        keep_index: whether an index is computed and kept, which pays from the second search on.
        """
        if tolerance_mode not in (DOCUMENTED, TREE):
            raise ValueError(f"tolerance_mode is {DOCUMENTED!r} or {TREE!r}")
        self.spark, self.id_col, self.default_language = spark, id_col, check_language(default_language)
        self.analysis, self.tolerance_mode, self.keep_index = Analysis(stemming, stop_words), tolerance_mode, keep_index
        self._given = list(properties) if properties is not None else None
        self.properties: list[str] = []
        self._state = State()
        self._lang = "lang" if lang_col is None else lang_col
        self._has_lang = lang_col is not None
        if documents is not None:
            self.insert_batch(documents)

    @property
    def documents(self) -> DataFrame | None:
        return self._state.documents

    @property
    def index(self) -> Index | None:
        return self._state.index

    # documents

    def _prepared(self, df: DataFrame, language: str | None) -> DataFrame:
        """df with ids and languages, once it is known to fit."""
        language = check_language(language or self.default_language)
        if not self.properties:
            own = [c for c in string_paths(df.schema) if c not in (self.id_col, self._lang if self._has_lang else None)]
            self.properties = own if self._given is None else check_properties(df.schema, self._given)
        if self.id_col not in df.columns:
            df = materialised(df.withColumn(self.id_col, F.uuid()))  # else ids were others each time
        if not self._has_lang:
            df = df.withColumn("__lang", F.lit(language))
        else:
            df = df.withColumn("__lang", F.coalesce(F.col(self._lang), F.lit(language)))
            odd = df.filter(~F.col("__lang").isin(list(LANGUAGES))).select("__lang").first()
            if odd:
                check_language(odd[0])
        if self.documents is not None:
            here = self.documents.schema
            for f in here.fields:
                if f.name not in df.columns:
                    raise DocumentsDiffer(f"the documents have no column {f.name!r}")
                if f.name != "__lang" and df.schema[f.name].dataType != f.dataType:
                    raise DocumentsDiffer(f"column {f.name!r} is {df.schema[f.name].dataType.simpleString()} and not {f.dataType.simpleString()}")
            extra = [c for c in df.columns if c not in here.names]
            if extra:
                raise DocumentsDiffer(f"the documents have further columns: {', '.join(extra)}")
            df = df.select(*(F.col(f"`{c}`") for c in here.names))
        # with an index documents are kept as they are now; without one they are read where they are
        return stored(df) if self.keep_index else df

    def _fields(self, df: DataFrame) -> DataFrame:
        return flatten(df, self.properties, self.id_col, "__lang")

    def _languages(self, df: DataFrame) -> list[str]:
        return [r[0] for r in df.select("__lang").distinct().collect()] or [self.default_language]  # seven at most

    def _index_of(self, df: DataFrame) -> Index | None:
        return Index.build(self._fields(df), self._languages(df), self.analysis) if self.keep_index else None

    def _changed(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> State:
        """The state after documents go (removed: their ids, different ones) and others come."""
        documents, index, saved = self.documents, self.index, self._state.saved
        if removed is not None:
            saved = None
            removed = few(materialised(removed))
            documents = documents.join(removed, self.id_col, "left_anti").select(*documents.columns)
            if index is not None:
                index = index.without(removed.select(F.col(f"`{self.id_col}`").alias("id")))
        if added is not None:
            own = self._index_of(added)
            documents = added if documents is None else documents.unionByName(added)
            index = own if index is None else index.plus(own)
            saved = saved and saved.plus(added, own)
        changes = self._state.changes + 1
        if changes % COMPACT_AFTER == 0:
            documents, saved = materialised(documents), None
            index = index and Index.of(stored(index.postings), stored(index.lengths))
        return State(documents, index, changes, saved)

    def _ids(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{self.id_col}`"))

    def _check_once(self, df: DataFrame) -> None:
        twice = self._ids(df).groupBy(self.id_col).count().filter("count > 1").first()
        if twice:
            raise DocumentAlreadyExists(twice[0])

    def known(self, ids: DataFrame) -> DataFrame:
        """The different ids with a column `known`: whether there is a document of that id."""
        ids = self._ids(ids).distinct()
        if self.documents is None:
            return ids.withColumn("known", F.lit(False))
        here = self._ids(self.documents).withColumn("there", F.lit(True))
        return ids.join(here, self.id_col, "left").select(F.col(f"`{self.id_col}`"), F.coalesce("there", F.lit(False)).alias("known"))

    def insert_batch(self, df: DataFrame, batch_size: int | None = None, language: str | None = None) -> DataFrame:
        """Adds documents and returns those that weren't added: (id, error), a row for each.

        A document whose id is there already isn't added; of those that have an id twice in df, one is. batch_size doesn't matter.
        """
        df = self._prepared(df, language)
        key = f"`{self.id_col}`"
        there = self.known(df).filter("known").select(F.col(key))
        repeated = self._ids(df).groupBy(self.id_col).agg((F.count("*") - 1).alias("n")).filter("n > 0")
        # ids that are there fail each time they are given, repeated ones each time but one
        failed = df.join(there, self.id_col, "left_semi").select(F.col(key)).union(repeated.join(there, self.id_col, "left_anti").select(F.col(key), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(key))
        errors = materialised(failed.select(F.col(key), F.lit("DocumentAlreadyExists").alias("error")))
        if not errors.isEmpty():
            many = materialised(repeated.select(F.col(key)))
            df = df.join(there, self.id_col, "left_anti").select(*df.columns)
            single = df.join(many, self.id_col, "left_anti").select(*df.columns)
            # of equal ids one document, the same one however often it is computed: it is written now
            df = stored(single.union(df.join(many, self.id_col, "left_semi").select(*df.columns).dropDuplicates([self.id_col])))
        self._state = self._changed(df)
        return errors

    def insert(self, document: dict[str, Any] | DataFrame, language: str | None = None) -> DataFrame:
        """Adds one document, or all of a DataFrame, and returns them with their ids."""
        df = self._prepared(self._frame(document), language)
        self._check_once(df)
        there = self.known(df).filter("known").first()
        if there:
            raise DocumentAlreadyExists(there[0])
        self._state = self._changed(df)
        return df.drop("__lang")

    def _frame(self, document: dict[str, Any] | DataFrame) -> DataFrame:
        if isinstance(document, DataFrame):
            return document
        if self.documents is not None:
            schema = self.documents.drop("__lang").schema
            if self.id_col not in document:
                schema = T.StructType([f for f in schema.fields if f.name != self.id_col])
            return self.spark.createDataFrame([document], schema)
        return self.spark.createDataFrame([document])

    def _check_there(self, ids: DataFrame) -> None:
        first = self.known(ids).filter("not known").first()
        if first:
            raise DocumentNotFound(first[0])

    def update(self, document: dict[str, Any] | DataFrame, language: str | None = None) -> DataFrame:
        """Replaces documents by those with the same ids; all of them, or, with an error, none."""
        df = self._frame(document)
        if self.documents is None:
            raise DocumentNotFound(next(iter(df.select(self.id_col).head(1) if self.id_col in df.columns else []), [None])[0])
        df = self._prepared(df, language)
        self._check_once(df)
        self._check_there(df)
        df = materialised(df)  # it may be computed from the documents that it replaces
        self._state = self._changed(df, self._ids(df))
        return df.drop("__lang")

    def delete(self, ids: Sequence[Any] | DataFrame, language: str | None = None) -> None:
        """Removes documents. The language doesn't matter: each document's own is known."""
        if language:
            check_language(language)
        if not isinstance(ids, DataFrame):
            if self.documents is None:
                raise DocumentNotFound(next(iter(ids), None))
            ids = self.spark.createDataFrame([(i,) for i in ids], T.StructType([self.documents.schema[self.id_col]]))
        ids = self._ids(ids)
        self._check_there(ids)
        self._state = self._changed(removed=ids.distinct())

    @property
    def count(self) -> int:
        return 0 if self.documents is None else self.documents.count()

    # search

    def _tokens(self, query: str, language: str | None) -> list[str]:
        language = check_language(language or self.default_language)
        return analyze_text(query, language, self.analysis.stemming, self.analysis.stop_words, duplicates=False)

    def scores(self, query: str, properties: Sequence[str] | None = None, exact: bool = False, tolerance: int = 0, k: float = DEFAULT_RELEVANCE.k, b: float = DEFAULT_RELEVANCE.b, d: float = DEFAULT_RELEVANCE.d, language: str | None = None) -> DataFrame:
        """(id, score) of every hit."""
        tokens = self._tokens(query, language)
        properties = list(properties or self.properties)
        if tokens:
            for p in properties:
                if p not in self.properties:
                    raise PropertyNotSearchable(p)
        if self.documents is None:
            return self.spark.createDataFrame([], "id string, score double")
        properties = [p for p in properties if p in self.properties]
        mode = plan.mode_of(exact, tolerance, self.tolerance_mode)
        index = self.index
        if index is None:
            analysed = tokenized(flatten(self.documents, sorted(set(properties)), self.id_col, "__lang"), self._languages(self.documents), self.analysis)
            index = plan.matching_index(analysed, tokens, mode, tolerance)
        return plan.scores(index, tokens, properties, mode, tolerance, Relevance(k, b, d))

    def search(self, query: str, properties: Sequence[str] | None = None, exact: bool = False, tolerance: int = 0, k: float = DEFAULT_RELEVANCE.k, b: float = DEFAULT_RELEVANCE.b, d: float = DEFAULT_RELEVANCE.d, offset: int = 0, limit: int = 10, language: str | None = None, digits: int | None = None) -> SearchResult:
        """The page of hits, and how many there are. digits: scores are rounded before they are compared."""
        if not query:
            raise ValueError("the query is empty")
        began = time.perf_counter()
        scored = self.scores(query, properties, exact, tolerance, k, b, d, language)
        top = plan.page(scored, offset, limit, digits)
        if self.documents is None:
            return SearchResult(top.select("id", F.struct(F.lit(None).alias("none")).alias("data"), "score"), 0, 0)
        # both the page and the count come from the scores, which are computed once
        scored = scored.persist()
        n = scored.count()
        hits = materialised(plan.with_documents(plan.page(scored, offset, limit, digits), self.documents.drop("__lang"), self.id_col, limit))
        scored.unpersist()
        return SearchResult(hits, n, int(1e6 * (time.perf_counter() - began)))

    # persistence

    def save(self, folder: str) -> int:
        """Writes documents and index as the next version in the folder, and goes on with that; the number of the version.

        A version counts once it is complete, so one that fails or is being written hides none, and what is read while
        it is written stays. After documents were only added to what was saved or read there, the version has these alone and
        names the earlier ones that go with it, `MOST_PARTS` at most; else it is whole. `vacuum` removes those that the last doesn't need.
        """
        if self.documents is None:
            raise ValueError("there is nothing to save")
        n = max(_versions(self.spark, folder, complete=False), default=0) + 1
        place = f"{folder}/v{n:09}"
        touch(self.spark, f"{place}/_BEGUN")  # fails if another has begun the same version
        saved = self._state.saved
        parts = saved.parts if saved and saved.folder == folder and len(saved.parts) < MOST_PARTS and {*saved.parts} <= {*_versions(self.spark, folder)} else ()
        documents, index = (saved.documents, saved.index) if parts else (self.documents, self.index)
        if parts and documents is None:
            documents, index = self.documents.limit(0), Index.of(self.index.postings.limit(0), self.index.lengths.limit(0))
        documents.write.mode("overwrite").parquet(f"{place}/documents")
        index = index or Index.build(self._fields(documents), self._languages(documents), self.analysis)
        if parts:
            index = replace(index, field_stats=field_stats(self.index.lengths))
        index.write(f"{place}/index", self.properties)
        for k in parts:
            touch(self.spark, f"{place}/_WITH-v{k:09}")
        touch(self.spark, f"{place}/_COMPLETE")
        return self._loaded(folder, n)

    def load(self, folder: str) -> SearchEngine:
        versions = _versions(self.spark, folder)
        if not versions:
            raise FileNotFoundError(f"{folder} has no complete version")
        self._loaded(folder, max(versions))
        return self

    def _loaded(self, folder: str, n: int) -> int:
        parts = _parts(self.spark, folder, n)
        documents = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{folder}/v{k:09}/documents") for k in parts))
        if not self.properties:
            own = [c for c in string_paths(documents.drop("__lang").schema) if c not in (self.id_col, self._lang if self._has_lang else None)]
            self.properties = own if self._given is None else check_properties(documents.schema, self._given)
        self._state = State(documents, Index.read(self.spark, *(f"{folder}/v{k:09}/index" for k in parts)), self._state.changes, Saved(folder, parts))
        return n

    @staticmethod
    def vacuum(spark: SparkSession, folder: str) -> None:
        """Removes all versions before the last complete one but those that are part of it. No engine may be reading these any more."""
        last = max(_versions(spark, folder), default=0)
        needed = _parts(spark, folder, last) if last else ()
        for n in _versions(spark, folder, complete=False):
            if n < last and n not in needed:
                discard(spark, f"{folder}/v{n:09}")

    def settings(self) -> dict[str, Any]:
        return {"default_language": self.default_language, "properties": self.properties, **asdict(self.analysis)}

    def copy(self) -> SearchEngine:
        """An engine of the same state; changes to one don't show in the other."""
        other = SearchEngine(self.spark, None, self.id_col, self._given, self.default_language, self.analysis.stemming, self.analysis.stop_words, self._lang if self._has_lang else None, self.tolerance_mode, self.keep_index)
        other.properties, other._state = list(self.properties), replace(self._state)
        return other


def _parts(spark: SparkSession, folder: str, n: int) -> tuple[int, ...]:
    """The versions that make up that one, itself at the end."""
    return (*sorted(int(m[1]) for name in listed(spark, f"{folder}/v{n:09}") if name.startswith("_WITH-") and (m := _VERSION.search(name))), n)


def _versions(spark: SparkSession, folder: str, complete: bool = True) -> list[int]:
    found = [int(m[1]) for name in listed(spark, folder) if (m := _VERSION.search(name))]
    return [n for n in found if not complete or exists(spark, f"{folder}/v{n:09}/_COMPLETE")]
