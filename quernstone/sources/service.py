"""The five requests of the document API, as methods that take and return what JSON has."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernstone.errors import DocumentNotFound, SearchError
from quernstone.functions.scoring import DEFAULT_RELEVANCE
from quernstone.plans.engine import SearchEngine
from quernstone.sources.readers import DOCUMENT, read_xml
from quernstone.storage import materialised

PROPERTIES = ["abstract", "title"]


class Failure(Exception):
    """status: 400 for a bad request, 404 for a document that isn't there."""

    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status, self.message = status, message


def _failing(f):
    def call(*args: Any, **options: Any) -> Any:
        try:
            return f(*args, **options)
        except DocumentNotFound as e:
            raise Failure(404, str(e)) from e
        except (SearchError, ValueError, PySparkException, Py4JJavaError) as e:
            raise Failure(400, str(e).splitlines()[0]) from e

    return call


class DocumentService:
    """Documents of title, url and abstract; title and abstract can be searched. Stemming and stop words are on."""

    def __init__(self, spark: SparkSession, default_language: str = "en") -> None:
        self.spark = spark
        self.engine = SearchEngine(spark, properties=PROPERTIES, default_language=default_language)

    def _document(self, body: dict[str, Any]) -> dict[str, str]:
        for name in DOCUMENT.names:
            if not body.get(name):
                raise ValueError(f"field {name!r} is required")
        return {name: body[name] for name in DOCUMENT.names}

    @_failing
    def create(self, body: dict[str, Any], lang: str = "") -> dict[str, Any]:
        df = self.engine.insert(self.spark.createDataFrame([self._document(body)], DOCUMENT), lang.lower() or None)
        return df.select("id", *DOCUMENT.names).first().asDict()

    @_failing
    def upload(self, paths: list[str], lang: str = "") -> dict[str, int]:
        """Gzipped XML dumps, one after the other: if one fails, those before it stay."""
        out = {"total": 0, "success": 0, "fail": 0}
        for path in paths:
            if not path.endswith(".gz"):
                raise ValueError(f"{path} isn't gzipped")
            df = materialised(read_xml(self.spark, path))  # all of it is read before any is added
            n, failed = df.count(), self.engine.insert_batch(df, 10_000, lang.lower() or None).count()
            out = {"total": out["total"] + n, "success": out["success"] + n - failed, "fail": out["fail"] + failed}
        return out

    @_failing
    def update(self, key: str, body: dict[str, Any], lang: str = "") -> dict[str, Any]:
        df = self.spark.createDataFrame([self._document(body)], DOCUMENT).withColumn("id", F.lit(key))
        self.engine.update(df, lang.lower() or None)
        return {"id": key, **self._document(body)}

    @_failing
    def delete(self, key: str, lang: str = "") -> None:
        self.engine.delete([key], lang.lower() or None)

    @_failing
    def search(self, body: dict[str, Any]) -> dict[str, Any]:
        given = {"k": DEFAULT_RELEVANCE.k, "b": DEFAULT_RELEVANCE.b, "d": DEFAULT_RELEVANCE.d, **body.get("relevance", {})}
        options = {name: body[name] for name in ("properties", "exact", "tolerance", "offset", "limit") if name in body}
        return self.engine.search(body.get("query") or "", language=(body.get("lang") or "").lower() or None, **options, **given).to_dict()
