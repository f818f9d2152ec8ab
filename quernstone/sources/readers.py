"""Sources of documents: Parquet, JSON, and XML dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of a dump: each `doc` element has these children.
DOCUMENT = T.StructType([T.StructField(name, T.StringType()) for name in ("title", "url", "abstract")])


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores, dealt out to all of them; any other as it is.

    Small tables of one row group are one task otherwise, whatever is made of them. Filters and the choice
    of columns still reach the scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType = DOCUMENT, required: Sequence[str] | None = None) -> DataFrame:
    """A JSON object a line. Objects that lack a required field, or have it empty, are an error when they are read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in schema.names if required is None else required:
        bad = F.col(name).isNull() | (F.col(name) == "")
        df = df.withColumn(name, F.when(bad, F.raise_error(F.lit(f"field {name!r} is required"))).otherwise(F.col(name)))
    return df


def read_xml(spark: SparkSession, path: str | list[str], schema: T.StructType = DOCUMENT, row_tag: str = "doc") -> DataFrame:
    """The `doc` elements of (gzipped) XML files below a root of any name. Missing elements are empty strings."""
    # a path that ends with .gz is decompressed by the reader; one such file is one task, so dumps come in many
    df = spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)
    return df.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields))
