"""Where intermediate results are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where that is unset there is one of our own, on this machine, removed at exit: in tests and other
    runs within one process. On a cluster it would not be shared, so there it is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir is unset, and no folder of this machine is shared by the executors of {master}")
    if getattr(spark, "_quernstone_dir", None) is None:
        folder = tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark._quernstone_dir = f"file://{folder}"
    return spark._quernstone_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name that no folder below the shared one has yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder, wherever the file system of its name is."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _file_system(spark, name)
    return fs.exists(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, path = _file_system(spark, folder)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def touch(spark: SparkSession, name: str) -> None:
    """Makes an empty file; an error if there is one of that name."""
    fs, path = _file_system(spark, name)
    fs.create(path, False).close()


def materialised(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder, without its lineage: what follows survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Types that Parquet gives back as they were, nullable or not.
_PLAIN = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def stored(df: DataFrame) -> DataFrame:
    """As `materialised`, in Parquet: a tenth of the bytes, and what follows reads its own columns only. Tables with other than plain columns are checkpoints."""
    if not all(isinstance(f.dataType, _PLAIN) or f.dataType == T.StringType() for f in df.schema.fields):
        return materialised(df)
    folder = new_folder(df.sparkSession, "table")
    # by place: any names will do, and repeated ones
    df.toDF(*(f"c{n}" for n in range(len(df.columns)))).write.parquet(folder)
    return df.sparkSession.read.parquet(folder).toDF(*df.columns)
