"""What the operators of this subpackage share: the word rule, typed inputs, and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as an array, for native expressions."""
    return F.array_remove(F.split(text, BLANK_CLASS + "+"), "")


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once for a row: an array of one, mapped."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Folders that this process wrote tables to, by session; :func:`release` deletes them.
_folders: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the session names in spark.checkpoint.dir, which driver and executors share.

    Where a session on one machine names none (tests), a temporary folder is set and used; on a cluster that is an error,
    as executors could not read what others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(base)
    _folders.append(f"{base.rstrip('/')}/sievework-{uuid.uuid4().hex}")
    return _folders[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all folders that operators of this process wrote. Their results can't be read afterwards: call it once they are stored."""
    while _folders:
        with contextlib.suppress(FileNotFoundError):
            discard(spark, _folders.pop())


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` as a Parquet table below ``folder``, read again: cuts the lineage, and outlives executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
