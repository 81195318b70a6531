"""Stored tables: Parquet in ranges of a key, sorted, with the bounds of each file beside it.

A read of a key range opens only the files whose bounds meet it, and inside them Parquet skips row
groups by the pushed comparison.  Bounds are a table of one row for each file; a read brings to the driver only
the names of the files that it opens.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

ROW_GROUP = 16 << 20
#: The layout of a folder: rows/, bounds/ and schema.json.  Folders of another layout are not looked at.
LAYOUT = 2


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_cellarium_store", None)
    if own is None:
        own = spark.sparkContext._cellarium_store = "file://" + tempfile.mkdtemp(prefix="cellarium-store-")
    return own


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _files(spark, path)
    return files.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    files, hadoop = _files(spark, path)
    files.delete(hadoop, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    files, hadoop = _files(spark, path)
    return files.rename(hadoop, spark._jvm.org.apache.hadoop.fs.Path(to))


def read_text(spark: SparkSession, path: str) -> str:
    files, hadoop = _files(spark, path)
    stream = files.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears as a whole, in place of the one that was there."""
    files, hadoop = _files(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = files.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(hadoop, False)
    files.rename(aside, hadoop)


def state_of(spark: SparkSession, path: str) -> str:
    """Changes when the files at ``path`` do."""
    files, hadoop = _files(spark, path)
    status, size = files.getFileStatus(hadoop), files.getContentSummary(hadoop)
    return f"{path}|{status.getModificationTime()}|{size.getLength()}|{size.getFileCount()}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellarium-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class KeyedFiles:
    """A folder of ``rows`` in ranges of ``key`` and the ``bounds`` of its files."""

    spark: SparkSession
    path: str
    key: str

    def schema(self) -> StructType:
        """As it was written: no file is opened for it."""
        return StructType.fromJson(json.loads(read_text(self.spark, f"{self.path}/schema.json")))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema()).parquet(f"{self.path}/rows")

    def bounds(self, kind: DataType | None = None) -> DataFrame:
        kind = kind or self.schema()[self.key].dataType
        schema = StructType([StructField("file", StringType()), StructField("low", kind), StructField("high", kind)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/bounds")

    def between(self, start: Any = None, stop: Any = None) -> DataFrame:
        """All rows of the files that hold a key from ``start`` to ``stop``, both included; an empty bound is open.

        The rows beyond the bounds are still to be filtered.
        """
        meet = F.lit(True)
        if start not in ("", None):
            meet = meet & (F.col("high") >= F.lit(start))
        if stop not in ("", None):
            meet = meet & (F.col("low") <= F.lit(stop))
        schema = self.schema()
        names = [r["file"] for r in self.bounds(schema[self.key].dataType).filter(meet).select("file").collect()]
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{n}" for n in names])


def write_keyed(df: DataFrame, path: str, key: str, order: Sequence[Any] = (), parts: int | None = None) -> KeyedFiles:
    """Write ``df`` in ranges of ``key``, sorted by it and then by ``order``.  The folder appears when it is whole."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key, *order).write.option("parquet.block.size", ROW_GROUP).parquet(f"{aside}/rows")
    made = spark.read.parquet(f"{aside}/rows").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col(key).alias("key"))
    made.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high")).coalesce(1).write.parquet(f"{aside}/bounds")
    write_text(spark, f"{aside}/schema.json", df.schema.json())
    if not rename(spark, aside, path):
        remove(spark, aside)
    return KeyedFiles(spark, path, key)


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], key: str, order: Sequence[Any] = ()) -> KeyedFiles:
    """The keyed files of ``name`` made from the table at ``source``: written when they are first asked for, or when the source has changed."""
    mark = hashlib.sha256(f"{LAYOUT}|{name}|{state_of(spark, source)}".encode()).hexdigest()[:20]
    path = f"{shared_folder(spark)}/cellarium-{name}-{mark}"
    return KeyedFiles(spark, path, key) if exists(spark, path) else write_keyed(build(), path, key, order)


__all__ = ["KeyedFiles", "shared_folder", "state_of", "stored", "write_keyed", "written"]
