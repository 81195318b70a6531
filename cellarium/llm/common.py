"""What the operators share: the shared folder, written intermediates, Arrow batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
NOT_WHITE_RUN = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch, and bytes where the session knows that limit.  A batch
#: of long texts must fit a Python worker several times over.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is unset, a local session gets a temporary folder of its
    own; a cluster session is refused, since a machine-local folder would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_cellarium_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="cellarium-")
        spark.sparkContext._cellarium_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*frames: DataFrame) -> None:
    """Remove the folders of ``written`` frames that nothing reads any more.  Other frames are left alone."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            remove_folder(df.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole, long texts.

    The settings are read when a plan runs, which is after this returns: they stay with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns as one) and the named columns: a join can't meet clashing names then."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


#: A side of at most so many short rows (some 50 bytes each) is broadcast; a larger one is dealt by key.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has BROADCAST_ROWS rows or fewer.  It should be cheap to count."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose doc_id and text hash aren't in ``gone`` (_d, _k), with the columns they came with.

    Texts stay where they are as long as ``gone`` is small; beyond that they are dealt by key.
    """
    rows = packed(docs, d=F.col(doc_id), k=F.xxhash64(F.col(text)))
    return rows.join(if_small(gone), F.col("d").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left_anti").select("row.*")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in the order, from 0: ranges are numbered each for itself and moved on by the sizes of those before."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


#: A key with more than one row in so many is hot.  There are fewer hot keys than this.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, table: DataFrame, keys: str | list[str], total: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each hot key, without gathering hot keys.  NULL keys meet nothing.

    The rows of hot keys (fewer than HOT_SHARE keys, whatever the input) meet a broadcast of their part of
    the table where they are; all others are dealt by key.  ``counts`` has the keys with the ``count`` of their rows.  ``rows`` is read twice: it should be ``written``.
    """
    keys = [keys] if isinstance(keys, str) else keys
    counts = rows.groupBy(*keys).count() if counts is None else counts
    hot = counts.filter(F.col("count") > max(1, total // HOT_SHARE)).select(*keys)
    some = table.join(F.broadcast(hot), keys, "left_semi")
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(some), keys).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of doc_id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def unit(*parts: Column) -> Column:
    """A repeatable draw in (0, 1) from a hash of ``parts``."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 53))


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker does, across tasks of one ``owner``.

    A worker serves one stage after the other: tables of an owner before are given up, and their memory is given back.
    """
    held = getattr(sys, "_cellarium_worker_cache", None)
    if held is None or held[0] != owner:
        begun = held is not None
        held = sys._cellarium_worker_cache = (owner, {})
        if begun:
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return held[1]
