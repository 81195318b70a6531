"""Edits as a stream: the newest value of each column, kept by merging micro-batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellarium.operators.cells import CELL_COLUMNS, COORDINATES
from cellarium.operators.versions import ReadPolicy, resolve
from cellarium.sources.store import exists, read_text, remove, write_text


def latest_values(edits: DataFrame) -> DataFrame:
    """Streaming aggregate: the newest put of each column (run it in update or complete mode)."""
    newest = F.max(F.struct("ts", "seq", "value")).alias("n")
    return edits.filter("type = 4").groupBy(*COORDINATES).agg(newest).select(*COORDINATES, "n.ts", "n.value")


def windowed_counts(edits: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Edits of each family in windows of event time; what is later than ``late`` is left out."""
    return edits.withWatermark(time, late).groupBy(F.window(time, width), "family").agg(F.count(F.lit(1)).alias("edits"))


def compacting_sink(edits: DataFrame, path: str, checkpoint: str, buckets: int = 16, keep: int = 2) -> StreamingQuery:
    """Keep a table of cells, tombstones included, merging each micro-batch into the buckets of row keys that it touches.

    A bucket's versions are named by batch, ``bucket=<k>/batch=<n>``; a list of each bucket's newest is written last, as
    ``heads/batch=<n>``.  A batch that runs again after a failure begins from the heads before it and writes its own over.  What the
    newest ``keep`` heads don't name is removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.select(*CELL_COLUMNS).withColumn("bucket", F.pmod(F.xxhash64("rowkey"), F.lit(buckets)).cast("int"))
        rows = rows.persist()
        try:
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
            heads = _heads(spark, path, number - 1)
            old = [f"{path}/bucket={k}/batch={heads[k]}" for k in touched if k in heads]
            if old:
                rows = rows.unionByName(spark.read.option("basePath", path).parquet(*old).select(*CELL_COLUMNS, "bucket"))
            dealt = rows.dropDuplicates().repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", "rowkey")
            # Overwriting partitions leaves the buckets that the batch doesn't touch.
            dealt.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        finally:
            rows.unpersist()
        now = heads | {k: number for k in touched}
        write_text(spark, f"{path}/_heads/{number}", json.dumps(now))
        dead = _heads(spark, path, number - keep)
        for k, at in dead.items():
            if all(_heads(spark, path, n).get(k) != at for n in range(number - keep + 1, number + 1)):
                remove(spark, f"{path}/bucket={k}/batch={at}")

    return edits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _heads(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Each bucket's newest batch after batch ``number``; a batch without rows has no list of its own and leaves the one before."""
    while number >= 0:
        if exists(spark, f"{path}/_heads/{number}"):
            return {int(k): v for k, v in json.loads(read_text(spark, f"{path}/_heads/{number}")).items()}
        number -= 1
    return {}


def read_generation(spark: SparkSession, path: str, number: int) -> DataFrame:
    """What a read of the table sees after the batch; the newest two are there."""
    heads = _heads(spark, path, number)
    folders = [f"{path}/bucket={k}/batch={n}" for k, n in sorted(heads.items())]
    cells = spark.read.option("basePath", path).parquet(*folders).select(*CELL_COLUMNS)
    return resolve(cells, ReadPolicy())


def latest_to_files(edits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run ``latest_values`` and leave its newest state as Parquet: ``path``/batch=<n>, the one before it removed."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        remove(batch.sparkSession, f"{path}/batch={number - 1}")

    return latest_values(edits).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """What ``latest_to_files`` left."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")
