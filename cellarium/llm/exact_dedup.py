"""Exact dedup with a persistent digest index.

The index is a table in the shared folder, a part for each batch, bucketed and sorted by digest.  A batch is
reduced to one row for each digest, then a sort-merge anti-join against the index, whose side
is read by buckets and not shuffled, leaves the digests that are new; these are
appended in the same bucketing.  (A bucket has a file for each batch, so the join sorts a bucket's files
together again; each is short and sorted.)  Texts are equal when they are identical without
white space; the digest is SHA-256 of the normalised text.

A batch has a name.  To append under a name that the index has already replaces that batch's part, and
its own entries count as not there: a job that failed after it appended is run again under
its name and gives what it would have given.  Bucket count and layout are kept beside the data.

Cases: null texts count as empty and are equal to each other, and to texts of
white space; of rows that tie in length and doc_id, the first in the batch stays,
so exactly one row of a group is kept; a null doc_id sorts before any other; an
empty batch appends nothing.  Columns are selected by name.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import WHITE, discard, documents, if_small, join_by_key, new_path, packed, written

ENTRY = "digest string, keep_id bigint, keep_tag bigint, group_size bigint"
#: The layout of the files: entries/batch=<name>/, and settings/ with this number and the bucket count.
LAYOUT = 2


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class DigestIndex:
    """The persistent index at ``path``.  Its number of buckets is that of the first opening, and is refused if given otherwise later."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        kept = self._settings() if path else None
        if kept and kept["layout"] != LAYOUT:
            raise ValueError(f"the index at {path} has layout {kept['layout']}, not {LAYOUT}")
        if kept and buckets and kept["buckets"] != buckets:
            raise ValueError(f"the index at {path} has {kept['buckets']} buckets, not {buckets}")
        self.buckets = kept["buckets"] if kept else buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not kept:
            made = spark.range(1).select(F.lit(LAYOUT).alias("layout"), F.lit(self.buckets).alias("buckets"))
            made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")

    def _there(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _settings(self) -> dict | None:
        """What the index at this path was written with; None if there is none yet."""
        if self._there(f"{self.path}/settings/_SUCCESS"):
            return self.spark.read.schema("layout int, buckets int").parquet(f"{self.path}/settings").first().asDict()
        if self._there(f"{self.path}/entries"):
            raise ValueError(f"the index at {self.path} doesn't say how many buckets it has")
        return None

    def rows(self) -> DataFrame:
        """All entries, with their batch."""
        schema = f"{ENTRY}, batch string"
        if not self._there(f"{self.path}/entries"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/entries")

    def append(self, batch: DataFrame, name: str) -> DataFrame:
        """Deduplicate ``batch`` (digest, doc_id, length, tag) against the index and itself; add what is new under ``name``.

        Returns the batch's groups.  A document whose digest another batch brought is a duplicate of that batch's row.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.\-]+", name):
            raise ValueError(f"not a name of a batch: {name!r}")
        best = F.min(F.struct((-F.col("length")).alias("l"), F.col("doc_id").alias("id"), F.col("tag").alias("tag")))
        # Written, else the optimizer joins before it groups, and all rows of a digest meet in one task.
        groups = written(batch.groupBy("digest").agg(best.alias("b"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        table = f"digest_index_{uuid.uuid4().hex}"
        # The catalog knows the table only as long as this takes; its files stay.
        self.spark.sql(
            f"CREATE TABLE {table} ({ENTRY}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'"
        )
        try:
            if self._there(f"{self.path}/entries"):
                self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
            known = self.spark.table(table).filter(F.col("batch") != name).select("digest").hint("merge")
            fresh = groups.join(known, "digest", "left_anti").select("digest", F.col("b.id").alias("keep_id"), F.col("b.tag").alias("keep_tag"), "group_size")
            # Written elsewhere first: a table can't be written to while it is read.
            fresh = written(fresh, "digest-new")
            view = f"fresh_{table}"
            fresh.repartition(self.buckets, "digest").createOrReplaceTempView(view)
            self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = '{name}') SELECT digest, keep_id, keep_tag, group_size FROM {view}")
            self.spark.catalog.dropTempView(view)
            discard(fresh)
        finally:
            self.spark.sql(f"DROP TABLE {table}")
        return groups


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest, doc_id, length (code points of the original), key (a hash of the original) and tag (a number of the row) of every row, written once."""
    return written(
        docs.select(
            F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("digest"),
            F.col(doc_id).cast("long").alias("doc_id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("length"),
            F.xxhash64(F.col(text)).alias("key"),
            F.monotonically_increasing_id().alias("tag"),
        ),
        "digests",
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and key.

    ``kept`` is true for the one row of a group that stays, and never for a
    group that another batch brought.  ``name`` is the batch's, to be given again if the job is repeated.
    """
    index = index or DigestIndex(docs.sparkSession)
    name = name or uuid.uuid4().hex
    batch = digests(docs, doc_id, text)
    groups = index.append(batch, name)
    entries = index.rows().select("digest", "keep_id", "keep_tag", F.col("group_size").alias("entry_size"), "batch")
    counts = groups.withColumnRenamed("group_size", "count").select("digest", "count")
    met = join_by_key(batch, entries, "digest", batch.count(), counts)
    return met.select(
        "doc_id",
        "keep_id",
        F.col("entry_size").alias("group_size"),
        ((F.col("batch") == name) & (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "key",
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with.

    Rows are found again by doc_id and a hash of the text.  Where several rows have
    both in common and one of them stays, the surplus is dropped by comparing them: the row that is first as JSON stays.
    """
    rows = written(dedup(docs, index, doc_id, text, name), "dedup-marks")
    all_rows = packed(docs, d=F.col(doc_id).cast("long"), k=F.xxhash64(F.col(text)), t=F.col(text))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k"))
    gone = rows.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.max("kept").alias("_any"), F.count(F.lit(1)).alias("_n"))
    gone = written(gone.filter(~F.col("_any") | (F.col("_n") > 1)), "dedup-gone")
    discard(rows)
    stay = all_rows.drop("t").join(if_small(gone.select("_d", "_k"), gone.count()), same, "left_anti").select("row.*")
    again = gone.filter("_any")
    if again.isEmpty():
        return stay
    surplus = all_rows.join(if_small(again.select("_d", "_k")), same, "left_semi").groupBy("d", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return stay.unionByName(surplus.select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("key")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
    """
}
