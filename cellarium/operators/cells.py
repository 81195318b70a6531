"""The cell model: rows of (rowkey, family, qualifier, ts, type, value, seq), and typed tables beside it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The types of cells.
PUT, DELETE, DELETE_COLUMN, DELETE_FAMILY = 4, 8, 12, 14

COORDINATES = ["rowkey", "family", "qualifier"]
CELL_COLUMNS = ["rowkey", "family", "qualifier", "ts", "type", "value", "seq"]


@dataclass(frozen=True)
class FamilySpec:
    """The storage policy of a family.  ``ttl`` is in the unit of ts; None keeps for ever."""

    max_versions: int = 3
    min_versions: int = 0
    ttl: int | None = None
    keep_deleted: bool = False


@dataclass(frozen=True)
class TableSpec:
    """How a typed table reads as cells: its key, and the columns of each family."""

    key: Column | str
    families: dict[str, list[str]] = field(default_factory=dict)


def as_cells(df: DataFrame, rowkey: Column, family: Column, qualifier: Column, ts: Column, value: Column, seq: Column | None = None, type: Column | None = None) -> DataFrame:
    """Cells from a table that has one row per cell."""
    return df.select(
        rowkey.cast("string").alias("rowkey"),
        family.cast("string").alias("family"),
        qualifier.cast("string").alias("qualifier"),
        ts.cast("long").alias("ts"),
        (F.lit(PUT) if type is None else type).cast("tinyint").alias("type"),
        value.alias("value"),
        (ts if seq is None else seq).cast("long").alias("seq"),
    )


def to_cells(df: DataFrame, spec: TableSpec, ts: int | Column = 0) -> DataFrame:
    """A typed table as cells with string values; a NULL is an absent cell."""
    stamp = ts if isinstance(ts, Column) else F.lit(ts)
    key = F.col(spec.key) if isinstance(spec.key, str) else spec.key
    entries = F.array(
        *[
            F.struct(F.lit(family).alias("family"), F.lit(c).alias("qualifier"), F.col(c).cast("string").alias("value"))
            for family, columns in sorted(spec.families.items())
            for c in columns
        ]
    )
    long = df.select(key.cast("string").alias("rowkey"), stamp.cast("long").alias("ts"), F.explode(entries).alias("c"))
    return long.filter("c.value IS NOT NULL").select(
        "rowkey", "c.family", "c.qualifier", "ts", F.lit(PUT).cast("tinyint").alias("type"), "c.value", F.lit(0).cast("long").alias("seq")
    )


def from_cells(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows with one column for each ``"family:qualifier": type``; the newest version counts, absent cells are NULL."""
    picked = []
    for name, kind in columns.items():
        family, qualifier = name.split(":", 1)
        here = (F.col("family") == family) & (F.col("qualifier") == qualifier)
        picked.append(F.max_by("value", F.when(here, F.struct("ts", "seq"))).cast(kind).alias(qualifier))
    return cells.groupBy("rowkey").agg(*picked)


def result_map(cells: DataFrame) -> DataFrame:
    """rowkey and ``cells``: family -> qualifier -> versions (ts, value), newest first."""
    newest = F.sort_array(F.collect_list(F.struct("ts", "seq", "value")), asc=False)
    versions = cells.groupBy(*COORDINATES).agg(F.transform(newest, lambda v: F.struct(v["ts"].alias("ts"), v["value"].alias("value"))).alias("versions"))
    columns = versions.groupBy("rowkey", "family").agg(F.map_from_entries(F.collect_list(F.struct("qualifier", "versions"))).alias("columns"))
    return columns.groupBy("rowkey").agg(F.map_from_entries(F.collect_list(F.struct("family", "columns"))).alias("cells"))


def latest_map(cells: DataFrame) -> DataFrame:
    """rowkey and ``cells``: family -> qualifier -> newest value."""
    return result_map(cells).select(
        "rowkey", F.transform_values("cells", lambda _, columns: F.transform_values(columns, lambda _, versions: versions[0]["value"])).alias("cells")
    )


def column_latest(mapped: Column, family: str, qualifier: str) -> Column:
    """The newest (ts, value) of a column in a ``result_map``."""
    versions = F.try_element_at(F.try_element_at(mapped, F.lit(family)), F.lit(qualifier))
    return F.try_element_at(versions, F.lit(1))


def contains_column(mapped: Column, family: str, qualifier: str) -> Column:
    return F.coalesce(F.map_contains_key(F.try_element_at(mapped, F.lit(family)), qualifier), F.lit(False))


def batched(cells: DataFrame, size: int) -> DataFrame:
    """Each cell's part of its row: parts of ``size`` cells in column order, from 0."""
    order = Window.partitionBy("rowkey").orderBy("family", "qualifier", F.desc("ts"))
    return cells.withColumn("part", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def sorted_for_files(cells: DataFrame, parts: int | None = None) -> DataFrame:
    """Cells in key order within partitions that are ranges of keys."""
    dealt = cells.repartitionByRange(parts, "rowkey") if parts else cells.repartitionByRange("rowkey")
    return dealt.sortWithinPartitions("rowkey", "family", "qualifier", F.desc("ts"), F.desc("type"))
