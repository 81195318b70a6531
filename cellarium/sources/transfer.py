"""Export, import, copy and replay of cells as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.comparators import Op, Regex
from cellarium.operators.cells import CELL_COLUMNS, sorted_for_files
from cellarium.operators.scan import ScanSpec, Table
from cellarium.plans.compiler import filter_cells
from cellarium.plans.filters import PrefixFilter, RowFilter


def export_cells(table: Table, versions: int | None = 1, start: int | None = None, end: int | None = None, rows: str | None = None, raw: bool = False) -> DataFrame:
    """The cells of an export.  ``rows`` is a key prefix, or a pattern if it begins with ^."""
    keep: Any = None
    if rows:
        keep = RowFilter(Op.EQUAL, Regex(rows[1:])) if rows.startswith("^") else PrefixFilter(rows)
    return table.scan(ScanSpec(max_versions=versions, time_min=start, time_max=end, filter=keep, raw=raw)).select(*CELL_COLUMNS)


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet in ranges of keys, sorted, so that scans by key skip files and row groups."""
    sorted_for_files(cells.select(*CELL_COLUMNS)).write.mode(mode).parquet(path)


def bulk_load(cells: DataFrame, path: str) -> None:
    """Add sorted files to a table's folder."""
    write_cells(cells, path, "append")


def rename_families(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    out = F.col("family")
    if names:
        out = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("family")], out)
    return cells.withColumn("family", out)


def import_cells(spark: SparkSession, path: str, keep: Any = None, families: dict[str, str] | None = None) -> DataFrame:
    """Cells of an export, deletes included; a filter decides on puts, families may be renamed."""
    cells = spark.read.parquet(path)
    if keep is not None:
        puts = filter_cells(cells.filter("type = 4"), keep)
        cells = puts.unionByName(cells.filter("type <> 4"))
    return rename_families(cells, families or {})


def copy_table(table: Table, start: str = "", stop: str = "", time_min: int | None = None, time_max: int | None = None, versions: int | None = 1, families: Sequence[str] = (), all_cells: bool = False) -> DataFrame:
    """The cells of a copy.  ``families`` lists those to copy, "a:b" for a under the name b."""
    names = dict(f.split(":", 1) if ":" in f else (f, f) for f in families)
    spec = ScanSpec(start=start, stop=stop, time_min=time_min, time_max=time_max, max_versions=None if all_cells else versions, raw=all_cells)
    cells = table.scan(spec)
    if names:
        cells = cells.filter(F.col("family").isin(list(names)))
    return rename_families(cells, names).select(*CELL_COLUMNS)


def replay(log: DataFrame, tables: dict[str, str], start: int | None = None, end: int | None = None) -> DataFrame:
    """Edits of a log (cells with ``table`` and ``written``) for the named tables, under their new names."""
    rows = log.filter(F.col("table").isin(list(tables)))
    if start is not None:
        rows = rows.filter(F.col("written") >= start)
    if end is not None:
        rows = rows.filter(F.col("written") <= end)
    return rows.withColumn("table", F.create_map(*[F.lit(x) for pair in tables.items() for x in pair])[F.col("table")])
