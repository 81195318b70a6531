"""Batch jobs: counts of rows and cells, counters, grouping, sinks of several tables, and user maps over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.scan import column_choice, key_range


def row_counter(cells: DataFrame, columns: Sequence[str] = (), start: str = "", stop: str = "") -> DataFrame:
    """``rows``: the number of rows with a cell in the columns (all, if none is named)."""
    rows = cells.filter(key_range(F.col("rowkey"), start, stop))
    if columns:
        rows = rows.filter(column_choice(columns))
    return rows.agg(F.count_distinct("rowkey").alias("rows"))


def cell_counter(cells: DataFrame, separator: str = ":") -> DataFrame:
    """(name, n): totals of rows, families and qualifiers across rows; rows of each family and column; versions of each cell.

    One aggregation gives the versions of each (row, family, qualifier).  The first column of a row, and of a
    family in it, stand for the row and the family; every column then gives its share of the names it counts for.
    """
    versions = cells.groupBy("rowkey", "family", "qualifier").agg(F.count(F.lit(1)).alias("n"))
    column = F.concat("family", F.lit(separator), "qualifier")
    order = Window.partitionBy("rowkey").orderBy("family", "qualifier")
    marked = versions.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("family").over(order))
    opens_family = F.col("before").isNull() | (F.col("before") != F.col("family"))
    one = F.lit(1).cast("long")
    shares = F.array(
        F.when(F.col("place") == 1, F.struct(F.lit("Total ROWS").alias("name"), one.alias("n"))),
        F.when(opens_family, F.struct(F.lit("Total Families Across all Rows").alias("name"), one.alias("n"))),
        F.struct(F.lit("Total Qualifiers across all Rows").alias("name"), one.alias("n")),
        F.when(opens_family, F.struct(F.col("family").alias("name"), one.alias("n"))),
        F.struct(column.alias("name"), one.alias("n")),
        F.struct(F.concat("rowkey", F.lit(separator), column, F.lit("_Versions")).alias("name"), F.col("n")),
    )
    return marked.select(F.explode(F.array_compact(shares)).alias("s")).groupBy("s.name").agg(F.sum("s.n").alias("n"))


def group_key(df: DataFrame, columns: Sequence[str], name: str = "group_key") -> DataFrame:
    """Rows that have all of the columns, with their values joined by a space."""
    return df.dropna(subset=list(columns)).withColumn(name, F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters: ``observation.get`` has them once an action has run over it.  Each is an aggregate of ``df``'s columns."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def write_tables(rows: DataFrame, root: str, table: str = "table", mode: str = "append") -> None:
    """A sink of several tables: each row goes to the table that its column ``table`` names, ``root``/<table>, in one pass.

    Rows that name no table are an error.
    """
    name = F.when(F.col(table).isNull(), F.raise_error(F.lit("a row names no table"))).otherwise(F.col(table))
    rows.withColumn(table, name).write.mode(mode).partitionBy(table).parquet(root)


def read_written_table(spark: SparkSession, root: str, name: str, table: str = "table") -> DataFrame:
    """One of the tables of ``write_tables``."""
    return spark.read.option("basePath", root).parquet(root).filter(F.col(table) == name).drop(table)


def map_rows(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """A user's map over batches of rows (pandas frames)."""
    return df.mapInPandas(function, schema)


def reduce_groups(df: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """A user's reduction of each group (a pandas frame, which must fit a worker)."""
    return df.groupBy(*keys).applyInPandas(function, schema)
