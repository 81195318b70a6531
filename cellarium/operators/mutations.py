"""Mutations as functions from cells and edits to cells: an edit appends, a read resolves."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.functions.comparators import Binary, Comparator, Op
from cellarium.operators.cells import CELL_COLUMNS, COORDINATES, DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT, FamilySpec
from cellarium.operators.versions import ReadPolicy, keeps_deleted, resolve


def _edit(df: DataFrame, kind: int, value: Column, seq: Column | int) -> DataFrame:
    stamp = F.lit(seq) if isinstance(seq, int) else seq
    qualifier = F.col("qualifier") if "qualifier" in df.columns else F.lit(None).cast("string")
    return df.select("rowkey", "family", qualifier.alias("qualifier"), F.col("ts").cast("long").alias("ts"), F.lit(kind).cast("tinyint").alias("type"), value.alias("value"), stamp.cast("long").alias("seq"))


def put(df: DataFrame, seq: Column | int) -> DataFrame:
    """Edits that write (rowkey, family, qualifier, ts, value)."""
    return _edit(df, PUT, F.col("value"), seq)


def delete_version(df: DataFrame, seq: Column | int) -> DataFrame:
    return _edit(df, DELETE, F.lit(None).cast("string"), seq)


def delete_column(df: DataFrame, seq: Column | int) -> DataFrame:
    return _edit(df, DELETE_COLUMN, F.lit(None).cast("string"), seq)


def delete_family(df: DataFrame, seq: Column | int) -> DataFrame:
    return _edit(df, DELETE_FAMILY, F.lit(None).cast("string"), seq)


def delete_row(df: DataFrame, families: Sequence[str], seq: Column | int) -> DataFrame:
    """Edits that delete (rowkey, ts) in every family."""
    return delete_family(df.select("rowkey", "ts", F.explode(F.array(*map(F.lit, families))).alias("family")), seq)


def apply(cells: DataFrame, *edits: DataFrame) -> DataFrame:
    """Cells and edits together; a batch of different edits is their union."""
    out = cells.select(*CELL_COLUMNS)
    for edit in edits:
        out = out.unionByName(edit.select(*CELL_COLUMNS))
    return out


def newest(cells: DataFrame, **options: Any) -> DataFrame:
    return resolve(cells, ReadPolicy(max_versions=1, **options))


def _split_touched(cells: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells that can matter for the ``touched`` coordinates, and all others but those coordinates' own.

    A family's marker has no qualifier: those of touched families are in both.
    """
    own = cells.join(touched.select(*COORDINATES), COORDINATES, "left_semi")
    marks = cells.filter(F.col("type") == DELETE_FAMILY).join(touched.select("rowkey", "family").distinct(), ["rowkey", "family"], "left_semi")
    return own.unionByName(marks), cells.join(touched.select(*COORDINATES), COORDINATES, "left_anti")


def increment(cells: DataFrame, amounts: DataFrame, ts: int, seq: int, **options: Any) -> DataFrame:
    """Add (rowkey, family, qualifier, amount) to the newest values; absent ones start at 0.

    Amounts for one column are summed before the join, and only the columns they touch are resolved.  A value
    that is no whole number is an error.  The new value replaces the column's cells: older ones of a counter are not kept.
    """
    summed = amounts.groupBy(*COORDINATES).agg(F.sum("amount").alias("amount"))
    own, rest = _split_touched(cells, summed)
    now = newest(own, **options).select(*COORDINATES, "value")
    number = F.col("value").try_cast("bigint")
    bad = F.col("value").isNotNull() & number.isNull()
    fresh = summed.join(now, COORDINATES, "left").select(
        *COORDINATES,
        F.lit(ts).cast("long").alias("ts"),
        F.when(bad, F.raise_error(F.lit("the value to be incremented is not a number"))).otherwise((F.coalesce(number, F.lit(0)) + F.col("amount")).cast("string")).alias("value"),
    )
    return apply(rest, put(fresh, seq))


def append(cells: DataFrame, pieces: DataFrame, ts: int, seq: int) -> DataFrame:
    """Append (rowkey, family, qualifier, value, n) to the newest values, in the order of n."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda p: p["value"]), "")
    joined = pieces.groupBy(*COORDINATES).agg(ordered.alias("more"))
    own, rest = _split_touched(cells, joined)
    now = newest(own).select(*COORDINATES, "value")
    fresh = joined.join(now, COORDINATES, "left").select(*COORDINATES, F.lit(ts).cast("long").alias("ts"), F.concat(F.coalesce("value", F.lit("")), "more").alias("value"))
    return apply(rest, put(fresh, seq))


def check_and_mutate(cells: DataFrame, checks: DataFrame, edits: DataFrame, op: Op = Op.EQUAL) -> DataFrame:
    """Apply the edits of the rows whose check holds; all checks see one snapshot.

    ``checks`` has (rowkey, family, qualifier, expected); an expected NULL or "" fits an absent or empty
    cell.  Operators read "stored op expected", as filters do.  Of several checks of one row one is enough.
    """
    now = newest(cells).select(*COORDINATES, "value")
    met = checks.join(now, COORDINATES, "left")
    stored, expected = F.coalesce("value", F.lit("")), F.coalesce("expected", F.lit(""))
    tests = {Op.LESS: stored < expected, Op.LESS_OR_EQUAL: stored <= expected, Op.EQUAL: stored == expected, Op.NOT_EQUAL: stored != expected, Op.GREATER_OR_EQUAL: stored >= expected, Op.GREATER: stored > expected}
    held = met.filter(tests[op]).select("rowkey").distinct()
    return apply(cells, edits.join(held, "rowkey", "left_semi"))


def check_value(cells: DataFrame, family: str, qualifier: str, comparator: Comparator = Binary("")) -> DataFrame:
    """Row keys whose newest value of a column passes a comparator."""
    here = (F.col("family") == family) & (F.col("qualifier") == qualifier)
    return newest(cells).filter(here & comparator.test(Op.EQUAL, F.col("value"))).select("rowkey")


def bulk_delete(cells: DataFrame, matched: DataFrame, what: str, ts: int, seq: int) -> tuple[DataFrame, DataFrame]:
    """Delete rows, families, columns or versions of the ``matched`` cells; also the counts of rows and versions."""
    if what in ("row", "family"):
        edits = delete_family(matched.select("rowkey", "family").distinct().withColumn("ts", F.lit(ts)), seq)
        if what == "row":
            families = cells.select("rowkey", "family").distinct().join(matched.select("rowkey").distinct(), "rowkey", "left_semi")
            edits = delete_family(families.withColumn("ts", F.lit(ts)), seq)
    elif what == "column":
        edits = delete_column(matched.select(*COORDINATES).distinct().withColumn("ts", F.lit(ts)), seq)
    elif what == "version":
        edits = delete_version(matched.select(*COORDINATES, "ts").distinct(), seq)
    else:
        raise ValueError(f"can't delete by {what}")
    counts = matched.agg(F.count_distinct("rowkey").alias("rows"), F.count(F.lit(1)).alias("versions"))
    return apply(cells, edits), counts


def major_compact(cells: DataFrame, families: dict[str, FamilySpec] | None = None, default: FamilySpec = FamilySpec(), now: int | None = None) -> DataFrame:
    """What reads can see, and nothing else: no expired or surplus versions, and no tombstones with what they mask.

    Families that keep deleted cells keep them, up to their number of versions, and of their tombstones
    those that mask a cell that is kept: a read of a time before the deletion sees what it saw.
    """
    families = families or {}
    if not any(s.keep_deleted for s in [*families.values(), default]):
        return resolve(cells, ReadPolicy(max_versions=None, now=now), families, default)
    keeps = keeps_deleted(families, default)
    plain = resolve(cells.filter(~keeps), ReadPolicy(max_versions=None, now=now), families, default)
    kept = cells.filter(keeps)
    puts = resolve(kept, ReadPolicy(max_versions=None, now=now), families, default, tombstones=False)
    column = puts.groupBy(*COORDINATES).agg(F.min("ts").alias("_oldest"))
    family = column.groupBy("rowkey", "family").agg(F.min("_oldest").alias("_oldest"))
    of_family = kept.filter(F.col("type") == DELETE_FAMILY).join(family, ["rowkey", "family"]).filter("ts >= _oldest")
    of_column = kept.filter(F.col("type") == DELETE_COLUMN).join(column, COORDINATES).filter("ts >= _oldest")
    of_version = kept.filter(F.col("type") == DELETE).join(puts.select(*COORDINATES, "ts"), [*COORDINATES, "ts"], "left_semi")
    marks = [m.select(*CELL_COLUMNS) for m in (of_family, of_column, of_version)]
    return apply(plain, puts, *marks)


def latest_of_log(log: DataFrame) -> DataFrame:
    """The last edit of each (column, ts) of a log."""
    order = Window.partitionBy(*COORDINATES, "ts", "type").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
