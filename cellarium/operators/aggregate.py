"""Aggregates over the cells of a family or column: partial sums in each partition, then one merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.sources.store import written


@dataclass(frozen=True)
class Interpreter:
    """How values are read, and how sums are rounded."""

    read: Callable[[Column], Column]
    total: Callable[[Column], Column] = F.try_sum
    settle: Callable[[Column], Column] = lambda c: c


#: Values that are not whole numbers are no values; a sum beyond 64 bits is NULL.
LONG = Interpreter(lambda v: v.try_cast("bigint"))
DOUBLE = Interpreter(lambda v: v.try_cast("double"), F.sum)
#: Two digits after the point, halves to the even digit.
DECIMAL = Interpreter(lambda v: F.bround(v.try_cast("decimal(36,6)"), 2).cast("decimal(36,2)"), F.sum, lambda c: F.bround(c, 2))


MEASURES = ("max", "min", "sum", "row_count", "avg", "std")


def check_bounds(start: str, stop: str, families: list[str]) -> None:
    if len(families) != 1:
        raise ValueError("an aggregate takes exactly one family")
    if stop and start >= stop:
        raise ValueError("the first key must lie before the last")


def aggregate(cells: DataFrame, family: str, qualifier: str | None = None, start: str = "", stop: str = "", interpreter: Interpreter = LONG, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row of the ``measures``: max, min, sum, row_count, avg (sum over rows) and std (of each row's sum, of the whole population).

    ``cells`` are visible cells.  Rows whose cells can't be read count as rows, not as values.  Only measures of rows
    gather the cells of a row first.
    """
    check_bounds(start, stop, [family])
    rows = cells.filter(F.col("family") == family)
    if qualifier is not None:
        rows = rows.filter(F.col("qualifier") == qualifier)
    if start:
        rows = rows.filter(F.col("rowkey") >= start)
    if stop:
        rows = rows.filter(F.col("rowkey") < stop)
    value = interpreter.read(F.col("value"))
    if set(measures) <= {"max", "min", "sum"}:
        v = rows.select(value.alias("_v"))
        return v.agg(F.max("_v").alias("max"), F.min("_v").alias("min"), interpreter.settle(interpreter.total(F.col("_v"))).alias("sum")).select(*measures)
    per_row = rows.withColumn("_v", value).groupBy("rowkey").agg(interpreter.total(F.col("_v")).alias("_sum"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
    total = interpreter.settle(interpreter.total(F.col("_sum")))
    return per_row.agg(
        F.max("_max").alias("max"),
        F.min("_min").alias("min"),
        total.alias("sum"),
        F.count(F.lit(1)).alias("row_count"),
        (total.cast("double") / F.count(F.lit(1))).alias("avg"),
        F.stddev_pop(F.col("_sum").cast("double")).alias("std"),
    ).select(*measures)


def running_median(df: DataFrame, key: str, value: str, weight: str | None = None, parts: int | None = None) -> DataFrame:
    """The value before the one at which the running sum of weights, in the order of key and value, first exceeds half of all.

    The weight is the value itself if none is named.  Ranges of keys are summed first; only the range in
    which the sum crosses half is sorted row by row.  Equal keys and values may be dealt to several ranges.
    """
    w = F.coalesce(F.col(weight or value).cast("double"), F.lit(0.0))
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"), w.alias("w")).filter("v IS NOT NULL").withColumn("tie", F.monotonically_increasing_id())
    order = ["k", "v", "tie"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    dealt = written(ranged.withColumn("part", F.spark_partition_id()), "median")
    sums = dealt.groupBy("part").agg(F.sum("w").alias("w"), F.max_by("v", F.struct(*order)).alias("final"))
    by_part = Window.orderBy("part")
    sums = sums.select(
        "part",
        F.coalesce(F.sum("w").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("begin"),
        F.sum("w").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("end"),
        (F.sum("w").over(Window.partitionBy()) / 2).alias("half"),
        F.lag("final").over(by_part).alias("before"),
    )
    crossing = sums.filter("end > half").orderBy("part").limit(1)
    inside = dealt.join(F.broadcast(crossing), "part")
    upto = Window.partitionBy("part").orderBy(*order)
    marked = inside.withColumn("run", F.col("begin") + F.sum("w").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.withColumn("prior", F.coalesce(F.lag("v").over(upto), F.col("before")))
    return marked.filter("run > half").agg(F.min_by("prior", F.struct(*order)).alias("median"))


def true_median(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.median(value).alias("median"))
