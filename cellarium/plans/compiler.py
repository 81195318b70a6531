"""Filters compiled to columns.

On cells, a filter becomes two booleans: whether it takes the cell, and whether it
takes the row.  AND runs its parts in turn, each seeing what the ones before left;
OR takes a cell that one part takes, and drops a row that all parts drop.  Cells are
filtered first, then rows, so a row of which no cell is left is gone.

Filters that look at keys or at single cells become plain predicates, which Catalyst
can push down.  Those that look at a whole row become windows by rowkey, which share
one shuffle.  Those that look at the order of rows get a bound as a scalar subquery, whatever
the partitioning.

On typed tables (one column per qualifier) filters on rows and named columns
compile to one predicate and keep the scan columnar.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.plans import filters as A

def fuzzy_match(key: Column, pairs: tuple[tuple[str, tuple[int, ...]], ...]) -> Column:
    out = F.lit(False)
    data = key.cast("binary")
    for pattern, mask in pairs:
        raw = pattern.encode()
        if len(raw) != len(mask):
            raise ValueError("key and mask differ in length")
        fits = F.lit(True)
        for i, (byte, free) in enumerate(zip(raw, mask, strict=True)):
            if not free:
                fits = fits & ((F.octet_length(data) <= i) | (F.substring(data, i + 1, 1) == F.lit(bytes([byte]))))
        out = out | fits
    return out


def key_predicate(f: Any, key: Column) -> Column | None:
    """The predicate of a filter on the row key, None for others."""
    match f:
        case A.RowFilter(op, comparator):
            return comparator.test(op, key)
        case A.PrefixFilter(prefix):
            return key.startswith(prefix)
        case A.InclusiveStopFilter(stop):
            return key <= stop
        case A.FuzzyRowFilter(pairs):
            return fuzzy_match(key, pairs)
        case A.RandomRowFilter(chance, seed):
            # A hash of the key, so that all cells of a row share one draw and reruns agree.
            digits = F.substring(F.md5(F.concat(key, F.lit(f"/{seed}")).cast("binary")), 1, 13)
            return F.conv(digits, 16, 10).cast("double") / float(1 << 52) < chance
    return None


class CellCompiler:
    """Collects the helper columns that a filter needs on a DataFrame of cells."""

    def __init__(self, cells: DataFrame):
        self.df = cells
        self.used = 0
        self.empty_values: list[bool] = []
        self.dropped_columns: list[tuple[str, str]] = []

    def _add(self, made: Column) -> Column:
        name = f"_f{self.used}"
        self.used += 1
        self.df = self.df.withColumn(name, made)
        return F.col(name)

    def apply(self, f: Any) -> DataFrame:
        columns = list(self.df.columns)
        cell, row = self.compile(f, F.lit(True), F.lit(True))
        out = self.df.filter(cell & row)
        for family, qualifier in self.dropped_columns:
            out = out.filter(~((F.col("family") == family) & (F.col("qualifier") == qualifier)))
        for length in self.empty_values:
            out = out.withColumn("value", F.octet_length("value").cast("string") if length else F.lit(""))
        return out.select(*columns)

    def compile(self, f: Any, seen: Column, row_seen: Column) -> tuple[Column, Column]:
        """(cell, row) of ``f`` where ``seen`` tells which cells earlier filters left and ``row_seen`` which rows."""
        yes = F.lit(True)
        on_key = key_predicate(f, F.col("rowkey"))
        if on_key is not None:
            # Both, so that an OR takes the cells of such rows only.
            return on_key, on_key
        whole_row = Window.partitionBy("rowkey")
        in_row = whole_row.orderBy("family", "qualifier", F.desc("ts"), F.desc("seq"))
        match f:
            case A.FamilyFilter(op, comparator):
                return comparator.test(op, F.col("family")), yes
            case A.QualifierFilter(op, comparator):
                return comparator.test(op, F.col("qualifier")), yes
            case A.ValueFilter(op, comparator):
                return comparator.test(op, F.col("value")), yes
            case A.ColumnPrefixFilter(prefix):
                return F.col("qualifier").startswith(prefix), yes
            case A.MultipleColumnPrefixFilter(prefixes):
                out = F.lit(False)
                for prefix in prefixes:
                    out = out | F.col("qualifier").startswith(prefix)
                return out, yes
            case A.ColumnRangeFilter(low, low_inclusive, high, high_inclusive):
                q, out = F.col("qualifier"), F.lit(True)
                if low:
                    out = out & ((q >= low) if low_inclusive else (q > low))
                if high:
                    out = out & ((q <= high) if high_inclusive else (q < high))
                return out, yes
            case A.TimestampsFilter(stamps):
                return F.col("ts").isin(list(stamps)), yes
            case A.UserFilter(name, arguments):
                return A.REGISTRY[name](*[F.col(c) for c in ("rowkey", "family", "qualifier", "ts", "value")], *arguments), yes
            case A.KeyOnlyFilter(length):
                self.empty_values.append(length)
                return yes, yes
            case A.FirstKeyOnlyFilter():
                first = F.sum(F.when(seen, 1).otherwise(0)).over(in_row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                return self._add(first) == 1, yes
            case A.ColumnCountGetFilter(limit):
                return self._column_number(seen) <= limit, yes
            case A.ColumnPaginationFilter(limit, offset):
                number = self._column_number(seen)
                return (number > offset) & (number <= offset + limit), yes
            case A.DependentColumnFilter(family, qualifier, drop, op, comparator):
                here = (F.col("family") == family) & (F.col("qualifier") == qualifier)
                passes = F.lit(True) if comparator is None else F.coalesce(comparator.test(op, F.col("value")), F.lit(False))
                stamps = self._add(F.max(F.when(seen & here & passes, 1).otherwise(0)).over(Window.partitionBy("rowkey", "ts")))
                kept = (stamps == 1) & (~here | passes)
                return (kept & ~here) if drop else kept, yes
            case A.TimeRangeFilter(family, qualifier, start, end, missing):
                here = (F.col("family") == family) & (F.col("qualifier") == qualifier)
                inside = F.lit(True)
                inside = inside & (F.col("ts") >= start) if start >= 0 else inside
                inside = inside & (F.col("ts") <= end) if end >= 0 else inside
                found = self._add(F.max(F.when(seen & here, inside)).over(whole_row))
                return ~here | inside, F.coalesce(found, F.lit(not missing))
            case A.SingleColumnValueFilter(family, qualifier, op, comparator, missing, latest):
                here = seen & (F.col("family") == family) & (F.col("qualifier") == qualifier)
                test = F.coalesce(comparator.test(op, F.col("value")), F.lit(False))
                if latest:
                    found = self._add(F.max(F.when(here, F.struct("ts", "seq", test.alias("ok")))).over(whole_row))["ok"]
                else:
                    found = self._add(F.max(F.when(here, test)).over(whole_row))
                if isinstance(f, A.SingleColumnValueExcludeFilter):
                    self.dropped_columns.append((family, qualifier))
                return yes, F.coalesce(found, F.lit(not missing))
            case A.SkipFilter(inner):
                cell, row = self.compile(inner, seen, row_seen)
                every = self._add(F.min(F.when(seen, F.coalesce(cell, F.lit(False)))).over(whole_row))
                return yes, row & F.coalesce(every, F.lit(True))
            case A.WhileMatchFilter(inner):
                cell, row = self.compile(inner, seen, row_seen)
                rejected = seen & row_seen & ~(F.coalesce(cell, F.lit(False)) & F.coalesce(row, F.lit(False)))
                bound = self.df.filter(rejected).agg(F.min(F.struct("rowkey", "family", "qualifier", (-F.col("ts")).alias("age"))).alias("b")).scalar()
                row_rejected = self.df.filter(seen & row_seen & ~F.coalesce(row, F.lit(False))).agg(F.min("rowkey")).scalar()
                here = F.struct("rowkey", "family", "qualifier", (-F.col("ts")).alias("age"))
                # Cells of the boundary row before the first rejection stay.
                return bound.isNull() | (here < bound), row_rejected.isNull() | (F.col("rowkey") < row_rejected)
            case A.PageFilter(size):
                rows = self.df.filter(seen & row_seen).select("rowkey").distinct().orderBy("rowkey").limit(size)
                last = rows.agg(F.max("rowkey")).scalar()
                return yes, F.coalesce(F.col("rowkey") <= last, F.lit(False))
            case A.FilterList(parts, True):
                cell, row = F.lit(True), F.lit(True)
                for part in parts:
                    c, r = self.compile(part, seen & cell, row_seen & row)
                    cell, row = cell & F.coalesce(c, F.lit(False)), row & F.coalesce(r, F.lit(False))
                return cell, row
            case A.FilterList(parts, False):
                cell, row = F.lit(False), F.lit(False)
                for part in parts:
                    c, r = self.compile(part, seen, row_seen)
                    cell, row = cell | F.coalesce(c, F.lit(False)), row | F.coalesce(r, F.lit(False))
                return cell, row
        raise TypeError(f"no cell form of {type(f).__name__}")

    def _column_number(self, seen: Column) -> Column:
        """The number of a cell's column among the row's columns that are seen, from 1."""
        order = Window.partitionBy("rowkey").orderBy("family", "qualifier")
        number = self._add(F.dense_rank().over(order))
        some = self._add(F.max(F.when(seen, 1).otherwise(0)).over(Window.partitionBy("rowkey", "family", "qualifier")))
        # Columns of which nothing is seen don't count.
        changes = self._add(F.lag(number, 1, 0).over(order))
        unseen = F.sum(F.when((some == 0) & (changes != number), 1).otherwise(0)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return number - self._add(unseen)


def filter_cells(cells: DataFrame, f: Any) -> DataFrame:
    return CellCompiler(cells).apply(f)


def typed_predicate(f: Any, key: Column, column: Any = None) -> Column:
    """The predicate of a filter on a typed table; ``column(family, qualifier)`` names a column (default: the qualifier)."""
    named = column or (lambda family, qualifier: F.col(qualifier))
    on_key = key_predicate(f, key)
    if on_key is not None:
        return F.coalesce(on_key, F.lit(False))
    match f:
        case A.SingleColumnValueFilter(family, qualifier, op, comparator, missing, _):
            c = named(family, qualifier)
            return F.when(c.isNull(), F.lit(not missing)).otherwise(comparator.test(op, c)) if not missing else F.coalesce(comparator.test(op, c), F.lit(False))
        case A.FilterList(parts, every):
            out = F.lit(every)
            for part in parts:
                p = typed_predicate(part, key, column)
                out = (out & p) if every else (out | p)
            return out
    raise TypeError(f"{type(f).__name__} needs cells")


def excluded_columns(f: Any) -> list[str]:
    """Columns that filters tested and remove from the result."""
    if isinstance(f, A.SingleColumnValueExcludeFilter):
        return [f.qualifier]
    if isinstance(f, A.FilterList):
        return [c for part in f.filters for c in excluded_columns(part)]
    return []


def filter_typed(df: DataFrame, f: Any, key: Column) -> DataFrame:
    return df.filter(typed_predicate(f, key)).drop(*excluded_columns(f))


__all__ = ["CellCompiler", "filter_cells", "filter_typed", "key_predicate", "typed_predicate"]
