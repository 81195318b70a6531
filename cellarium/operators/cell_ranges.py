"""Range queries on cells: ranges become filters, with times where a range has them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from cellarium.functions.comparators import Binary, Op
from cellarium.operators.ranges import Range
from cellarium.operators.scan import Table
from cellarium.plans.filters import FilterList, SingleColumnValueFilter, TimeRangeFilter

_OPS = {op.value: op for op in Op}


@dataclass(frozen=True)
class CellRange:
    """A range of ``family:qualifier``; with times, a cell of the column must lie between them, ends included (-1: open)."""

    family: str
    range: Range
    start: int = -1
    end: int = -1

    def filters(self) -> list[Any]:
        out: list[Any] = [SingleColumnValueFilter(self.family, self.range.column, _OPS[op], Binary(v), True) for op, v in self.range.tests]
        if self.start >= 0 or self.end >= 0:
            # First, so that the values tested are those of the time range.
            out.insert(0, TimeRangeFilter(self.family, self.range.column, self.start, self.end, True))
        return out


def range_filter(dnf: Sequence[Sequence[CellRange]]) -> FilterList:
    """OR of ANDs as one filter."""
    parts = [FilterList(tuple(f for r in conjunct for f in r.filters())) for conjunct in dnf]
    return parts[0] if len(parts) == 1 else FilterList(tuple(parts), False)


def range_scan(table: Table, dnf: Sequence[Sequence[CellRange]], **options: Any) -> DataFrame:
    return table.scan(filter=range_filter(dnf), **options)
