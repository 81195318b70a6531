"""The filter algebra as plain data.

Row filters look at the key, cell filters at one cell, row-set filters at all cells of
a row; stateful ones depend on the order of rows (or of columns within a row).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from cellarium.functions.comparators import Comparator, Op


@dataclass(frozen=True)
class RowFilter:
    op: Op
    comparator: Comparator


@dataclass(frozen=True)
class FamilyFilter:
    op: Op
    comparator: Comparator


@dataclass(frozen=True)
class QualifierFilter:
    op: Op
    comparator: Comparator


@dataclass(frozen=True)
class ValueFilter:
    op: Op
    comparator: Comparator


@dataclass(frozen=True)
class PrefixFilter:
    prefix: str


@dataclass(frozen=True)
class InclusiveStopFilter:
    stop: str


@dataclass(frozen=True)
class FuzzyRowFilter:
    """Pairs of key and mask: 0 in the mask, the byte must match; 1, any does.  Shorter rows match as far as they go."""

    pairs: tuple[tuple[str, tuple[int, ...]], ...]


@dataclass(frozen=True)
class RandomRowFilter:
    """Keeps a row with probability ``chance``, the same one for all its cells; repeatable by seed."""

    chance: float
    seed: int = 0


@dataclass(frozen=True)
class ColumnPrefixFilter:
    prefix: str


@dataclass(frozen=True)
class MultipleColumnPrefixFilter:
    prefixes: tuple[str, ...]


@dataclass(frozen=True)
class ColumnRangeFilter:
    low: str | None
    low_inclusive: bool
    high: str | None
    high_inclusive: bool


@dataclass(frozen=True)
class TimestampsFilter:
    stamps: tuple[int, ...]


@dataclass(frozen=True)
class DependentColumnFilter:
    """Keeps the cells whose time is that of a cell of the reference column (that passes the test, if there is one)."""

    family: str
    qualifier: str
    drop: bool = False
    op: Op | None = None
    comparator: Comparator | None = None


@dataclass(frozen=True)
class SingleColumnValueFilter:
    family: str
    qualifier: str
    op: Op
    comparator: Comparator
    filter_if_missing: bool = False
    latest_only: bool = True


@dataclass(frozen=True)
class SingleColumnValueExcludeFilter(SingleColumnValueFilter):
    """The same, and the tested column leaves the result."""


@dataclass(frozen=True)
class TimeRangeFilter:
    """Keeps rows whose column has a cell with ``start`` <= ts <= ``end`` (-1: open), and of that column only such cells."""

    family: str
    qualifier: str
    start: int = -1
    end: int = -1
    filter_if_missing: bool = False


@dataclass(frozen=True)
class SkipFilter:
    inner: Any


@dataclass(frozen=True)
class WhileMatchFilter:
    inner: Any


@dataclass(frozen=True)
class PageFilter:
    size: int


@dataclass(frozen=True)
class ColumnCountGetFilter:
    limit: int


@dataclass(frozen=True)
class ColumnPaginationFilter:
    limit: int
    offset: int


@dataclass(frozen=True)
class FirstKeyOnlyFilter:
    pass


@dataclass(frozen=True)
class KeyOnlyFilter:
    """Empties values; with ``length`` they become their length in bytes."""

    length: bool = False


@dataclass(frozen=True)
class FilterList:
    filters: tuple[Any, ...]
    all: bool = True


@dataclass(frozen=True)
class UserFilter:
    """A registered function of the columns (rowkey, family, qualifier, ts, value) to a boolean column for each cell."""

    name: str
    arguments: tuple[Any, ...] = field(default=())


#: Functions of user filters, by name.
REGISTRY: dict[str, Callable[..., Any]] = {}


def register_filter(name: str, function: Callable[..., Any]) -> None:
    REGISTRY[name] = function


def conjunction(*filters: Any) -> FilterList:
    return FilterList(tuple(filters), True)


def disjunction(*filters: Any) -> FilterList:
    return FilterList(tuple(filters), False)
