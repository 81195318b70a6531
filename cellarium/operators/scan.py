"""Reads of a table of cells, and of typed tables by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.cells import PUT, FamilySpec, batched
from cellarium.operators.versions import ReadPolicy, resolve
from cellarium.plans import text as filter_text
from cellarium.plans.compiler import filter_cells
from cellarium.plans.filters import DependentColumnFilter, FilterList, InclusiveStopFilter, PageFilter, PrefixFilter, SingleColumnValueFilter, SkipFilter, TimeRangeFilter
from cellarium.sources.store import KeyedFiles, written

#: Filters that decide on whole rows; rows can't be cut into batches before.
ROW_FILTERS = (SingleColumnValueFilter, SkipFilter, PageFilter, DependentColumnFilter, TimeRangeFilter)


@dataclass(frozen=True)
class ScanSpec:
    """A read: keys in [start, stop), columns as "family" or "family:qualifier", time range, versions, filter."""

    start: str = ""
    stop: str = ""
    stop_inclusive: bool = False
    columns: tuple[str, ...] = ()
    time_min: int | None = None
    time_max: int | None = None
    max_versions: int | None = 1
    filter: Any = None
    raw: bool = False
    now: int | None = None
    batch: int | None = None
    limit: int | None = None
    #: Only cells of this time; sets the range.
    timestamp: int | None = None
    #: What a caller hands to observers and user filters; scans don't look at it.
    attributes: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.timestamp is not None:
            object.__setattr__(self, "time_min", self.timestamp)
            object.__setattr__(self, "time_max", self.timestamp + 1)
        if self.raw and self.columns:
            raise ValueError("a raw scan takes no columns")
        if self.batch is not None and _decides_rows(self.filter):
            raise ValueError("rows can't be cut into batches under a filter on whole rows")
        if self.time_min is not None and self.time_max is not None and self.time_min > self.time_max:
            raise ValueError("the time range ends before it begins")


def _decides_rows(f: Any) -> bool:
    if isinstance(f, FilterList):
        return any(map(_decides_rows, f.filters))
    return isinstance(f, ROW_FILTERS)


def key_range(key: Column, start: Any, stop: Any, stop_inclusive: bool = False) -> Column:
    """An empty bound is open."""
    out = F.lit(True)
    if start not in ("", None):
        out = out & (key >= start)
    if stop not in ("", None):
        out = out & ((key <= stop) if stop_inclusive else (key < stop))
    return out


def after_prefix(prefix: str) -> str:
    """The first key after all that begin with ``prefix``; "" if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            follower = ord(prefix[i]) + 1
            # Surrogates are no characters.
            return prefix[:i] + chr(0xE000 if 0xD800 <= follower <= 0xDFFF else follower)
    return ""


def column_choice(columns: Sequence[str]) -> Column:
    """Families and columns; a family takes all of its columns, whatever columns are named beside it."""
    families = [c for c in columns if ":" not in c]
    out = F.col("family").isin(families) if families else F.lit(False)
    for c in columns:
        if ":" in c:
            family, qualifier = c.split(":", 1)
            out = out | ((F.col("family") == family) & (F.col("qualifier") == qualifier))
    return out


@dataclass(frozen=True)
class Table:
    """Cells with the policies of their families.  ``tombstones`` and ``ties``: see ``resolve``.

    ``files``: the same cells as keyed files, of which a read of a key range opens only those that meet it.
    """

    cells: DataFrame
    families: dict[str, FamilySpec] = field(default_factory=dict)
    default: FamilySpec = FamilySpec(max_versions=1 << 30)
    tombstones: bool = True
    ties: bool = True
    files: KeyedFiles | None = None

    @staticmethod
    def of_files(files: KeyedFiles, **options: Any) -> Table:
        return Table(files.rows(), files=files, **options)

    def _between(self, spec: ScanSpec) -> DataFrame:
        here = self.files.between(spec.start, spec.stop) if self.files and (spec.start or spec.stop) else self.cells
        return here.filter(key_range(F.col("rowkey"), spec.start, spec.stop, spec.stop_inclusive))

    def _narrowed(self, spec: ScanSpec, f: Any) -> ScanSpec:
        """A filter that bounds the keys bounds the files, too."""
        start, stop, inclusive = spec.start, spec.stop, spec.stop_inclusive
        for part in f.filters if isinstance(f, FilterList) and f.all else (f,):
            if not isinstance(part, (PrefixFilter, InclusiveStopFilter)):
                # What follows another filter sees only what that one left; pages are counted before it.
                break
            if isinstance(part, PrefixFilter) and part.prefix > start:
                start = part.prefix
            if isinstance(part, PrefixFilter) and (after := after_prefix(part.prefix)) and (not stop or after < stop):
                stop, inclusive = after, False
            if isinstance(part, InclusiveStopFilter) and (not stop or part.stop < stop):
                stop, inclusive = part.stop, True
        return replace(spec, start=start, stop=stop, stop_inclusive=inclusive)

    def scan(self, spec: ScanSpec | None = None, **options: Any) -> DataFrame:
        """The cells a scan returns.  A ``filter`` may be a text of the filter language."""
        spec = replace(spec or ScanSpec(), **options)
        f = filter_text.parse(spec.filter) if isinstance(spec.filter, str) else spec.filter
        rows = self._between(self._narrowed(spec, f))
        if spec.columns:
            # Tombstones of the family stay for the resolution.
            rows = rows.filter(column_choice(spec.columns) | ((F.col("type") == 14) & F.col("family").isin([c.split(":")[0] for c in spec.columns])))
        if spec.limit is not None and f is None and not self.tombstones and spec.now is None and spec.time_min is None and spec.time_max is None and not spec.raw:
            # Every row that is there has something to show: the last key is known before anything is resolved.
            first = rows.select("rowkey").distinct().orderBy("rowkey").limit(spec.limit)
            rows = rows.filter(F.col("rowkey") <= first.agg(F.max("rowkey")).scalar())
            spec = replace(spec, limit=None)
        if not spec.raw and (spec.batch is not None or (self.tombstones and _decides_rows(f))):
            # One shuffle by row serves the windows over columns and over rows.
            rows = rows.repartition("rowkey")
        policy = ReadPolicy(spec.max_versions, spec.time_min, spec.time_max, spec.now, spec.raw)
        apply_filter = (lambda cells: filter_cells(cells, f)) if f is not None else None
        out = resolve(rows, policy, self.families, self.default, self.tombstones, self.ties, apply_filter)
        if spec.limit is not None:
            keys = out.select("rowkey").distinct().orderBy("rowkey").limit(spec.limit)
            out = out.filter(F.col("rowkey") <= keys.agg(F.max("rowkey")).scalar())
        return batched(out, spec.batch) if spec.batch is not None else out

    def get(self, rowkey: str, **options: Any) -> DataFrame:
        return self.scan(start=rowkey, stop=rowkey, stop_inclusive=True, **options)

    def multi_get(self, keys: DataFrame, key: str, **options: Any) -> DataFrame:
        """The cells of each row of ``keys``; a key without cells gives one row of NULLs."""
        wanted = keys.select(F.col(key).cast("string").alias("rowkey"))
        rows = replace(self, cells=self.cells.join(wanted.distinct(), "rowkey", "left_semi"), files=None).scan(**options)
        return wanted.join(rows, "rowkey", "left")

    def exists(self, rowkey: str, **options: Any) -> bool:
        return not self.get(rowkey, **options).isEmpty()

    def row_or_before(self, rowkey: str, family: str) -> DataFrame:
        """The family's cells of the greatest row that is not after ``rowkey``.

        Without tombstones the greatest key is found first, and only its row resolved.
        """
        if not self.tombstones:
            there = self._between(ScanSpec(stop=rowkey, stop_inclusive=True)).filter((F.col("family") == family) & (F.col("type") == PUT))
            return replace(self, cells=there.filter(F.col("rowkey") == there.agg(F.max("rowkey")).scalar()), files=None).scan(columns=(family,))
        seen = self.scan(stop=rowkey, stop_inclusive=True, columns=(family,))
        return seen.filter(F.col("rowkey") == seen.agg(F.max("rowkey")).scalar())

    def cursor(self, size: int, **options: Any) -> Iterator[list[Row]]:
        """The scan's cells in key order, at most ``size`` rows of the table at once; each step reads on from the last key."""
        after = options.pop("start", "")
        while True:
            page = self.scan(start=after, limit=size, **options).orderBy("rowkey", "family", "qualifier", F.desc("ts")).collect()
            if page:
                yield page
            if len({r["rowkey"] for r in page}) < size:
                return
            after = page[-1]["rowkey"] + "\x00"

    def count(self, **options: Any) -> int:
        return self.scan(**options).select("rowkey").distinct().count()


def multi_table(scans: dict[str, tuple[Table, ScanSpec]]) -> DataFrame:
    """Scans of several tables, one after the other, with the table's name."""
    out = None
    for name, (table, spec) in scans.items():
        part = table.scan(spec).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no scan")
    return out


def salted_scan(df: DataFrame, key: str, salts: Sequence[str], start: str, stop: str) -> DataFrame:
    """Rows whose key is a salt followed by a key in [start, stop), for any of the salts."""
    out = F.lit(False)
    for salt in salts:
        out = out | ((F.col(key) >= salt + start) & (F.col(key) < salt + stop))
    return df.filter(out)


def as_of(keys: DataFrame, df: DataFrame, key: str, probe: str) -> DataFrame:
    """For each row of ``keys`` the row of ``df`` (``match``) with the greatest ``key`` not after ``probe``.

    Rows of both sides are dealt together to ranges and sorted there; each range hands its last row on
    to the next ones (one row for each range), so that no range waits for another.  Equal keys and probes may
    be dealt to several ranges.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_at"), F.lit(0).alias("_kind"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    asks = keys.select(F.col(probe).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in keys.columns]).alias("_ask"))
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("_tie", F.monotonically_increasing_id())
    both = written(both.repartitionByRange("_at", "_kind", "_tie").withColumn("_part", F.spark_partition_id()), "as-of")
    inside = Window.partitionBy("_part").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_row", ignorenulls=True).over(inside))
    ends = both.groupBy("_part").agg(F.max_by("_row", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = seen.filter("_kind = 1").join(F.broadcast(carried), "_part", "left")
    # A NULL probe is before every key.
    return out.select("_ask.*", F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_carried")).alias("match"))


__all__ = ["ScanSpec", "Table", "as_of", "column_choice", "key_range", "multi_table", "salted_scan"]
