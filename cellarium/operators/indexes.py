"""Secondary indexes: key-only, covering and clustered copies, statistics, and the choice between them.

An index answers the same range query as the table.  Results never depend on which is
chosen; a sorted copy lets Parquet skip row groups that the table would have to read.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.ranges import NEVER, Dnf, Range, predicate
from cellarium.sources.store import KeyedFiles, stored, written


@dataclass(frozen=True)
class IndexSpec:
    """``kind``: secondary (keys), covering (keys and ``include``) or clustered (whole rows)."""

    column: str
    kind: str = "secondary"
    include: tuple[str, ...] = ()

    def columns(self, key: str, table: Sequence[str]) -> list[str]:
        if self.kind == "clustered":
            return list(table)
        if self.kind not in ("secondary", "covering"):
            raise ValueError(f"unknown kind {self.kind}")
        return list(dict.fromkeys([self.column, key, *(self.include if self.kind == "covering" else ())]))

    def covers(self, needed: Sequence[str], key: str, table: Sequence[str]) -> bool:
        return set(needed) <= set(self.columns(key, table))


def build(df: DataFrame, spec: IndexSpec, key: str) -> DataFrame:
    """The index's rows, in ranges of its column; rows without a value are not in it."""
    rows = df.filter(F.col(spec.column).isNotNull()).select(*spec.columns(key, df.columns))
    return rows.repartitionByRange(spec.column).sortWithinPartitions(spec.column, key)


def index_keys(index: DataFrame, r: Range, key: str) -> DataFrame:
    return index.filter(r.predicate()).select(key)


def intersect_lookup(base: DataFrame, indexes: dict[str, DataFrame], conjunct: Sequence[Range], key: str) -> DataFrame:
    """Base rows whose keys all the indexes give: one semi-join after the other."""
    return reduce(lambda rows, r: rows.join(index_keys(indexes[r.column], r, key), key, "left_semi"), conjunct, base)


def union_lookup(base: DataFrame, indexes: dict[str, DataFrame], ranges: Sequence[Range], key: str) -> DataFrame:
    """Base rows whose key one of the indexes gives."""
    keys = reduce(DataFrame.unionByName, [index_keys(indexes[r.column], r, key) for r in ranges]).distinct()
    return base.join(keys, key, "left_semi")


def lookup(base: DataFrame, index: DataFrame, spec: IndexSpec, conjunct: Sequence[Range], key: str, columns: Sequence[str]) -> DataFrame:
    """A conjunction by one index: from its rows alone if it covers the query, else with the base's rows joined in."""
    driving = [r for r in conjunct if r.column == spec.column]
    rest = [r for r in conjunct if r.column != spec.column]
    hits = index.filter(predicate([driving]))
    if spec.covers([*columns, *[r.column for r in rest]], key, base.columns):
        return hits.filter(predicate([rest]) if rest else F.lit(True)).select(*columns)
    full = base.join(hits.select(key), key, "left_semi")
    return full.filter(predicate([rest]) if rest else F.lit(True)).select(*columns)


def split_stale(base: DataFrame, index: DataFrame, spec: IndexSpec, key: str) -> tuple[DataFrame, DataFrame]:
    """Entries that the base lacks or contradicts, and base rows that the index lacks."""
    fresh = base.filter(F.col(spec.column).isNotNull()).select(key, spec.column)
    stale = index.join(fresh, [key, spec.column], "left_anti")
    missing = fresh.join(index.select(key, spec.column), [key, spec.column], "left_anti")
    return stale, missing


def repair(base: DataFrame, index: DataFrame, spec: IndexSpec, key: str) -> DataFrame:
    """The index without entries that the base lacks or contradicts, and with those that it has."""
    fresh = base.filter(F.col(spec.column).isNotNull()).select(*index.columns)
    return clear(base, index, spec, key).unionByName(fresh.join(index.select(key, spec.column), [key, spec.column], "left_anti").select(*index.columns))


def clear(base: DataFrame, index: DataFrame, spec: IndexSpec, key: str) -> DataFrame:
    """The index without entries that the base lacks or contradicts."""
    return index.join(base.select(key, spec.column), [key, spec.column], "left_semi").select(*index.columns)


def consistency(base: DataFrame, specs: Sequence[IndexSpec], key: str) -> DataFrame:
    """(key, column, value): one row for each index entry that a base row should have, values as text.  To compare copies with."""
    entries = F.array(*[F.struct(F.lit(s.column).alias("column"), F.col(s.column).cast("string").alias("value")) for s in specs])
    return base.select(key, F.explode(entries).alias("e")).select(key, "e.column", "e.value").filter("value IS NOT NULL")


@dataclass(frozen=True)
class Histogram:
    """Counts of a column: equal widths between ``low`` and ``high``, or one for each of ``values``.

    Values at or beyond an end are in the end's bucket, which reaches as far as ``least`` or ``most``, the
    values that are really there.  ``distinct`` has each bucket's number of distinct values, as an estimate.
    """

    column: str
    low: float = 0.0
    high: float = 0.0
    counts: tuple[int, ...] = ()
    values: tuple[Any, ...] = ()
    distinct: tuple[int, ...] = ()
    least: float | None = None
    most: float | None = None

    def _edges(self) -> list[float]:
        n = len(self.counts)
        edges = [self.low + i * (self.high - self.low) / n for i in range(n)] + [self.high]
        edges[0] = min(edges[0], self.low if self.least is None else self.least)
        edges[-1] = max(edges[-1], self.high if self.most is None else self.most)
        return edges

    def estimate(self, r: Range) -> float:
        """Rows that the range is expected to hold: of a bucket that it meets in part that share, of one value its bucket's rows by distinct values."""
        if self.values:
            keep = [all(_TEST[op](v, x) for op, x in r.tests) for v in self.values]
            return float(sum(n for n, k in zip(self.counts, keep, strict=True) if k))
        total = float(sum(self.counts))
        if not total or any(op == NEVER for op, _ in r.tests):
            return 0.0
        edges = self._edges()
        low, high = edges[0], edges[-1]
        for op, v in r.tests:
            if op in (">", ">=", "="):
                low = max(low, float(v))
            if op in ("<", "<=", "="):
                high = min(high, float(v))
        if high < low:
            return 0.0
        excluded = sum(self._of_value(edges, float(v)) for op, v in r.tests if op == "!=")
        if high == low:
            return self._of_value(edges, low)
        held = sum(n * max(0.0, min(b, high) - max(a, low)) / (b - a) for a, b, n in zip(edges, edges[1:], self.counts, strict=False) if b > a)
        return max(0.0, held - excluded)

    def _of_value(self, edges: list[float], v: float) -> float:
        """Rows of one value; without a number of distinct values its whole bucket, which is the most it can be."""
        if not edges[0] <= v <= edges[-1]:
            return 0.0
        i = min(len(self.counts) - 1, max(0, bisect_right(edges, v) - 1))
        return self.counts[i] / max(1, self.distinct[i] if self.distinct else 1)

    def selectivity(self, r: Range) -> float:
        return self.estimate(r) / max(1, sum(self.counts))

    def merge(self, other: Histogram) -> Histogram:
        """Both parts of a table together.  Distinct values are at least those of the part that has more."""
        if (self.column, self.low, self.high, self.values) != (other.column, other.low, other.high, other.values):
            raise ValueError("histograms of different buckets")
        both = lambda f, a, b: None if a is None or b is None else f(a, b)
        distinct = tuple(map(max, self.distinct, other.distinct)) if self.distinct and other.distinct else ()
        counts = tuple(a + b for a, b in zip(self.counts, other.counts, strict=True))
        return Histogram(self.column, self.low, self.high, counts, self.values, distinct, both(min, self.least, other.least), both(max, self.most, other.most))


_TEST = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b, NEVER: lambda a, b: False,
}


def bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """The equal-width bucket, from 1; values at or beyond an end fall in the end's bucket."""
    place = F.floor((value - F.lit(low)) / F.lit((high - low) / buckets)).cast("long") + 1
    return F.greatest(F.lit(1).cast("long"), F.least(F.lit(buckets).cast("long"), place))


def histogram_rows(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n) of the buckets that hold rows."""
    rows = df.filter(F.col(column).isNotNull())
    return rows.groupBy(bucket(F.col(column), low, high, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> Histogram:
    counts, distinct, least, most = [0] * buckets, [0] * buckets, None, None
    rows = df.filter(F.col(column).isNotNull()).groupBy(bucket(F.col(column), low, high, buckets).alias("bucket"))
    value = F.col(column).cast("double")
    for r in rows.agg(F.count(F.lit(1)), F.approx_count_distinct(column), F.min(value), F.max(value)).collect():  # one row for each bucket
        counts[r[0] - 1], distinct[r[0] - 1] = r[1], r[2]
        least, most = (r[3] if least is None else min(least, r[3])), (r[4] if most is None else max(most, r[4]))
    return Histogram(column, low, high, tuple(counts), distinct=tuple(distinct), least=least, most=most)


def value_counts(df: DataFrame, column: str, values: Sequence[Any]) -> Histogram:
    found = {r[column]: r["count"] for r in df.filter(F.col(column).isin(list(values))).groupBy(column).count().collect()}
    return Histogram(column, counts=tuple(found.get(v, 0) for v in values), values=tuple(values))


def read_statistics(lines: Sequence[str]) -> dict[str, dict]:
    """Descriptions of statistics: ``name type buckets min max`` or ``name type set v1 v2 ...``, tab-separated."""
    out = {}
    for line in lines:
        name, kind, how, *rest = line.rstrip("\n").split("\t")
        out[name] = {"type": kind, "values": rest} if how == "set" else {"type": kind, "buckets": int(how), "low": float(rest[0]), "high": float(rest[1])}
    return out


def selectivity(dnf: Dnf, statistics: dict[str, Histogram]) -> float:
    """Share of rows: the product for AND, a + b - ab for OR; a column without statistics counts as 1."""
    either = 0.0
    for conjunct in dnf:
        share = reduce(lambda s, r: s * (statistics[r.column].selectivity(r) if r.column in statistics else 1.0), conjunct, 1.0)
        either = either + share - either * share
    return either


@dataclass
class IndexCatalog:
    """The indexes of a table: their definitions, states and statistics."""

    key: str
    columns: tuple[str, ...]
    specs: dict[str, IndexSpec] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)
    statistics: dict[str, Histogram] = field(default_factory=dict)
    #: The widest share of a table that an index is used for.
    widest: float = 0.5

    def add(self, spec: IndexSpec) -> None:
        if spec.column in self.specs:
            raise ValueError(f"{spec.column} is indexed already")
        spec.columns(self.key, self.columns)
        self.specs[spec.column] = spec

    def drop(self, column: str) -> None:
        del self.specs[column]
        self.disabled.discard(column)

    def disable(self, column: str) -> None:
        self.disabled.add(column)

    def enable(self, column: str) -> None:
        self.disabled.discard(column)

    def choose(self, conjunct: Sequence[Range], needed: Sequence[str]) -> str | None:
        """The column whose index to scan, None for the table: the fewest expected rows, ten times as dear without cover."""
        best, chosen = self.widest, None
        for r in conjunct:
            spec = self.specs.get(r.column)
            if spec is None or r.column in self.disabled or any(op == "!=" for op, _ in r.tests):
                continue
            share = self.statistics[r.column].selectivity(r) if r.column in self.statistics else self.widest / 20
            cost = share * (1 if spec.covers([*needed, *[x.column for x in conjunct]], self.key, self.columns) else 10)
            if cost < best:
                best, chosen = cost, r.column
        return chosen

    def query(self, base: DataFrame, indexes: dict[str, DataFrame], dnf: Dnf, columns: Sequence[str]) -> DataFrame:
        """A disjunction with one disjunct by an index of choice; several are one predicate on the table."""
        if len(dnf) == 1 and (chosen := self.choose(dnf[0], columns)):
            return lookup(base, indexes[chosen], self.specs[chosen], dnf[0], self.key, columns)
        return base.filter(predicate(dnf)).select(*columns)

    def to_json(self) -> str:
        return json.dumps({"key": self.key, "columns": self.columns, "indexes": [asdict(s) for s in self.specs.values()], "disabled": sorted(self.disabled)})

    @staticmethod
    def from_json(text: str) -> IndexCatalog:
        spec = json.loads(text)
        out = IndexCatalog(spec["key"], tuple(spec["columns"]))
        for s in spec["indexes"]:
            out.add(IndexSpec(s["column"], s["kind"], tuple(s["include"])))
        out.disabled |= set(spec["disabled"])
        return out


def stored_index(spark: SparkSession, source: str, spec: IndexSpec, key: str) -> KeyedFiles:
    """The index of the Parquet table at ``source``, in the shared folder: made once, in ranges of its column, and made anew when the table changes."""
    name = source.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")

    def made() -> DataFrame:
        base = spark.read.parquet(source)
        return base.filter(F.col(spec.column).isNotNull()).select(*spec.columns(key, base.columns))

    return stored(spark, "-".join(["index", name, spec.column, spec.kind, *spec.include]), source, made, spec.column, [key])


def in_order(rows: DataFrame, spec: IndexSpec, key: str) -> DataFrame:
    """``rows`` with ``place``: their number from 1 in the order of the indexed value, then of the key.

    Ranges of values are numbered each for itself and moved on by the sizes of those before.
    """
    parts = written(rows.repartitionByRange(spec.column, key).withColumn("_part", F.spark_partition_id()), "index-order")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(spec.column, key))
    return parts.withColumn("_n", number).join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_n")).drop("_part", "_n", "_before").orderBy("place")


def byte_share(low: bytes, value: bytes, high: bytes, width: int = 3) -> float:
    """Where ``value`` lies between two keys, from 0 to 1: by ``width`` bytes from the first in which the two differ.

    An estimate without statistics; beyond the keys it is 0 or 1, between equal ones 0.
    """
    if value <= low or high <= low:
        return 0.0
    if value >= high:
        return 1.0
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    a, v, b = (int.from_bytes(k[same : same + width].ljust(width, b"\0"), "big") for k in (low, value, high))
    return (v - a) / (b - a) if b > a else 0.0


def of_conjunct(index: KeyedFiles, conjunct: Sequence[Range]) -> DataFrame:
    """The rows of the files of a stored index that can hold what its column's ranges ask for."""
    low = [v for r in conjunct if r.column == index.key for op, v in r.tests if op in (">", ">=", "=")]
    high = [v for r in conjunct if r.column == index.key for op, v in r.tests if op in ("<", "<=", "=")]
    plain = all(not isinstance(v, Column) for v in [*low, *high])
    return index.between(max(low, default=None), min(high, default=None)) if plain else index.rows()


def maintain(index: DataFrame, changed: DataFrame, deleted: DataFrame, spec: IndexSpec, key: str) -> DataFrame:
    """The index after rows were written (``changed``: whole new rows) and deleted (``deleted``: keys).

    Entries of either are dropped, and those of the written rows made anew.  A key that is written with
    several values at once is an error.
    """
    touched = changed.select(key).unionByName(deleted.select(key)).distinct()
    columns = [c for c in index.columns if c != key]
    several = F.count_distinct(spec.column) > 1
    checked = changed.groupBy(key).agg(*[F.any_value(c).alias(c) for c in columns if c != spec.column], F.any_value(spec.column).alias("_v"), several.alias("_several"))
    value = F.when(F.col("_several"), F.raise_error(F.lit(f"several values of {spec.column} for one key"))).otherwise(F.col("_v"))
    fresh = checked.withColumn(spec.column, value.cast(index.schema[spec.column].dataType)).filter(F.col(spec.column).isNotNull())
    return index.join(touched, key, "left_anti").select(*index.columns).unionByName(fresh.select(*index.columns))
