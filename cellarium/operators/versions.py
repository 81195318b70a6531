"""Visibility: tombstones, time ranges, life time and version counts.

A cell is read in this order: tombstones, time range, columns, filter, version count.
A filter therefore sees older versions that the count would hide, and what it
skips doesn't count.  One shuffle by (rowkey, family) serves all windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.operators.cells import COORDINATES, DELETE, DELETE_COLUMN, DELETE_FAMILY, PUT, FamilySpec


@dataclass(frozen=True)
class ReadPolicy:
    """What a read asks for.  The time range is half-open; ``now`` makes life times repeatable."""

    max_versions: int | None = 1
    time_min: int | None = None
    time_max: int | None = None
    now: int | None = None
    raw: bool = False


def _in_range(ts: Column, policy: ReadPolicy) -> Column:
    out = F.lit(True)
    if policy.time_min is not None:
        out = out & (ts >= policy.time_min)
    if policy.time_max is not None:
        out = out & (ts < policy.time_max)
    return out


def _by_family(families: dict[str, FamilySpec], pick: Callable[[FamilySpec], int | None], default: FamilySpec) -> Column:
    """The policy's value for the row's family."""
    out = None
    for name, spec in families.items():
        case = F.col("family") == name
        out = F.when(case, F.lit(pick(spec)).cast("long")) if out is None else out.when(case, F.lit(pick(spec)).cast("long"))
    rest = F.lit(pick(default)).cast("long")
    return rest if out is None else out.otherwise(rest)


def keeps_deleted(families: dict[str, FamilySpec], default: FamilySpec) -> Column:
    """Whether the row's family keeps deleted cells."""
    keep = F.lit(False)
    for name, spec in families.items():
        keep = keep | (F.lit(spec.keep_deleted) & (F.col("family") == name))
    if default.keep_deleted:
        keep = keep | (~F.col("family").isin(list(families)) if families else F.lit(True))
    return keep


def masked_by_tombstones(cells: DataFrame, policy: ReadPolicy, families: dict[str, FamilySpec], default: FamilySpec) -> DataFrame:
    """The puts that no tombstone masks.

    A family or column marker masks what is as old as it or older, whatever was written first;
    a version marker masks its own time.  Of families that keep deleted cells only markers
    inside the time range count; of others also later ones.
    """
    keep = keeps_deleted(families, default)
    counts = F.lit(True)
    if policy.time_min is not None:
        counts = counts & (F.col("ts") >= policy.time_min)
    if policy.time_max is not None:
        counts = counts & (~keep | (F.col("ts") < policy.time_max))
    family = Window.partitionBy("rowkey", "family")
    column = Window.partitionBy("rowkey", "family", "qualifier")
    version = Window.partitionBy("rowkey", "family", "qualifier", "ts")
    marked = (
        cells.withColumn("_family", F.max(F.when((F.col("type") == DELETE_FAMILY) & counts, F.col("ts"))).over(family))
        .withColumn("_column", F.max(F.when((F.col("type") == DELETE_COLUMN) & counts, F.col("ts"))).over(column))
        .withColumn("_version", F.max(F.when((F.col("type") == DELETE) & counts, F.lit(1)).otherwise(0)).over(version))
    )
    visible = (F.col("type") == PUT) & (F.coalesce(F.col("ts") > F.col("_family"), F.lit(True))) & (F.coalesce(F.col("ts") > F.col("_column"), F.lit(True))) & (F.col("_version") == 0)
    return marked.filter(visible).drop("_family", "_column", "_version")


def last_written(puts: DataFrame) -> DataFrame:
    """One put for each coordinate and time: the one written last.

    Its window has the partitions and the order of the version count, so both share one sort.
    """
    order = Window.partitionBy("rowkey", "family", "qualifier").orderBy(F.desc("ts"), F.desc("seq"))
    newer = F.lag("ts").over(order)
    return puts.withColumn("_newer", newer).filter(F.col("_newer").isNull() | (F.col("_newer") != F.col("ts"))).drop("_newer")


def resolve(
    cells: DataFrame,
    policy: ReadPolicy = ReadPolicy(),
    families: dict[str, FamilySpec] | None = None,
    default: FamilySpec = FamilySpec(max_versions=1 << 30),
    tombstones: bool = True,
    ties: bool = True,
    apply_filter: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The cells that a read sees.

    ``tombstones`` and ``ties`` say whether the input can hold markers and several
    cells of one time; where it can't, their windows are left out of the plan.
    """
    families = families or {}
    if policy.raw:
        seen = cells.filter(_in_range(F.col("ts"), policy))
        seen = apply_filter(seen) if apply_filter else seen
        if policy.max_versions is None:
            return seen
        order = Window.partitionBy("rowkey", "family", "qualifier", "type").orderBy(F.desc("ts"), F.desc("seq"))
        return seen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= policy.max_versions).drop("_n")
    seen = masked_by_tombstones(cells, policy, families, default) if tombstones else cells.filter(F.col("type") == PUT)
    seen = seen.filter(_in_range(F.col("ts"), policy))
    expires = policy.now is not None and any(s.ttl is not None for s in [*families.values(), default])
    if policy.max_versions == 1 and not expires and apply_filter is None and all(s.max_versions >= 1 for s in [*families.values(), default]):
        # One version needs no order, only the greatest: partial sums go into the shuffle instead of all versions.
        others = [c for c in seen.columns if c not in COORDINATES]
        newest = F.max_by(F.struct(*others), F.struct("ts", "seq")).alias("_newest")
        return seen.groupBy(*COORDINATES).agg(newest).select(*[F.col(f"_newest.{c}").alias(c) if c in others else F.col(c) for c in seen.columns])
    seen = last_written(seen) if ties else seen
    seen = apply_filter(seen) if apply_filter else seen
    most = _by_family(families, lambda s: s.max_versions, default)
    if policy.max_versions is not None:
        most = F.least(most, F.lit(policy.max_versions))
    order = Window.partitionBy("rowkey", "family", "qualifier").orderBy(F.desc("ts"), F.desc("seq"))
    counted = seen.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    if expires:
        ttl = _by_family(families, lambda s: s.ttl, default)
        least = _by_family(families, lambda s: s.min_versions, default)
        alive = ttl.isNull() | (F.col("ts") >= F.lit(policy.now) - ttl)
        counted = counted.filter(alive | (F.col("_n") <= least))
    return counted.drop("_n")
