"""Constraints on writes, and observers around reads and writes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.operators.mutations import apply
from cellarium.operators.scan import Table, key_range


@dataclass(frozen=True)
class Constraint:
    """``check`` must hold for every cell written to ``family`` (all, if None); NULL fails."""

    name: str
    check: Column
    family: str | None = None
    enabled: bool = True


def split_by_constraints(edits: DataFrame, constraints: Sequence[Constraint]) -> tuple[DataFrame, DataFrame]:
    """Edits that pass, and those that don't with the name of the first constraint they break."""
    broken = F.lit(None).cast("string")
    for c in reversed([c for c in constraints if c.enabled]):
        fails = ~F.coalesce(c.check, F.lit(False)) & (F.col("type") == 4)
        fails = fails & (F.col("family") == c.family) if c.family else fails
        broken = F.when(fails, c.name).otherwise(broken)
    marked = edits.withColumn("broken", broken)
    return marked.filter("broken IS NULL").drop("broken"), marked.filter("broken IS NOT NULL")


def enforce(edits: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """The edits; the job fails at the first that breaks a constraint."""
    value = F.col("value")
    for c in (c for c in constraints if c.enabled):
        fails = ~F.coalesce(c.check, F.lit(False)) & (F.col("type") == 4)
        fails = fails & (F.col("family") == c.family) if c.family else fails
        value = F.when(fails, F.raise_error(F.lit(f"constraint {c.name} is broken")).cast("string")).otherwise(value)
    return edits.withColumn("value", value)


#: Names of the places where observers are called.
HOOKS = ("pre_put", "post_put", "pre_scan", "post_scan", "pre_delete", "post_delete", "pre_compact", "post_compact")


@dataclass
class ObservedTable:
    """A table whose reads and writes pass through observers: functions from a DataFrame to a DataFrame."""

    table: Table
    observers: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)
    with_attributes: dict[str, list[Callable[[DataFrame, dict[str, Any]], DataFrame]]] = field(default_factory=dict)

    def on(self, hook: str, observer: Callable[[DataFrame], DataFrame]) -> None:
        if hook not in HOOKS:
            raise ValueError(f"no hook {hook}")
        self.observers.setdefault(hook, []).append(observer)

    def on_attributes(self, hook: str, observer: Callable[[DataFrame, dict[str, Any]], DataFrame]) -> None:
        """An observer of scans that also gets the scan's attributes."""
        if hook not in ("pre_scan", "post_scan"):
            raise ValueError(f"no attributes at {hook}")
        self.with_attributes.setdefault(hook, []).append(observer)

    def _run(self, hook: str, df: DataFrame, attributes: dict[str, Any] | None = None) -> DataFrame:
        for observer in self.observers.get(hook, ()):
            df = observer(df)
        for observer in self.with_attributes.get(hook, ()):
            df = observer(df, attributes or {})
        return df

    def scan(self, **options: Any) -> DataFrame:
        given = options.get("attributes")
        table = self.table
        if any(hooks.get("pre_scan") for hooks in (self.observers, self.with_attributes)):
            # What observers see first is all cells, not those of some files.
            table = replace(table, cells=self._run("pre_scan", table.cells, given), files=None)
        return self._run("post_scan", table.scan(**options), given)

    def mutate(self, edits: DataFrame, kind: str = "put") -> None:
        edits = self._run(f"pre_{kind}", edits)
        self.table = replace(self.table, files=None, cells=self._run(f"post_{kind}", apply(self.table.cells, edits)))


def endpoint(cells: DataFrame, partial: Callable[..., Any], schema: str, final: Callable[[DataFrame], DataFrame], start: str = "", stop: str = "") -> DataFrame:
    """A user's partial function over the batches of each partition in a key range, then a merge of its rows."""
    return final(cells.filter(key_range(F.col("rowkey"), start, stop)).mapInPandas(partial, schema))
