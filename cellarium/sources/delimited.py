"""Delimited lines to cells, with the rules of column specifications.

``columns`` names each field: ROW_KEY, TS_KEY, "family:qualifier" or "family".  A line needs a
separator; it may be shorter than the list as long as key and time are there, and never
longer.  Bad lines are told apart, or fail the read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.operators.cells import PUT


@dataclass(frozen=True)
class DelimitedSpec:
    columns: tuple[str, ...]
    separator: str = "\t"
    key: str = "ROW_KEY"
    time: str = "TS_KEY"

    def __post_init__(self) -> None:
        if len(self.separator.encode()) != 1:
            raise ValueError("the separator must be one byte")
        if self.columns.count(self.key) != 1:
            raise ValueError(f"exactly one field must be {self.key}")
        if self.columns.count(self.time) > 1 or len(set(self.columns)) != len(self.columns):
            raise ValueError("a field is named twice")

    @staticmethod
    def of(text: str, separator: str = "\t", key: str = "ROW_KEY", time: str = "TS_KEY") -> DelimitedSpec:
        return DelimitedSpec(tuple(c.strip() for c in text.split(",")), separator, key, time)


def parse_lines(lines: DataFrame, spec: DelimitedSpec, ts: int, line: str = "value") -> DataFrame:
    """line, fields, rowkey, ts and reason (NULL for good lines)."""
    fields = F.split(F.col(line), "\\Q" + spec.separator + "\\E")
    n = F.size("fields")
    key_at = spec.columns.index(spec.key)
    time_at = spec.columns.index(spec.time) if spec.time in spec.columns else None
    reason: Column = F.when(n < 2, "No delimiter").when(n > len(spec.columns), "Excessive columns").when(n <= key_at, "No row key")
    stamp = F.lit(ts).cast("long")
    if time_at is not None:
        given = F.get("fields", F.lit(time_at)).try_cast("long")
        reason = reason.when(n <= time_at, "No timestamp").when(given.isNull(), "Invalid timestamp")
        stamp = given
    parsed = lines.select(F.col(line).alias("line"), fields.alias("fields"))
    return parsed.select("line", "fields", F.get("fields", F.lit(key_at)).alias("rowkey"), stamp.alias("ts"), reason.alias("reason"))


def cells_of_lines(lines: DataFrame, spec: DelimitedSpec, ts: int, skip_bad: bool = True, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(cells, bad lines with their reason).  Without ``skip_bad`` a bad line fails the job that reads it."""
    parsed = parse_lines(lines, spec, ts, line)
    bad = parsed.filter("reason IS NOT NULL").select("line", "reason")
    if not skip_bad:
        fail = F.raise_error(F.concat(F.lit("bad line: "), "reason")).cast("string")
        parsed = parsed.withColumn("rowkey", F.when(F.col("reason").isNull(), F.col("rowkey")).otherwise(fail))
    entries = []
    for i, name in enumerate(spec.columns):
        if name in (spec.key, spec.time):
            continue
        family, _, qualifier = name.partition(":")
        entries.append(F.struct(F.lit(family).alias("family"), F.lit(qualifier).alias("qualifier"), F.get("fields", F.lit(i)).alias("value")))
    good = parsed.filter("reason IS NULL") if skip_bad else parsed
    cells = good.select("rowkey", "ts", F.explode(F.array(*entries)).alias("c")).filter("c.value IS NOT NULL")
    out = cells.select("rowkey", "c.family", "c.qualifier", "ts", F.lit(PUT).cast("tinyint").alias("type"), "c.value", F.lit(0).cast("long").alias("seq"))
    return out, bad


def read_delimited(spark: SparkSession, path: str, spec: DelimitedSpec, ts: int, skip_bad: bool = True) -> tuple[DataFrame, DataFrame]:
    return cells_of_lines(spark.read.text(path), spec, ts, skip_bad)
