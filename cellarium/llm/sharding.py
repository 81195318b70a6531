"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard.  At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the key and the child's path; the
smallest draw wins, so a child gets keys in proportion to its weight.  A draw
depends on the key, the child's path and the child's weight only.  When a weight
changes, keys move only into (or out of) the subtree whose weight changed, and
the rest of the tree keeps its keys.

A shard that is added enters as a region of its own (one rack, one shard).  No
older subtree changes its weight then, so the new shard takes rows only into
itself.  ``reweigh`` changes a shard in place; movement is confined to its rack
and region, and to what crosses their borders.

Cases: a null key draws like any other value (all such rows meet in one shard);
null and empty texts have size 16 and CRC 0; repeated rows share a shard and get
different slots; an empty table gives an empty result.  Columns are selected by
name, so other columns of the input never clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellarium.llm.common import documents, unit, written

#: Rows of one shard that are numbered in one task.
ROWS_PER_SLOT_BUCKET = 200_000
LEAST_SLOT_BUCKETS = 16


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class HashTree:
    leaves: tuple[Leaf, ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> HashTree:
        """``regions`` x ``racks`` x ``shards`` leaves of equal weight, numbered from 0."""
        places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
        return HashTree(tuple(Leaf(f"region{r}", f"rack{k}", i) for i, (r, k) in enumerate(places)))

    def grown(self, weight: float = 1.0) -> HashTree:
        """One more shard, as a region of its own."""
        shard = max((x.shard for x in self.leaves), default=-1) + 1
        return HashTree((*self.leaves, Leaf(f"added{shard}", "rack0", shard, weight)))

    def reweigh(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple(replace(x, weight=weight) if x.shard == shard else x for x in self.leaves))

    def levels(self) -> list[list[list[tuple[str, float, int]]]]:
        """For each level, by the node chosen above: (path, weight, number) of each child with weight.

        A number is the child's place in the next level; at the last it is the shard.
        """
        live = [x for x in self.leaves if x.weight > 0]
        if not live:
            raise ValueError("no shard has a weight above zero")
        names = [lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"]
        out, groups = [], [live]
        for depth, name in enumerate(names):
            level, below = [], []
            for leaves in groups:
                parts: dict[str, list[Leaf]] = {}
                for x in leaves:
                    parts.setdefault(name(x), []).append(x)
                children = []
                for path, xs in parts.items():
                    children.append((path, sum(x.weight for x in xs), xs[0].shard if depth == 2 else len(below)))
                    below.append(xs)
                level.append(children)
            out.append(level)
            groups = below
        return out

    def assign(self, key: Column) -> Column:
        """The shard of ``key``.  Each level looks at the children of the node chosen above only."""
        chosen = F.lit(0)
        for level in self.levels():
            table = F.array(
                *[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"), F.lit(n).alias("n")) for p, w, n in children]) for children in level]
            )
            draws = F.transform(F.element_at(table, chosen + 1), lambda c: F.struct((-F.log(unit(key, c["path"])) / c["weight"]).alias("draw"), c["n"].alias("n")))
            chosen = F.array_min(draws)["n"]
        return chosen.cast("int")


def with_slots(rows: DataFrame, shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Rows of a shard are dealt to sub-buckets; a count for each gives every
    sub-bucket its first number, and only the rows of one sub-bucket are numbered
    in one task, however large the shard.
    """
    rows = written(rows.withColumn("_tag", F.monotonically_increasing_id()), "slots")
    buckets = max(LEAST_SLOT_BUCKETS, math.ceil(rows.count() / max(1, shards) / ROWS_PER_SLOT_BUCKET))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_tag"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_part").orderBy("_tag")
    numbered = rows.withColumn("_rank", F.row_number().over(within) - 1)
    return numbered.join(first, [shard, "_part"]).withColumn(slot, (F.col("_first") + F.col("_rank")).cast("long")).drop("_tag", "_part", "_rank", "_first")


def shard_documents(docs: DataFrame, tree: HashTree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.assign(F.col(key)).alias("shard"),
        tree.grown().assign(F.col(key)).alias("grown_shard"),
    )
    return with_slots(placed, len(tree.leaves)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards: 4 regions of 2 racks of 5."""
    return shard_documents(documents(spark, sf_dir), HashTree.regular(4, 2, 5))


QUERIES = {"op1_hash_tree_sharding": op1_hash_tree_sharding}
ORACLE_SQL: dict[str, str] = {}
