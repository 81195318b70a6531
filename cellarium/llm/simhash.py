"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: of the XXH64 hashes of a text's word shingles, each bit by majority.

Links (RADIUS or fewer differing bits) are found between distinct fingerprints:

1. The top nodes of the index are masked patterns.  The 64 bits fall into RADIUS + 1
   masks; two linked fingerprints agree on at least one whole mask, so each
   fingerprint goes to one top node for every mask, and no link is lost.  A top node
   with more than NODE_LIMIT fingerprints gets nodes below it: the bits that its
   pattern leaves open are split in the same way, again and again.
2. In a node the fingerprints are sorted by Gray rank, so that neighbours share many
   bits.  Runs of FANOUT become nodes, runs of these nodes become nodes above, and the
   bits that all of a node's members share are factored into it: a bit is
   compared at the highest node that has it in common.  A search goes down from
   the root, adds up the bits in which the query differs from the patterns, and
   drops a whole group as soon as the sum exceeds RADIUS.

A node reports a spanning star for each set that its links join, not all pairs.
Components of the reports are the classes.  Only counts reach the driver.

The index also takes several families of fingerprints at once, and fingerprints of digits of some bits: what
differs is counted in digits then, and masks are made of whole digits.

Cases: null texts count as empty; texts without words have fingerprint 0 and are linked
like any other; fewer words than a shingle make one shingle; a null doc_id is
greater than any other; rows repeated in full are one document and stay or go together;
texts of any length are hashed in blocks of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bounded_batches, documents, join_by_key, without, written
from cellarium.llm.components import stars

#: Fixed values of the contract: words in a shingle, hash seed, differing bits.
SHINGLE = 3
SEED = 42
RADIUS = 2

FANOUT = 8
NODE_LIMIT = 2048
#: A pattern that leaves no more bits open is not split further: 2 ** 11 is NODE_LIMIT.
OPEN_BITS = 11
WORD_BLOCK = 1 << 15
TEXT_BLOCK = 1 << 20


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of lower-cased ``data``; long texts come in blocks, cut at white space."""
    if len(data) <= 4 * TEXT_BLOCK:
        words = data.lower().split()
        for i in range(0, len(words), WORD_BLOCK):
            yield words[i : i + WORD_BLOCK]
        return
    rest = b""
    for at in range(0, len(data), TEXT_BLOCK):
        block = rest + data[at : at + TEXT_BLOCK].lower()
        words = block.split()
        rest = words.pop() if words and not block[-1:].isspace() else b""
        yield words
    if rest:
        yield [rest]


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    counts, total, held = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_digest
    for words in _word_blocks((text or "").encode()):
        held += words
        if len(held) < size:
            continue
        joined = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1)
        first = np.concatenate([[0], ends[:-size]]).tolist()
        last = (ends[size - 1 :] - 1).tolist()
        hashes = b"".join(map(digest, map(joined.__getitem__, map(slice, first, last)), repeat(seed)))
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
        total += len(first)
        held = held[len(held) - size + 1 :] if size > 1 else []
    if not total and held:
        counts += np.unpackbits(np.frombuffer(digest(b" ".join(held), seed), dtype=np.uint8))
        total = 1
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already (XXH64, as numbers, repeats included); see ``fingerprint``."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), WORD_BLOCK):
        bits = np.unpackbits(hashes[i : i + WORD_BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text) and fp of every row, written once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(fingerprint, size=size, seed=seed)
        for batch in batches:
            found = np.array([made(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc_id", "key", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(run, rows.drop("_text").schema.add("fp", "long")), "fingerprints")


def gray_rank(fp: Column) -> Column:
    """The place of ``fp`` in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def digits(width: int) -> list[int]:
    """The masks of a fingerprint's digits of ``width`` bits; what is left at the top isn't used."""
    return [(1 << width) - 1 << i for i in range(0, 64 - width + 1, width)]


def split_mask(open_bits: int, parts: int, width: int = 1) -> list[int]:
    """``open_bits`` dealt by digits to ``parts`` masks of nearly equal size."""
    places = [d for d in digits(width) if open_bits & d]
    return [sum(places[k::parts]) for k in range(parts)]


def differing(diff: np.ndarray, width: int) -> np.ndarray:
    """How many digits of ``width`` bits have a bit set."""
    if width == 1:
        return np.bitwise_count(diff)
    out = np.zeros(diff.shape, dtype=np.uint8)
    for d in digits(width):
        out += (diff & np.uint64(d)) != 0
    return out


def links_of_node(fps: np.ndarray, radius: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars, as positions (member, centre), of the links between distinct fingerprints in Gray order."""
    n = len(fps)
    if n == 2:
        some = np.flatnonzero(differing(fps[1:] ^ fps[:1], width) <= radius)
        return some + 1, some
    # From the leaves up: per level the bits that a node's members share, and their values.
    shared, value = [np.full(n, ~np.uint64(0))], [fps]
    while len(value[-1]) > 1:
        at = np.arange(0, len(value[-1]), FANOUT)
        ones = np.bitwise_and.reduceat(value[-1], at)
        any_one = np.bitwise_or.reduceat(value[-1] & shared[-1], at)
        agreed = np.bitwise_and.reduceat(shared[-1], at)
        shared.append(agreed & ~(ones ^ any_one))
        value.append(ones)
    label = np.arange(n)
    for begin in range(0, n, 256):
        query = np.arange(begin, min(n, begin + 256))
        node = np.zeros(len(query), dtype=np.int64)
        apart = np.zeros(len(query), dtype=np.uint64)
        above = np.zeros(len(query), dtype=np.uint64)
        for level in range(len(value) - 1, -1, -1):
            own = shared[level][node] & ~above
            apart = apart | (fps[query] ^ value[level][node]) & own
            near = differing(apart, width) <= radius
            query, node, apart = query[near], node[near], apart[near]
            if level == 0:
                break
            above = shared[level][node]
            below = len(value[level - 1])
            children = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            query, apart, above = np.repeat(query, FANOUT), np.repeat(apart, FANOUT), np.repeat(above, FANOUT)
            # Links go one way: to fingerprints further on.  Nodes that end before the query are dropped.
            reach = FANOUT ** (level - 1)
            inside = (children < below) & ((children + 1) * reach > query)
            query, node, apart, above = query[inside], children[inside], apart[inside], above[inside]
        pairs = node > query
        a, b = query[pairs], node[pairs]
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _node_links(batches: Iterator[pa.RecordBatch], radius: int, widths: tuple[int, ...], below: int) -> Iterator[pa.RecordBatch]:
    """Rows (path, pattern, fp) in the order of node and Gray rank: a node is a run of rows, and may span batches.  Each family has ``below`` paths."""
    names = ["family", "u", "v"]
    held: np.ndarray | None = None
    held_key = None

    def done(fps: np.ndarray | None, out: list[np.ndarray]) -> None:
        if fps is not None and len(fps) > 1:
            family = int(held_key[0]) // below
            member, centre = links_of_node(fps.view(np.uint64), radius, widths[family])
            if len(member):
                out += [np.full(len(member), family, dtype=np.int64), fps[member], fps[centre]]

    def made(out: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[i::3]) if out else np.empty(0, np.int64)) for i in range(3)], names)

    for batch in batches:
        path, pattern, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        starts = np.concatenate([[0], np.flatnonzero((path[1:] != path[:-1]) | (pattern[1:] != pattern[:-1])) + 1, [len(fp)]])
        out: list[np.ndarray] = []
        for i in range(len(starts) - 1):
            key, run = (path[starts[i]], pattern[starts[i]]), fp[starts[i] : starts[i + 1]]
            if key == held_key:
                held = np.concatenate([held, run])
            else:
                done(held, out)
                held_key, held = key, run
        if out:
            yield made(out)
    out = []
    done(held, out)
    yield made(out)


def links(fps: DataFrame, radius: int = RADIUS, limit: int = NODE_LIMIT) -> DataFrame:
    """(u, v) between distinct fingerprints ``fp``: stars that span what the links join."""
    return family_links(fps.select(F.lit(0).alias("family"), "fp"), (1,), radius, limit).select("u", "v")


def family_links(fps: DataFrame, widths: tuple[int, ...], radius: int = RADIUS, limit: int = NODE_LIMIT) -> DataFrame:
    """(family, u, v) between distinct fingerprints ``fp`` of one ``family``, whose digits have ``widths[family]`` bits: stars that span what the links join."""
    step = radius + 1
    #: Nodes' paths with the bits that are fixed so far; a family is the path of its root.
    level = dict.fromkeys(range(len(widths)), 0)
    rows = fps.select("fp", F.col("family").cast("long").alias("parent"))
    out, below = None, 1
    while True:
        # The masks of a parent's children, looked up by the parent: a row goes to its own parent's children only.
        children, open_bits = {}, {}
        for parent, fixed in level.items():
            width = widths[parent // below]
            free = sum(digits(width)) & ~fixed
            children[parent] = [(parent * step + k, fixed | part) for k, part in enumerate(split_mask(free, step, width))]
            open_bits |= {path: (sum(digits(width)) & ~mask).bit_count() for path, mask in children[parent]}
        below *= step
        masks = F.create_map(*[x for p, c in children.items() for x in (F.lit(p).cast("long"), F.array(*[F.struct(F.lit(k).cast("long").alias("path"), F.lit(_signed(m)).alias("mask")) for k, m in c]))])
        nodes = rows.select("fp", F.explode(masks[F.col("parent")]).alias("n"))
        entries = nodes.select("n.path", F.col("fp").bitwiseAND(F.col("n.mask")).alias("pattern"), "fp")
        sizes = written(entries.groupBy("path", "pattern").count().filter("count > 1"), "node-sizes")
        total = sizes.agg(F.sum("count")).first()[0] or 0
        entries = written(join_by_key(entries, sizes.withColumnRenamed("count", "size"), ["path", "pattern"], total, sizes), "nodes")
        # So few open bits, or no more digits than may differ: such nodes aren't split.
        more = [path for path, bits in open_bits.items() if bits > max(OPEN_BITS, radius * widths[path // below])]
        split = (F.col("size") > limit) & F.col("path").isin(more) if more else F.lit(False)
        dealt = entries.filter(~split).select("path", "pattern", "fp", gray_rank(F.col("fp")).alias("rank")).repartition("path", "pattern")
        ordered = dealt.sortWithinPartitions("path", "pattern", "rank").select("path", "pattern", "fp")
        found = written(ordered.mapInArrow(partial(_node_links, radius=radius, widths=tuple(widths), below=below), "family bigint, u bigint, v bigint"), "links")
        out = found if out is None else out.unionByName(found)
        big = entries.filter(split)
        if not more or big.isEmpty():
            return out
        rows = big.select("fp", F.col("path").alias("parent"))
        level = {path: mask for c in children.values() for path, mask in c if path in set(more)}


def near_classes(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, fp, component_id and kept (the smallest document of its class) of every row."""
    rows = fingerprints(docs, size, SEED, doc_id, text)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    distinct = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    joined = stars(links(distinct.select("fp"), radius))
    placed = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    linked = placed.filter("root <> fp").select("root").distinct()
    # Most classes are one fingerprint; only those of several are gathered.
    several = placed.join(linked, "root", "left_semi")
    best = several.groupBy("root").agg(F.min("first").alias("best"))
    classes = placed.join(best, "root", "left").select("fp", F.coalesce("best", "first").alias("best"))
    # A fingerprint that many documents share is a hot key.
    return join_by_key(rows, written(classes, "fingerprint-classes"), "fp", rows.count()).select("doc_id", "key", "fp", F.col("best.doc_id").alias("component_id"), (first == F.col("best")).alias("kept"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the smallest document."""
    gone = near_classes(docs, size, radius, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return without(docs, written(gone, "near-gone"), doc_id, text)


def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(documents(spark, sf_dir))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_gray_index": op3_simhash_gray_index}
ORACLE_SQL: dict[str, str] = {}
