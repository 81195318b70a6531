"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A text's shingles are hashed (XXH64).  Texts of one set are one node from here on.
2. Candidates: the search is op3's, its Gray-order index under masked patterns.  The index takes the
   SimHash fingerprint of a text's shingles, as op3 makes it, and FAMILIES independent fingerprints of a set,
   each of DIGITS digits that come from one MinHash value each.  At a similarity of 0.8 SimHash bits differ in some 10 of 64,
   which no index prunes; digits differ as often as the sets do.  Sets of similarity s share
   a digit with probability s, and are linked in a family if RADIUS or fewer of its digits differ: 0.74 at 0.8, and in one
   or more of all families 0.99998.  What the index links in a node, and all sets of one fingerprint, are a bucket.
3. Confirmation: the exact similarity of the candidates' sets.  First each set of a bucket meets the
   bucket's centre, the one that meets most sets in all buckets; then what these links don't join meets the rest of its
   bucket, in blocks, and no pair becomes a row.  The fingerprints are compared first there: at a similarity of 0.8
   fewer than LEAST_ALIKE of all digits agree once in 150,000 times.  So any two sets that the index links were compared or are in one class already.

Components of the confirmed links are the classes; of each the smallest document stays.
The same cases as in ``simhash`` hold: null texts count as empty, fewer words than a shingle make
one shingle, texts without words are one class, a null doc_id is greater than any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cellarium.llm.common import bounded_batches, discard, if_small, join_by_key, without, worker_cache, written
from cellarium.llm.components import stars
from cellarium.llm.simhash import RADIUS, SEED, _word_blocks, family_links, majority

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of MinHash digits; 9 digits of 7 bits fill one, and make three masks of three.
FAMILIES = 8
DIGITS = 9
DIGIT_BITS = 7
#: Bits in a digit of each family of the index; the last one is SimHash.
WIDTHS = (DIGIT_BITS,) * FAMILIES + (1,)
#: MinHash digits (of FAMILIES * DIGITS) that must agree, 4.6 deviations below what 0.8 makes of them.
LEAST_ALIKE = 42
#: Sets in a block of a bucket.
BLOCK = 2048
#: Shingles that are permuted at once.
HASH_BLOCK = 4096

_DRAW = np.random.default_rng(SEED)
_XOR = _DRAW.integers(0, 1 << 64, (FAMILIES * DIGITS, 1), dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ODD = _DRAW.integers(0, 1 << 64, (FAMILIES * DIGITS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, repeats included."""
    found, held = [], []
    for words in _word_blocks((text or "").encode()):
        held += words
        if len(held) < size:
            continue
        found += [xxhash.xxh64_intdigest(b" ".join(held[i : i + size]), SEED) for i in range(len(held) - size + 1)]
        held = held[len(held) - size + 1 :] if size > 1 else []
    if not found and held:
        found = [xxhash.xxh64_intdigest(b" ".join(held), SEED)]
    return np.array(found, dtype=np.uint64)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, size))


def minhash_digits(hashes: np.ndarray) -> np.ndarray:
    """Of a set of shingles FAMILIES rows of DIGITS digits, each from a MinHash value of its own."""
    least = np.full(FAMILIES * DIGITS, ~np.uint64(0))
    for i in range(0, len(hashes), HASH_BLOCK):
        least = np.minimum(least, ((hashes[i : i + HASH_BLOCK] ^ _XOR) * _ODD).min(axis=1))
    # The least of many values has few high bits: they are spread first.
    return (least * _SPREAD >> np.uint64(64 - DIGIT_BITS)).astype(np.uint8).reshape(FAMILIES, DIGITS)


def family_fingerprints(digits: np.ndarray, simhash: int) -> np.ndarray:
    """The fingerprints of all families, by WIDTHS."""
    made = (digits.astype(np.uint64) << np.arange(0, DIGITS * DIGIT_BITS, DIGIT_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.append(made, np.uint64(simhash))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct values; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    worker_cache("near")
    for batch in batches:
        hashes = [shingle_hashes(t.as_py(), size) for t in batch.column(2)]
        sets = [np.unique(h) for h in hashes]
        node = _signed([xxhash.xxh64_intdigest(x.tobytes()) for x in sets])
        digits, simhash = [minhash_digits(x) for x in sets], [majority(h) for h in hashes]
        marks = np.concatenate([np.empty(0, np.uint64), *map(family_fingerprints, digits, simhash)]).view(np.int64)
        marks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * len(WIDTHS)), pa.array(marks))
        sketch = pa.array([x.tobytes() + y.to_bytes(8, "big") for x, y in zip(digits, simhash, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), marks, sketch], ["doc_id", "key", "node", "marks", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingles(t.as_py(), size).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "hashes"])


def _confirmed(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(i)] for i in (2, 3)]
        near = [similarity(a, b) >= least for a, b in zip(*sets, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))


def _sets_of(nodes: DataFrame, source: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """node and hashes, the sets of ``nodes``, made again from the texts."""
    used = written(first.join(nodes, "node", "left_semi"), "candidates")
    texts = source.join(if_small(used), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("node", "_text").dropDuplicates(["node"])
    sets = written(texts.mapInArrow(partial(_sets, size=size), "node long, hashes binary"), "shingle-sets")
    discard(used)
    return sets


def _confirm(pairs: DataFrame, source: DataFrame, first: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are alike; first: node with doc_id and key of a row of ``source`` that has its text."""
    total = pairs.count()
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), source, first, size)
    met = join_by_key(pairs, sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u", total)
    met = join_by_key(met, sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v", total, pairs.groupBy("v").count())
    found = written(met.select("u", "v", "a", "b").mapInArrow(partial(_confirmed, least=least), "u long, v long"), "near-links")
    discard(sets)
    return found


def near_links(nodes: DataFrame, source: DataFrame, first: DataFrame, size: int, least: float) -> DataFrame:
    """(u, v): confirmed links that join all classes of ``nodes`` (node, marks, sketch)."""
    marks = written(nodes.select("node", F.posexplode("marks").alias("family", "fp")), "marks")
    # Of a fingerprint its own bucket, and those of the centres that the index links it to.
    linked = family_links(marks.select("family", "fp").distinct(), WIDTHS)
    centres = written(linked.select(F.xxhash64(F.col("family").cast("int"), "u").alias("own"), F.xxhash64(F.col("family").cast("int"), "v").alias("bucket")).distinct(), "centres")
    marks = marks.select("node", F.col("family").alias("band"), F.xxhash64("family", "fp").alias("own"))
    entries = marks.select("node", "band", F.col("own").alias("bucket")).unionByName(join_by_key(marks, centres, "own", marks.count()).select("node", "band", "bucket"))
    entries = written(entries, "bands")
    met = written(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("count")).filter("count > 1"), "buckets")
    total = met.agg(F.sum("count")).first()[0] or 0
    members = written(join_by_key(entries, met.withColumnRenamed("count", "n"), "bucket", total, met), "bucket-members")
    discard(entries)

    # The set that meets the most others is a bucket's centre: what copies were made of, rather than one of them.
    crowd = members.groupBy("node").agg(F.sum("n").alias("crowd"))
    centre = members.join(crowd, "node").groupBy("bucket").agg(F.max_by("node", F.struct("crowd", "node")).alias("v"))
    pairs = join_by_key(members.select("node", "bucket"), centre, "bucket", total, met).filter("node <> v")
    pairs = written(pairs.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct(), "near-pairs")
    found = _confirm(pairs, source, first, size, least)

    # Buckets that hold several classes still: what isn't of a bucket's largest class meets all that is of another class.
    joined = stars(found)
    # A bucket's sums by class: a large class is hot in neither.
    placed = members.join(joined, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("class"))
    parts = placed.groupBy("bucket", "class").count()
    mains = parts.groupBy("bucket").agg(F.max_by("class", F.struct("count", "class")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    # Both of two have met: one of them is the centre.
    mains = mains.filter("most < n AND n > 2").select("bucket", "main", F.ceil(F.col("n") / BLOCK).alias("n_all"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("n_rest"))
    mains = written(mains, "open-buckets")
    if mains.isEmpty():
        return found
    placed = written(join_by_key(written(placed, "open-members"), mains, "bucket", total, met), "open-placed")
    sets = _sets_of(placed.select("node").distinct(), source, first, size)
    placed = written(placed.join(nodes.select("node", "sketch"), "node").join(sets, "node"), "open-sets")
    # Both sides of a bucket come in blocks, and each block of one meets each block of the other in a task of its own.
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    columns = ["bucket", "rest_block", "block", "asks", "asked", "node", "class", "band", "sketch", "hashes"]
    rest = F.col("class") != F.col("main")
    asks = placed.filter(rest).withColumn("rest_block", own("n_rest")).withColumn("block", all_blocks("n_all")).withColumn("asks", F.lit(1)).withColumn("asked", F.lit(True))
    asked = placed.withColumn("block", own("n_all")).withColumn("rest_block", all_blocks("n_rest")).withColumn("asks", F.lit(0)).withColumn("asked", rest)
    dealt = asked.select(*columns).unionByName(asks.select(*columns)).repartition("bucket", "rest_block", "block").sortWithinPartitions("bucket", "rest_block", "block")
    more = written(dealt.mapInArrow(partial(_block_links, least=least), "u long, v long"), "open-links")
    discard(placed, members, mains, sets)
    return found.unionByName(more)


def _block_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (bucket, rest_block, block, asks, asked, node, class, band, sketch, hashes) that are sorted by the first three."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
        if not batch.num_rows:
            continue
        starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            key = tuple(keys[:, a].tolist())
            if key != held_key:
                yield _links_in_block(held, least)
                held, held_key = [], key
            held.append(batch.slice(a, b - a))
    yield _links_in_block(held, least)


def _links_in_block(parts: list[pa.RecordBatch], least: float) -> pa.RecordBatch:
    """Links between the asking rows of a block and the others: as many as join what is alike.

    A pair is looked at in the first family that links it, and only if its sketches leave room for the similarity.
    """
    found: list[tuple[int, int]] = []
    if parts:
        rows = pa.Table.from_batches(parts)
        asks, node, kind, band = (rows.column(c).to_numpy().copy() for c in ("asks", "node", "class", "band"))
        asked = rows.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        digits, simhash = sketch[:, :-8].reshape(-1, FAMILIES, DIGITS), sketch[:, -8:].copy().view(np.uint64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("hashes").to_pylist()]
        there = np.flatnonzero(asks == 0)
        for i in np.flatnonzero(asks == 1):
            # Two that both ask meet twice: once is enough.
            near = there[(kind[there] != kind[i]) & (~asked[there] | (node[there] < node[i]))]
            same = (digits[near] == digits[i]).sum(axis=2)
            enough = same.sum(axis=1) >= LEAST_ALIKE
            near, same = near[enough], same[enough]
            linked = np.hstack([same >= DIGITS - RADIUS, np.bitwise_count(simhash[near] ^ simhash[i]) <= RADIUS])
            near = near[linked[:, band[i]] & (linked.argmax(axis=1) == band[i])]
            for j in near[_alike(sets[i], [sets[j] for j in near], least)].tolist():
                if kind[j] != kind[i]:
                    found.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                    kind[kind == kind[j]] = kind[i]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the others have a similarity of ``least`` or more with the one; see ``similarity``."""
    if not others:
        return np.empty(0, dtype=bool)
    sizes = np.array([len(x) for x in others])
    if not len(one):
        return sizes == 0
    values = np.concatenate(others)
    hits = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    both = np.bincount(np.repeat(np.arange(len(others)), sizes), hits, minlength=len(others))
    return both / (len(one) + sizes - both) >= least


def near_classes(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), component_id and kept (the smallest document of its class) of every row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add("node", "long").add("marks", ArrayType(LongType())).add("sketch", "binary")
    rows = written(source.mapInArrow(partial(_nodes, size=size), schema), "shingle-nodes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    distinct = written(rows.groupBy("node").agg(F.min(first).alias("first"), F.first("marks").alias("marks"), F.first("sketch").alias("sketch")), "distinct-sets")
    holder = distinct.select("node", F.col("first.doc_id").alias("_d"), F.col("first.key").alias("_k"))
    joined = stars(near_links(distinct.select("node", "marks", "sketch"), source, holder, size, least))
    placed = distinct.join(joined, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    classes = written(placed.join(best, "root").select("node", "best"), "near-classes")
    rows = rows.select("doc_id", "key", "node")
    out = join_by_key(rows, classes, "node", rows.count())
    return out.select("doc_id", "key", F.col("best.doc_id").alias("component_id"), (first == F.col("best")).alias("kept"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, least: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the smallest document."""
    gone = near_classes(docs, size, least, doc_id, text).filter(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return without(docs, written(gone, "near-gone"), doc_id, text)
