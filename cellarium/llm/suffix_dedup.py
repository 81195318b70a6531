"""Removal of repeated passages with merged Burrows-Wheeler transforms.

Every byte that a string of LENGTH bytes covers which also starts elsewhere goes.

1. Routing.  Each window of LENGTH bytes is told by its anchor: of the GRAM-byte strings in it
   the one whose hash is smallest, the leftmost of equals.  Equal windows have equal anchors at
   equal places, so they meet in the group of that anchor's hash, and each window is
   looked at in one group only.  The windows of one anchor overlap; the bytes they span are the
   anchor's context.  Groups with one occurrence repeat nothing.  Copies of a context (the same
   128 bits of two independent hashes, of its anchor and of its bytes) repeat in all their windows, and one of them stands for all.
2. Transforms.  What differs within a group (where repeats begin, end or are edited) is left.
   Contexts of a group are dealt to shards.  Symbols are strings of SYMBOL bytes, named within
   a task and compared byte by byte; a context is a set of strings of symbols, one for every
   phase, and DEPTH symbols are LENGTH bytes.  A shard's transform comes from its own
   suffixes; shards are then merged two by two: the interleave of the two transforms
   starts as one after the other and is refined once for every symbol of depth (all
   elements are dealt by the symbol before them, in the order of the round before).  The
   blocks that a round can't tell apart have that many symbols in common: after
   DEPTH rounds they are the repeated intervals, and no suffix has been sorted again.
3. Groups of more than GROUP_LIMIT contexts are dealt on to several tasks, by the bytes around the anchor: a window has
   at least half of its further bytes before what it is known to share, or else more than half behind it; that half is
   shared by the windows that meet next.  So each window goes to one part of one of two groups, equal windows to the same, and
   equal pieces become one.  Rounds go on until no group is crowded (in the eighth all LENGTH bytes are shared), and every
   part goes through the transforms like any other group.

Cases: null and empty texts have 0 bytes and the hash of nothing; texts shorter than LENGTH
keep all; matches never cross documents; rows repeated in full are occurrences of their
own, so they repeat each other; texts of any length are read in blocks that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.llm.common import bounded_batches, discard, documents, join_by_key, written

LENGTH = 200
GRAM = 64
WINDOW = LENGTH - GRAM + 1
SYMBOL = 50
DEPTH = LENGTH // SYMBOL
BLOCK = 1 << 16
GROUP_LIMIT = 4096
#: Elements that a task transforms and merges at once, and those of a shard.
LEAF = 1 << 18
SHARD = 1 << 17

_DRAWN = np.random.default_rng(20)
_LETTERS = _DRAWN.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all strings of a block from running sums: polynomials modulo 2 ** 64, then mixed."""

    def __init__(self, span: int):
        self.power = [_powers(b, span + 1) for b in _BASES]
        self.inverse = [_powers(pow(b, -1, 1 << 64), span + 1) for b in _BASES]

    def sums(self, part: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[which][part] * self.power[which][: len(part)], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        return _mixed((sums[end] - sums[begin]) * self.inverse[which][begin])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, from running minima of blocks of that width."""
    n = len(v) - width + 1
    blocks = np.concatenate([v, np.full(-len(v) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def text_anchors(data: bytes, rolling: Rolling) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """group, context, low, high of each anchor: hashes, and its first and last window."""
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = whole[at : at + BLOCK + LENGTH - 1]
        sums = rolling.sums(part, 0)
        n = len(part) - GRAM + 1
        gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * rolling.inverse[0][:n])
        # The place in the low bits makes the leftmost of equals the smallest.
        place = np.uint64((1 << 17) - 1)
        chosen = (_sliding_min((gram & ~place) | np.arange(n, dtype=np.uint64), WINDOW) & place).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])
        high = np.concatenate([low[1:] - 1, [len(chosen) - 1]])
        anchor = chosen[low]
        context = rolling.hashes(rolling.sums(part, 1), low, high + LENGTH, 1)
        context = _mixed(context + ((anchor - low) * 1024 + (high - low)).astype(np.uint64))
        yield gram[anchor].view(np.int64), context.view(np.int64), low + at, high + at


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, key, grp, ctx, low, high of every anchor of every document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BLOCK + LENGTH)
        for batch in batches:
            parts, owner = [], []
            for i, text in enumerate(batch.column(2)):
                data = (text.as_py() or "").encode()
                for found in text_anchors(data, rolling):
                    parts.append(found)
                    owner.append(np.full(len(found[0]), i))
            rows = pa.array(np.concatenate(owner) if owner else np.empty(0, np.int64))
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c) for c in columns[:2]], *[pa.array(c.astype(np.int32)) for c in columns[2:]]],
                ["doc_id", "key", "grp", "ctx", "low", "high"],
            )

    schema = docs.select("doc_id", "key").schema.add("grp", "long").add("ctx", "long").add("low", "integer").add("high", "integer")
    return docs.select("doc_id", "key", "text").mapInArrow(run, schema)


def _ordered(symbols: np.ndarray) -> np.ndarray:
    """The stable order of small numbers, by one sort of number and place together."""
    key = symbols.astype(np.uint64) << np.uint64(32) | np.arange(len(symbols), dtype=np.uint64)
    key.sort()
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _named(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers from 0, in the order of the keys."""
    order = np.argsort(key)
    fresh = np.concatenate([[False], key[order][1:] != key[order][:-1]])
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


class Symbols:
    """The elements of a set of contexts: all places 0 to its length of each; their symbols, and what precedes."""

    def __init__(self, contexts: list[bytes]):
        lengths = np.array([len(c) for c in contexts], dtype=np.int64)
        data = np.frombuffer(b"".join(contexts) + bytes(8), dtype=np.uint8)
        self.size = lengths + 1
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        begin = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.owner = np.repeat(np.arange(len(contexts)), self.size)
        self.place = np.arange(int(self.size.sum())) - begin[self.owner]
        self.length = lengths[self.owner]
        real = self.place + SYMBOL <= self.length
        at = (first[self.owner] + self.place)[real]
        rolling = Rolling(len(data))
        sums = rolling.sums(data, 0)
        name = _named(rolling.hashes(sums, at, at + SYMBOL, 0))
        # Names are hashes; what bears one name is compared with one bearer of it, eight bytes at a time.
        eight = np.zeros(len(data) - 7, dtype=np.uint64)
        for k in range(8):
            eight |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
        bearer = np.empty(name.max() + 1, dtype=np.int64)
        bearer[name] = at
        if not all((eight[at + k] == eight[bearer[name] + k]).all() for k in [*range(0, SYMBOL - 7, 8), SYMBOL - 8]):
            # Two symbols share a hash: these are named by their bytes.
            strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SYMBOL)[at]).view(f"V{SYMBOL}").ravel()
            name = np.unique(strings, return_inverse=True)[1].astype(np.int64)
        self.symbol = np.zeros(len(self.owner), dtype=np.int64)
        self.symbol[real] = name + 1
        back = self.place >= SYMBOL
        self.before = np.zeros_like(self.symbol)
        self.before[back] = self.symbol[np.flatnonzero(back) - SYMBOL]
        self.windows = self.place + LENGTH <= self.length

    def ranks(self, rows: np.ndarray) -> np.ndarray:
        """Of the elements ``rows`` (whole contexts): numbers in the order of their first DEPTH symbols."""
        rank, reach = self.symbol[rows], 1
        place, length = self.place[rows], self.length[rows]
        while reach < DEPTH:
            onward = np.zeros_like(rank)
            there = place + reach * SYMBOL <= length
            onward[there] = rank[np.flatnonzero(there) + reach * SYMBOL] + 1
            rank, reach = _named(rank * (len(rank) + int(self.symbol.max()) + 2) + onward), 2 * reach
        return rank


Transform = tuple[np.ndarray, np.ndarray]  # elements in the order of their suffixes, and the symbol before each


def transform(symbols: Symbols, rows: np.ndarray) -> Transform:
    elements = rows[_ordered(symbols.ranks(rows))]
    return elements, symbols.before[elements]


def merge(one: Transform, two: Transform) -> tuple[Transform, np.ndarray]:
    """The transform of both, and the blocks that DEPTH symbols don't tell apart."""
    n = len(one[0])
    before = np.concatenate([one[1], two[1]])
    second = np.zeros(len(before), dtype=bool)
    second[n:] = True
    block = np.zeros(len(before), dtype=np.int64)
    for _ in range(DEPTH):
        symbol = before[_taken(second, n)]
        order = _ordered(symbol)
        symbol, block, second = symbol[order], block[order], second[order]
        block = np.cumsum(np.concatenate([[False], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]))
    taken = _taken(second, n)
    return (np.concatenate([one[0], two[0]])[taken], before[taken]), block


def _taken(second: np.ndarray, n: int) -> np.ndarray:
    """The interleave as places in both transforms, one behind the other."""
    return np.where(second, np.cumsum(second) - 1 + n, np.cumsum(~second) - 1)


def repeated_windows(contexts: list[bytes]) -> tuple[Symbols, np.ndarray]:
    """The elements, and for each whether it begins a window that begins elsewhere in ``contexts``, too."""
    symbols = Symbols(contexts)
    shards = max(2, -(-len(symbols.owner) // SHARD))
    parts = [transform(symbols, np.flatnonzero(symbols.owner % shards == k)) for k in range(min(shards, len(contexts)))]
    block = np.arange(len(symbols.owner))
    while len(parts) > 1:
        merged = [merge(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
        block = merged[0][1]
        parts = [m[0] for m in merged] + parts[2 * len(merged) :]
    elements = parts[0][0]
    found = symbols.windows[elements]
    many = np.bincount(block[found], minlength=1)[block[found]] > 1
    out = np.zeros(len(elements), dtype=bool)
    out[elements[found][many]] = True
    return symbols, out


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, ctx, bytes) sorted by group and context; whole groups are gathered up to LEAF elements."""
    names = ["grp", "ctx", "first", "last"]
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def done(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns: list[list[int]] = [[], [], [], []]
        if len(rows) > 1:
            symbols, marks = repeated_windows([r[2] for r in rows])
            ends = np.cumsum(symbols.size)
            first, last = _runs(marks)
            owner = symbols.owner[first]
            begin = (ends - symbols.size)[owner]
            columns = [[rows[i][0] for i in owner], [rows[i][1] for i in owner], (first - begin).tolist(), (last - begin).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], names)

    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held and row[:2] == held[-1][:2]:
                continue  # the same context read from a row that is repeated in full
            if held and row[0] != held[-1][0]:
                if size >= LEAF:
                    yield done(held)
                    held, size = [], 0
            held.append(row)
            size += len(row[2]) + 1
    yield done(held)


def _anchor_place(part: np.ndarray, rolling: Rolling) -> int:
    """Where the anchor of a context's windows begins: the smallest hash of the first window's strings, the leftmost of equals."""
    n = WINDOW
    sums = rolling.sums(part[: n + GRAM - 1], 0)
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * rolling.inverse[0][:n])
    place = np.uint64((1 << 17) - 1)
    return int(((gram & ~place) | np.arange(n, dtype=np.uint64)).min() & place)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, ctx, core, shared, bytes), ``shared`` bytes from ``core`` on being in all windows of the group; -1: the anchor's.

    Gives (of_grp, of_ctx, shift, grp, ctx, core, shared, bytes): the windows with half of their other bytes before those, and the rest.
    """
    names = ["of_grp", "of_ctx", "shift", "grp", "ctx", "core", "shared", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    rolling = Rolling(2 * LENGTH)
    for batch in batches:
        out: list[tuple] = []
        for grp, ctx, core, shared, data in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if core < 0:
                core, shared = _anchor_place(np.frombuffer(data, dtype=np.uint8), rolling), GRAM
            half = -(-(LENGTH - shared) // 2)
            rest = LENGTH - shared - half + 1
            last = len(data) - LENGTH
            for side, low, high, begin, size in ((0, 0, min(last, core - half), core - half, shared + half), (1, max(0, core - half + 1), last, core, shared + rest)):
                if low <= high:
                    piece = data[low : high + LENGTH]
                    key = xxhash.xxh64_intdigest(data[begin : begin + size], (grp * 2 + side) & (1 << 64) - 1)
                    name = xxhash.xxh64_intdigest(piece, begin - low)
                    out.append((grp, ctx, low, _signed(key), _signed(name), begin - low, size, piece))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _leaf_runs(leaves: DataFrame) -> DataFrame:
    """grp, ctx, first, last: the windows that repeat within their group."""
    dealt = leaves.select("grp", "ctx", "bytes").repartition("grp").sortWithinPartitions("grp", "ctx")
    return dealt.mapInArrow(_leaves, "grp bigint, ctx bigint, first int, last int")


def repeated_runs(texts: DataFrame) -> DataFrame:
    """grp, ctx, first, last of the contexts ``texts`` (grp, ctx, size, bytes); ``size``: contexts of the group."""
    runs = written(_leaf_runs(texts.filter(F.col("size") <= GROUP_LIMIT)), "repeated-windows")
    crowded = texts.filter(F.col("size") > GROUP_LIMIT).dropDuplicates(["grp", "ctx"]).select("grp", "ctx", F.lit(-1).alias("core"), F.lit(-1).alias("shared"), "bytes")
    # Which piece of which context a part is.
    origin = None
    while not crowded.isEmpty():
        parts = written(crowded.mapInArrow(_halves, "of_grp bigint, of_ctx bigint, shift int, grp bigint, ctx bigint, core int, shared int, bytes binary"), "halves")
        part = parts.select("of_grp", "of_ctx", "shift", "grp", "ctx")
        if origin is not None:
            up = origin.select(F.col("grp").alias("of_grp"), F.col("ctx").alias("of_ctx"), F.col("of_grp").alias("_g"), F.col("of_ctx").alias("_c"), F.col("shift").alias("_s"))
            part = part.join(up, ["of_grp", "of_ctx"]).select(F.col("_g").alias("of_grp"), F.col("_c").alias("of_ctx"), (F.col("shift") + F.col("_s")).alias("shift"), "grp", "ctx")
        origin = written(part, "origins")
        pieces = origin.groupBy("grp", "ctx").agg(F.count(F.lit(1)).alias("n"))
        bodies = parts.groupBy("grp", "ctx").agg(F.min(F.struct("core", "shared", "bytes")).alias("b"))
        one = written(bodies.join(pieces, ["grp", "ctx"]).select("grp", "ctx", "n", "b.core", "b.shared", "b.bytes"), "pieces")
        sizes = one.groupBy("grp").agg(F.count(F.lit(1)).alias("count")).withColumn("size", F.col("count"))
        one = written(join_by_key(one, sizes.drop("count"), "grp", one.count(), sizes), "sized-pieces")
        # A piece of several contexts repeats whole; what meets no other piece is done.
        whole = one.filter("n > 1").select("grp", "ctx", F.lit(0).alias("first"), (F.octet_length("bytes") - LENGTH).alias("last"))
        found = written(_leaf_runs(one.filter((F.col("size") > 1) & (F.col("size") <= GROUP_LIMIT))).unionByName(whole), "part-windows")
        total = origin.count()
        met = join_by_key(origin, found, ["grp", "ctx"], total, pieces.withColumnRenamed("n", "count"))
        up = met.select(F.col("of_grp").alias("grp"), F.col("of_ctx").alias("ctx"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
        runs = runs.unionByName(written(up, "repeated-windows"))
        discard(parts, found)
        crowded = one.filter(F.col("size") > GROUP_LIMIT).select("grp", "ctx", "core", "shared", "bytes")
    return runs


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, first, last: ranges of the starts of repeated windows.  ``docs`` has doc_id, key, text."""
    found = written(anchors(docs), "anchors")
    groups = found.groupBy("grp").agg(F.count(F.lit(1)).alias("count"), (F.min("ctx") != F.max("ctx")).alias("several"))
    groups = written(groups.filter("count > 1"), "anchor-groups")
    repeated = written(join_by_key(found, groups.select("grp", "several"), "grp", found.count(), groups), "repeated-anchors")

    contexts = repeated.filter("several").groupBy("grp", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "low", "high")).alias("at"))
    contexts = written(contexts, "contexts")
    crowds = contexts.groupBy("grp").agg(F.count(F.lit(1)).alias("count")).withColumn("size", F.col("count"))
    wanted = join_by_key(contexts, crowds.drop("count"), "grp", contexts.count(), crowds).select(
        F.col("at.doc_id").alias("doc_id"), F.col("at.key").alias("key"), F.struct("grp", "ctx", F.col("at.low").alias("low"), F.col("at.high").alias("high"), "size").alias("piece")
    )
    texts = written(_pieces(docs, wanted), "context-texts")
    runs = repeated_runs(texts)

    # A context that occurs twice repeats whole; of the others the marked windows do.
    whole = contexts.filter("n > 1").select("grp", "ctx", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    partly = runs.join(contexts.filter("n = 1").select("grp", "ctx"), ["grp", "ctx"], "left_semi")
    marked = join_by_key(repeated.filter("several"), whole.unionByName(partly), ["grp", "ctx"], repeated.count(), contexts.withColumnRenamed("n", "count"))
    spans = marked.select("doc_id", "key", (F.col("low") + F.coalesce("first", F.lit(0))).alias("first"), F.coalesce(F.col("low") + F.col("last"), "high").alias("last"))
    alone = repeated.filter("NOT several").select("doc_id", "key", F.col("low").alias("first"), F.col("high").alias("last"))
    return spans.unionByName(alone)


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """grp, ctx, size, bytes of the wanted places, cut from the texts."""
    lists = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("piece").alias("pieces"))
    met = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["key"] == F.col("_k"))).select("text", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for text, pieces in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py().encode()
                rows += [(p["grp"], p["ctx"], p["size"], data[p["low"] : p["high"] + LENGTH]) for p in pieces.as_py()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays(columns, ["grp", "ctx", "size", "bytes"])

    return met.mapInArrow(run, "grp bigint, ctx bigint, size bigint, bytes binary")


def removed_ranges(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges [begin, end) of bytes that the windows starting in ``spans`` cover."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, n_bytes, kept (binary: the bytes that remain) and removed (ranges) of every row."""
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    spans = repeated_spans(rows)
    lists = spans.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    met = rows.join(lists, rows["doc_id"].eqNullSafe(F.col("_d")) & (rows["key"] == F.col("_k")), "left").select("doc_id", "key", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, removed = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3), strict=True):
                data = (text.as_py() or "").encode()
                ranges = removed_ranges([(s["first"], s["last"]) for s in spans.as_py() or []])
                at, parts = 0, []
                for a, b in ranges:
                    parts.append(data[at:a])
                    at = b
                sizes.append(len(data))
                kept.append(b"".join([*parts, data[at:]]))
                removed.append([{"begin": a, "end": b} for a, b in ranges])
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], ["doc_id", "key", "n_bytes", "kept", "removed"]
            )

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, n_bytes bigint, kept binary, removed array<struct<begin: bigint, end: bigint>>"
    return met.mapInArrow(run, schema)


def op6_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_bwt_merge_dedup": op6_bwt_merge_dedup}
ORACLE_SQL: dict[str, str] = {}
