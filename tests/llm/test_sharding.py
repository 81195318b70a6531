import math
import zlib
from collections import Counter

import pytest
import xxhash

from cellarium.llm.sharding import HashTree, shard_documents


def draw(key, path):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return ((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / (1 << 53)


def place(tree, key):
    """Descend level by level, as the docstring says."""
    leaves = [x for x in tree.leaves if x.weight > 0]
    for name in (lambda x: x.region, lambda x: f"{x.region}/{x.rack}", lambda x: f"{x.region}/{x.rack}/{x.shard}"):
        groups = {}
        for x in leaves:
            groups.setdefault(name(x), []).append(x)
        best = min(groups, key=lambda p: -math.log(draw(key, p)) / sum(x.weight for x in groups[p]))
        leaves = groups[best]
    return leaves[0].shard


def frame(spark, n):
    rows = [(i * 7 - 50, f"text {i}", "clash", i) for i in range(n)] + [(None, None, "c", 1), (None, "", "c", 1), (3, "twice", "c", 1), (3, "twice", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")


def test_like_brute_force(spark):
    tree = HashTree.regular(4, 2, 5)
    out = shard_documents(frame(spark, 400), tree).collect()
    assert len(out) == 404
    for r in out:
        assert r.shard == place(tree, r.doc_id)
        assert r.grown_shard == place(tree.grown(), r.doc_id)
        assert r.law == "key"
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    text = next(r for r in out if r.doc_id == -50)
    assert (text.size, text.text_crc32) == (16 + 6, zlib.crc32(b"text 0"))
    assert Counter(r.size for r in out if r.doc_id is None) == {16: 2}


def test_growth_only_moves_into_the_new_shard():
    tree = HashTree.regular(4, 2, 5)
    for _ in range(3):
        grown = tree.grown()
        moved = [(place(tree, k), place(grown, k)) for k in range(4000)]
        new = len(tree.leaves)
        assert all(a == b or b == new for a, b in moved)
        assert 40 < sum(b == new for _, b in moved) < 200
        tree = grown


def test_a_changed_weight_keeps_other_subtrees():
    tree = HashTree.regular(3, 2, 3)
    heavy = tree.reweigh(4, 3.0)
    inside = {x.shard for x in tree.leaves if x.region == tree.leaves[4].region}
    for k in range(3000):
        a, b = place(tree, k), place(heavy, k)
        assert a == b or b in inside


def test_shares_follow_weights():
    tree = HashTree.regular(2, 2, 2).reweigh(0, 0.0).reweigh(7, 2.0)
    counts = Counter(place(tree, k) for k in range(8000))
    assert 0 not in counts
    assert abs(counts[7] / 8000 - 2 / 8) < 0.03
    with pytest.raises(ValueError):
        HashTree(()).levels()


def test_empty(spark):
    assert shard_documents(frame(spark, 1).limit(0), HashTree.regular(1, 1, 1)).count() == 0
