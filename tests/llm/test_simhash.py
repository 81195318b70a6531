import random

import numpy as np
import pytest
import xxhash

from cellarium.llm import simhash as H
from cellarium.llm.components import stars

SCHEMA = "doc_id long, text string, _d string, row string"


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def classes(fps, radius=2):
    """Smallest position reachable, by comparing all pairs."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 4, 40, 400, 900)]
    out = [None, "", " \n\t", "ONE two", "one TWO", *base]
    for b in base:
        for _ in range(6):
            words = b.split()
            words[r.randrange(len(words))] = "changed"
            out.append(" ".join(words) + r.choice(["", " ", "\n"]))
    return out + ["É é ß", "é é ß", base[4], base[4], "a b c"]


def test_fingerprints(monkeypatch):
    for t in texts():
        assert H.fingerprint(t) == slow_fingerprint(t)
        assert H.fingerprint(t, 5) == slow_fingerprint(t, 5)
    monkeypatch.setattr(H, "WORD_BLOCK", 5)
    monkeypatch.setattr(H, "TEXT_BLOCK", 11)
    for t in texts():
        assert H.fingerprint(t) == slow_fingerprint(t)


def test_classes_like_brute_force(spark):
    rows = [(i * 3, t, "clash", "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in H.near_classes(df).collect()}
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    want = classes(fps)
    for (doc, *_), fp, root in zip(rows, fps, want, strict=True):
        assert out[doc].fp % (1 << 64) == fp
        assert out[doc].component_id == rows[root][0]
        assert out[doc].kept == (doc == rows[root][0])
    stay = H.near_dedup(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({rows[i][0] for i in want})
    assert H.near_dedup(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same words here", "", ""), (5, "same words here", "", ""), (5, "same words here", "", ""), (None, "other words there now", "", "")]
    out = H.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def cluster(n, seed):
    """Fingerprints in tight clusters, in Gray order."""
    g = np.random.default_rng(seed)
    base = g.integers(0, 1 << 63, n // 5 + 1, dtype=np.uint64)
    x = base[g.integers(0, len(base), n)]
    for _ in range(3):
        x = x ^ np.where(g.random(n) < 0.6, np.uint64(1) << g.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(x)


@pytest.mark.parametrize("n", [2, 3, 8, 9, 65, 700])
def test_index_search(n):
    x = cluster(n, n)
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    x = x[np.argsort(rank)]
    member, centre = H.links_of_node(x, 2)
    got = list(range(len(x)))
    for a, b in zip(member.tolist(), centre.tolist(), strict=True):
        got[a] = b
    assert got == classes([int(v) for v in x])


@pytest.mark.parametrize("limit", [2, 5, 2048])
def test_links_through_split_nodes(spark, limit):
    x = cluster(300, 17)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    joined = {r.node: r.root for r in stars(H.links(df, 2, limit)).collect()}
    fps = sorted(int(v) for v in x.view(np.int64))
    want = classes([v % (1 << 64) for v in fps])
    assert [joined.get(v, v) for v in fps] == [fps[i] for i in want]


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (300, 200), (7, 7)]
    out = {r.node: r.root for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def digit_classes(fps, width, radius=2):
    apart = lambda a, b: sum(((a ^ b) >> i & (1 << width) - 1) > 0 for i in range(0, 64 - width + 1, width))
    label, changed = list(range(len(fps))), True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if label[j] < label[i] and apart(fps[i], fps[j]) <= radius:
                    label[i], changed = label[j], True
    return label


def digit_cluster(n, seed):
    """Fingerprints of nine digits, some of which were drawn anew, in Gray order."""
    g = np.random.default_rng(seed)
    base = g.integers(0, 128, (n // 6 + 1, 9), dtype=np.uint64)
    x = np.where(g.random((n, 9)) < 0.25, g.integers(0, 128, (n, 9), dtype=np.uint64), base[g.integers(0, len(base), n)])
    x = np.unique((x << np.arange(0, 63, 7, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return x[np.argsort(rank)]


@pytest.mark.parametrize("n", [2, 9, 65, 300])
def test_index_search_by_digits(n):
    x = digit_cluster(n, n)
    member, centre = H.links_of_node(x, 2, 7)
    got = list(range(len(x)))
    for a, b in zip(member.tolist(), centre.tolist(), strict=True):
        got[a] = b
    assert got == digit_classes([int(v) for v in x], 7)


@pytest.mark.parametrize("limit", [2, 2048])
def test_families_through_split_nodes(spark, limit):
    families = [digit_cluster(150, 3), cluster(150, 4), digit_cluster(90, 5)]
    widths = (7, 1, 7)
    rows = [(k, int(v)) for k, x in enumerate(families) for v in x.view(np.int64)]
    links = H.family_links(spark.createDataFrame(rows, "family int, fp long"), widths, 2, limit).collect()
    for k, x in enumerate(families):
        fps = sorted(int(v) for v in x.view(np.int64))
        joined = {r.node: r.root for r in stars(spark.createDataFrame([(r.u, r.v) for r in links if r.family == k], "u long, v long")).collect()}
        want = digit_classes([v % (1 << 64) for v in fps], widths[k])
        assert [joined.get(v, v) for v in fps] == [fps[i] for i in want]


def test_majority_is_the_fingerprint():
    from cellarium.llm.near_copies import shingle_hashes

    for t in texts():
        assert H.majority(shingle_hashes(t)) == slow_fingerprint(t, 5)
