import random

import pytest

from cellarium.llm import mixing as M


def targets(sizes):
    """Share by weight, cap, share the excess anew, until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, list(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: total * weight[s] / w for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
            open_.remove(s)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, _copies string, _k int")


def rows_of(seed, n=600):
    r = random.Random(seed)
    sources = ["a", "B", "é", "z", None, "", "big"]
    out = []
    for i in range(n):
        s = "big" if r.random() < 0.4 else r.choice(sources)
        out.append((i, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 3, 20, 60]))) + r.choice(["", " ", "\n"]), s, "c", 1))
    return out + [(7, None, "nul", "c", 1), (8, "", "nul", "c", 1), (9, "tie x", "a", "c", 1), (9, "tie x", "a", "c", 1), (None, "no id", None, "c", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = rows_of(seed)
    out = M.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want = targets(sizes)
    for s, t in want.items():
        mine = [r for r in out if r.source == s]
        assert all(abs(r.target - t) < 1e-6 * max(1, t) and r.source_size == sizes[s] for r in mine)
        largest = max(r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= largest / 2 + 1e-6
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    for s, t in want.items():
        mine = [r for r in out if r.source == s and r.size]
        level = level_of([r.size for r in mine], t)
        for r in mine:
            assert abs(r.expected - expected(level, r.size)) < 1e-6
            assert r.copies in (int(r.expected + 1e-9), int(r.expected + 1e-9) + (r.expected % 1 > 1e-9))
    again = M.mix(frame(spark, rows).repartition(3)).collect()
    pick = lambda rs: sorted((str(r.doc_id), r.key, r.taken) for r in rs)
    assert pick(out) == pick(again)


def expected(level, size):
    return min(2.0, level * 2 ** (0.5 * (size.bit_length() - 1)))


def level_of(sizes, target):
    """The level at which the expected copies of all documents have ``target`` words, by halving."""
    low, high = 0.0, 2.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * expected(mid, n) for n in sizes) < target else (low, mid)
    return high


def test_order_sampling_is_by_odds(spark):
    """Within a source those are taken once more whose random odds over inclusion odds are the smallest."""
    rows = [(i, "w " * (1 + i % 50), "a" if i % 3 else "b", "c", 1) for i in range(1200)]
    df = frame(spark, rows)
    draws = {r.doc_id: r.u for r in df.select("doc_id", M.unit(M.F.col("doc_id"), M.F.xxhash64("text"), M.F.lit(M.SEED)).alias("u")).collect()}
    out = M.mix(df).collect()
    for s in "ab":
        ranks = {True: [], False: []}
        for r in (r for r in out if r.source == s and r.expected % 1 > 1e-6):
            p, u = r.expected % 1, draws[r.doc_id]
            ranks[r.copies > int(r.expected)].append(u / (1 - u) / (p / (1 - p)))
        assert ranks[True] and ranks[False] and max(ranks[True]) < min(ranks[False])


def test_inclusion_rates_are_the_intended_ones(spark):
    """Over many draws each size's share of taken copies is near what was meant, and the sizes differ in it."""
    r = random.Random(3)
    rows = [(i, "w " * r.choice([1, 3, 9, 40, 150, 900]), "a" if i < 9000 else "b", "c", 1) for i in range(18000)]
    seen = {}
    for x in M.mix(frame(spark, rows), seed=5).collect():
        seen.setdefault((x.source, x.size), []).append((x.expected, x.copies))
    for (source, size), found in seen.items():
        p, n = found[0][0] % 1, len(found)
        got = sum(c for _, c in found) / n
        assert abs(got - found[0][0]) < 4.5 * (p * (1 - p) / n) ** 0.5 + 0.004, (source, size)
    rates = [seen["b", size][0][0] for size in (1, 3, 9, 40, 150, 900)]
    assert rates == sorted(rates) and rates[-1] > 3 * rates[0] > 0


def test_line_among_ties(spark):
    """Rows that are alike in doc_id and text share their fate; the source ends as near its target as that allows."""
    rows = [(1, "one two three", "a", "c", 1)] * 10 + [(i, "w x", "b", "c", 1) for i in range(100)]
    out = M.mix(frame(spark, rows)).collect()
    assert len({r.copies for r in out if r.source == "a"}) == 1
    again = M.repeat_documents(frame(spark, rows)).collect()
    assert len(again) == sum(r.copies for r in out)


def test_targets_of_many_sources(spark):
    """Ranges of sources are numbered as one order; the level is found whatever sources fill up first."""
    r = random.Random(8)
    sizes = {f"s{i:04d}": r.choice([0, 1, 5, 80, 4000]) for i in range(700)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    got = {r.source: r.target for r in M.source_targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_very_long_text(spark):
    out = {r.doc_id: r for r in M.mix(frame(spark, [(1, "long " * 400_000, "a", "c", 1), (2, "x", "b", "c", 1)])).collect()}
    assert out[1].size == 400_000 and out[1].taken <= 800_000


def test_repeated_rows_come_as_often_as_taken(spark):
    rows = [(i, "one two three", "a" if i % 3 else "b", "c", 1) for i in range(300)]
    df = frame(spark, rows)
    out = M.repeat_documents(df)
    assert out.columns == df.columns
    want = sum(r.copies for r in M.mix(df).collect())
    assert out.count() == want


def test_empty_and_wordless(spark):
    assert M.mix(frame(spark, [(1, "x", "a", "c", 1)]).limit(0)).count() == 0
    out = M.mix(frame(spark, [(1, " ", "a", "c", 1), (2, None, None, "c", 1)])).collect()
    assert [(r.taken, r.target) for r in out] == [(0, 0.0), (0, 0.0)]
