import hashlib
import random
from collections import Counter

import pytest

from cellarium.llm import suffix_dedup as D

SCHEMA = "doc_id long, text string, key string, low int"


def brute(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def texts():
    r = random.Random(9)
    letters = "abcdefghij klmnop é\n"
    fresh = lambda n: "".join(r.choice(letters) for _ in range(n))
    passage, line = fresh(230), fresh(199)
    long = fresh(3000)
    edited = list(long)
    for at in (0, 260, 500, 900, 1801, 2700, 2999):
        edited[at] = "X"
    out = [None, "", "short", fresh(199), fresh(200), passage, passage[:199], fresh(50) + passage + fresh(77), passage + fresh(10), fresh(10) + passage, long, "".join(edited), long[700:1500]]
    out += [fresh(20) + line + "é", fresh(31) + line + "é", "that " * 200, "that " * 41, "a" * 1000, "a" * 200, "a" * 199]
    out += [fresh(300) + passage * 3 + fresh(5), long[1000:1199] + "!" + long[1200:1399]]
    return out + [long[300:600] + fresh(3) for _ in range(5)]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    out = D.remove_repeats(df).collect()
    got = sorted((str(r.doc_id), r.n_bytes, sum(x["end"] - x["begin"] for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == sorted((str(i), *b) for (i, _), b in zip(rows, brute([t for _, t in rows]), strict=True))


def test_like_brute_force(spark):
    check(spark, list(enumerate(texts())))


@pytest.mark.parametrize("limit", [1, 2, 4])
def test_crowded_groups(spark, monkeypatch, limit):
    """Groups that are dealt on give what the others give; at limit 1 all are, until their windows are told apart whole."""
    monkeypatch.setattr(D, "GROUP_LIMIT", limit)
    check(spark, list(enumerate(texts())))


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    """A hot group whose contexts all differ: the passage with other bytes before and behind it in each text."""
    monkeypatch.setattr(D, "GROUP_LIMIT", 8)
    r = random.Random(12)
    fresh = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, short = fresh(240), fresh(150)
    some = [fresh(r.randint(0, 90)) + passage + fresh(r.randint(0, 90)) for _ in range(40)] + [fresh(90) + short + fresh(90) for _ in range(40)]
    check(spark, list(enumerate(some + [x + "tail" for x in some[:6]])))


def test_symbols_that_share_a_hash(monkeypatch):
    """All strings get one of a few hashes: they are named by their bytes."""
    r = random.Random(7)
    base = "".join(r.choice("abc") for _ in range(500)).encode()
    contexts = [base[i : i + 260] for i in range(0, 200, 40)]
    want = D.repeated_windows(contexts)[1].tolist()
    plain = D.Rolling.hashes
    monkeypatch.setattr(D.Rolling, "hashes", lambda self, *a: plain(self, *a) % D.np.uint64(5))
    assert D.repeated_windows(contexts)[1].tolist() == want and any(want)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 512)
    monkeypatch.setattr(D, "LEAF", 300)
    monkeypatch.setattr(D, "SHARD", 200)
    check(spark, list(enumerate(texts())))


def test_repeated_rows_and_null_ids(spark):
    t = texts()
    check(spark, [(1, t[10]), (1, t[10]), (None, t[5]), (2, t[7]), (None, "x" * 150)])
    assert D.remove_repeats(spark.createDataFrame([(1, "x", "c", 1)], SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("shards", [2, 3, 7])
def test_merged_intervals(monkeypatch, shards):
    """Intervals do not depend on how contexts are dealt to shards."""
    r = random.Random(shards)
    base = "".join(r.choice("abcd") for _ in range(700))
    contexts = [base[i : i + r.randint(200, 330)].encode() for i in range(0, 360, 13)] + [("".join(r.choice("abcd") for _ in range(250))).encode()]
    monkeypatch.setattr(D, "SHARD", sum(len(c) + 1 for c in contexts) // shards)
    symbols, marks = D.repeated_windows(contexts)
    seen = Counter(c[i : i + 200] for c in contexts for i in range(len(c) - 199))
    want = [p + 200 <= len(contexts[o]) and seen[contexts[o][p : p + 200]] > 1 for o, p in zip(symbols.owner.tolist(), symbols.place.tolist(), strict=True)]
    assert marks.tolist() == want


def test_every_window_has_one_anchor():
    rolling = D.Rolling(D.BLOCK + D.LENGTH)
    r = random.Random(1)
    for n in (200, 201, 5000, D.BLOCK + 300):
        data = bytes(r.choice(b"ab ") for _ in range(n))
        spans = [(a, b) for _, _, low, high in D.text_anchors(data, rolling) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        assert sorted(i for a, b in spans for i in range(a, b + 1)) == list(range(n - 199))
