import hashlib
import re

import pytest

from cellarium.llm import exact_dedup as X

ROWS = [
    (1, "a b", "x"), (2, "ab", "x"), (3, "a  b", "x"), (3, "a  b", "x"), (4, None, "y"), (5, " \t\n", "y"), (6, "", "y"), (7, "a\u00a0b", "z"),
    (8, "unique", "z"), (None, "null id", "z"), (9, "null id", "z"), (10, "word " * 50000, "w"), (11, "word" * 50000, "w"),
]
SCHEMA = "doc_id long, text string, _d string"


def brute(rows):
    groups = {}
    for i, (doc, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is not None, doc or 0, i))
    out = []
    for i, (doc, text, _) in enumerate(rows):
        n = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[n])
        out.append((doc, rows[best[3]][0], len(groups[n]), best[3] == i, hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_like_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    out = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.dedup(df).collect()]
    assert key(out) == key(brute(ROWS))


def test_rows_that_stay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    stay = X.keep_first(df)
    assert stay.columns == df.columns
    want = [r for r, b in zip(ROWS, brute(ROWS), strict=True) if b[3]]
    assert key(map(tuple, stay.collect())) == key(want)
    assert X.keep_first(df.limit(0)).count() == 0


def test_later_batches_meet_the_index(spark):
    index = X.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame(ROWS[:6], SCHEMA).coalesce(1)
    later = spark.createDataFrame([(20, "a   b", "x"), (21, "new", "x"), (22, "n e w", "x"), (23, "", "x")], SCHEMA)
    X.dedup(first, index).count()
    out = {r.doc_id: (r.keep_id, r.kept) for r in X.dedup(later, index).collect()}
    assert out == {20: (3, False), 21: (22, False), 22: (22, True), 23: (5, False)}
    assert index.rows().count() == 3
    assert X.DigestIndex(spark, index.path, 3).rows().count() == 3


def test_the_index_side_is_read_by_buckets(spark, monkeypatch):
    """The anti-join shuffles the batch alone."""
    index = X.DigestIndex(spark, buckets=4)
    plans = []
    kept = X.written
    monkeypatch.setattr(X, "written", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or kept(df, tag))
    X.dedup(spark.createDataFrame(ROWS, SCHEMA), index, name="a").count()
    X.dedup(spark.createDataFrame(ROWS, SCHEMA), index, name="b").count()
    plan = [p for tag, p in plans if tag == "digest-new"][-1]
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    right = plan[plan.rindex("FileScan") :]
    assert "Bucketed: true" in right and plan.count("Exchange hashpartitioning") == 1


def test_a_batch_that_runs_again_gives_the_same(spark):
    index = X.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(i, f"text {i}", "x") for i in range(200)], SCHEMA)
    later = spark.createDataFrame([(500 + i, f"text{150 + i}", "x") for i in range(100)], SCHEMA)
    kept = lambda df, name, at=index: sum(r.kept for r in X.dedup(df, at, name=name).collect())
    assert kept(first, "monday") == 200
    assert kept(first, "monday") == 200
    assert kept(later, "tuesday") == 50
    again = X.DigestIndex(spark, index.path)
    assert [kept(first, "monday", again), kept(later, "tuesday", again), kept(first, "wednesday", again)] == [200, 50, 0]
    assert again.rows().count() == 250
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(("digest_index_", "fresh_digest"))]


def test_a_job_that_fails_after_it_appended_is_run_again(spark):
    index = X.DigestIndex(spark, buckets=2)
    rows = spark.createDataFrame([(1, "one", "x"), (2, "o ne", "x"), (3, "two", "x")], SCHEMA)
    index.append(X.digests(rows), "job")
    index.append(X.digests(rows.limit(0)), "other")
    out = sorted((r.doc_id, r.keep_id, r.kept) for r in X.dedup(rows.repartition(3), index, name="job").collect())
    assert out == [(1, 2, False), (2, 2, True), (3, 3, True)]
    with pytest.raises(ValueError):
        index.append(X.digests(rows), "a'b")


def test_rows_that_differ_elsewhere_only(spark):
    rows = [(1, "same", "b"), (1, "same", "a"), (1, "same", None), (2, "other", "z")]
    for n in (1, 3):
        df = spark.createDataFrame(rows, SCHEMA).repartition(n)
        assert sorted(map(str, X.keep_first(df).collect())) == sorted(map(str, spark.createDataFrame([(1, "same", "a"), (2, "other", "z")], SCHEMA).collect()))


def test_a_reopened_index_keeps_its_buckets(spark):
    index = X.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(i, f"text {i}", "x") for i in range(40)], SCHEMA)
    X.dedup(first, index).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = X.DigestIndex(spark, index.path)
        assert again.buckets == 3
        later = spark.createDataFrame([(100 + i, f"te xt {i}", "x") for i in range(40)], SCHEMA)
        out = {r.doc_id: (r.keep_id, r.kept) for r in X.dedup(later, again).collect()}
        assert out == {100 + i: (i, False) for i in range(40)}
        assert again.rows().count() == 40
        with pytest.raises(ValueError):
            X.DigestIndex(spark, index.path, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
