import random
import re

import corpus_pipeline as P
from cellarium.llm import bpe, mixing
from tests.llm.test_simhash import classes, slow_fingerprint


def rows():
    r = random.Random(6)
    words = {"en": "the of and that with this from which would about people water".split(), "de": "der die und nicht eine werden über können zwischen während".split()}
    out = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        out.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "s", "er"]) for _ in range(r.choice([6, 40, 90]))), lang, f"s{i % 4}", 1))
    out += [(200 + i, out[i][1], "en", "s9", 1) for i in range(8)]
    out += [(300 + i, out[i][1].upper().replace(" ", "\n", 1), "en", "s8", 1) for i in range(8)]
    return out + [(400, "123 456 !!!", "en", "s1", 1), (401, None, None, None, None), (402, "", "en", "s1", 0), (None, "people about the water of this", None, None, 1)]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "exact", "near", "mix", "bpe"]
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, frames[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    columns = docs.columns
    assert all(f.columns == columns for f in frames[:-1])
    told, exact, near, mixed = ([tuple(r) for r in f.collect()] for f in frames[1:-1])

    text = {r[0]: r[1] for r in rows()}
    assert {r[0] for r in told} == {d for d, t in text.items() if re.search("[a-zA-Z]", t or "")}

    groups = {}
    for r in told:
        groups.setdefault("".join(r[1].split()), []).append(r)
    want = {min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()}
    # A null doc_id is smaller than any other here, but no text of it is repeated.
    assert set(exact) == want and len(exact) == len(want)

    ordered = sorted(exact, key=lambda r: (r[0] is None, r[0]))
    roots = set(classes([slow_fingerprint(r[1]) for r in ordered]))
    assert sorted(map(str, near)) == sorted(str(ordered[i]) for i in roots)

    copies = {r.doc_id: r.copies for r in mixing.mix(frames[3]).collect()}
    assert sorted(map(str, mixed)) == sorted(str(r) for r in near for _ in range(copies[r[0]]))

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        machine = bpe.Automaton(f.read())
    last = frames[-1].collect()
    assert len(last) == len(mixed)
    for r in last:
        assert machine.decode(r.ids) == text[r.doc_id] and r.n_tokens == len(r.ids)
    assert P.run(spark, str(tmp_path)).count() == len(last)


def run_stages(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, frames[-1], str(folder))
        out.write.parquet(f"{folder}/{i}")
        frames.append(spark.read.parquet(f"{folder}/{i}"))
    return frames


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_an_empty_table_goes_through(spark, tmp_path):
    frames = run_stages(spark, spark.createDataFrame([], SCHEMA), tmp_path)
    assert [f.count() for f in frames] == [0] * 6


def test_nulls_long_texts_repeated_rows_and_clashing_names(spark, tmp_path):
    """Columns that are named as the stages name their own are kept as they came."""
    long = " ".join(f"the water of {i % 977} people would" for i in range(60_000))
    rows = [(1, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (3, "", "en", "a", 1), (4, None, None, None, None), (None, "the people of the water", None, None, 2)]
    rows += [(5, "the same people would water the same", "en", "b", 3)] * 3 + [(6 + i, f"which people about that water number {i} " * 4, "en", "b", 1) for i in range(30)]
    extra = {"row": "r", "key": "k", "d": "d", "_d": "_d", "size": "s", "_s": "_s", "_c": "_c", "u": "u", "node": "n", "digest": "x", "told": "t", "copies": "c", "_copies": "cc"}
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, value in extra.items():
        docs = docs.withColumn(name, P.written.__globals__["F"].lit(value))
    frames = run_stages(spark, docs, tmp_path)
    assert all(f.columns == docs.columns for f in frames[:-1])
    for f in frames[1:-1]:
        assert all(r[name] == value for r in f.collect() for name, value in extra.items())
    assert {r.doc_id for r in frames[1].collect()} >= {1, 2, 5, None} and 4 not in {r.doc_id for r in frames[1].collect()}
    # Copies of a row are one row; the longer of two near copies goes, for its doc_id is greater.
    near = [r.doc_id for r in frames[3].collect()]
    assert near.count(5) == 1 and 1 in near and 2 not in near
    assert all(r.n_tokens > 0 for r in frames[-1].collect())
