import random
import zlib

import numpy as np

from cellarium.llm import quality as Q

SCHEMA = "doc_id long, text string, score string, upper string"


def rows(n=700):
    r = random.Random(5)
    out, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 80))]
        good = r.random() < 0.8
        if not good:
            words = r.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "###" for x in w], lambda w: [w[0]] * 60])(words)
        out.append((i, " ".join(words), "clash", "clash"))
        labels.append((i, int(good), 0))
    return out, labels


def frames(spark, n=700):
    docs, labels = rows(n)
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_compiled_rules(spark):
    docs, labels = frames(spark)
    out = Q.score_documents(docs, labels).toPandas()
    truth = {i: y for i, y, _ in rows()[1]}
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    tested = out[out.held_out]
    assert (tested.predicted == [truth[i] for i in tested.doc_id]).mean() >= 0.97
    assert ((out.score >= 0) & (out.score <= 1) & (out.predicted == (out.score >= 0.3))).all()
    ensemble = Q.learn(Q.with_statistics(docs), labels)
    assert 0 < len(ensemble.rules) < 120
    assert np.allclose(ensemble.scores(out[Q.STATISTICS].to_numpy()), out.score, atol=1e-9)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = frames(spark, 300)
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    statistics = Q.with_statistics(docs)
    assert Q.learn(statistics, labels) == Q.learn(statistics, flipped)


def test_cases(spark):
    docs, labels = frames(spark, 300)
    odd = spark.createDataFrame([(1001, None, "c", "c"), (1002, "", "c", "c"), (1002, "", "c", "c"), (None, " \n", "c", "c"), (1005, "wörd " * 60000, "c", "c")], SCHEMA)
    strange = spark.createDataFrame([(5000, 1, 0), (1002, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    out = Q.score_documents(docs.unionByName(odd), labels.unionByName(strange)).collect()
    assert len(out) == 305 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 1002}) == 1
    none = Q.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    ones = Q.score_documents(docs, labels.filter("quality = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.9
    assert Q.score_documents(docs.limit(0), labels).count() == 0


def test_statistics_cover_the_whole_text():
    a, b = Q.text_statistics("word " * 50000), Q.text_statistics("word " * 50000 + "END!!")
    assert a != b and len(a) == len(Q.STATISTICS)
    assert Q.text_statistics(None) == Q.text_statistics("") == [0.0] * len(Q.STATISTICS)


def test_scores_like_brute_force(spark):
    """Rule by rule and row by row, from statistics that are computed anew."""
    docs, labels = frames(spark, 400)
    ensemble = Q.learn(Q.with_statistics(docs), labels)
    text = {i: t for i, t, *_ in rows(400)[0]}
    for r in Q.score_documents(docs, labels).collect():
        x, odds = Q.text_statistics(text[r.doc_id]), ensemble.intercept
        for rule, weight in zip(ensemble.rules, ensemble.weights, strict=True):
            holds = True
            for k, above, cut in rule:
                holds = holds and (x[k] > cut if above else x[k] <= cut)
            odds += weight if holds else 0.0
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-9


def test_statistics_like_brute_force():
    text = "One two TWO, three!! ###\n\nshort line\nOne two TWO, three!! ###\n" + "x" * 40 + " 123 é"
    got = dict(zip(Q.STATISTICS, Q.text_statistics(text), strict=True))
    data, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(c.isalpha() and c.isascii() for c in text) + sum(b > 127 for b in data)
    want = {
        "length": len(data), "words": len(words), "letters": letters / len(data), "upper": sum(c.isupper() for c in text) / letters, "digits": 3 / len(data), "bangs": text.count("!") / len(data),
        "wide": 2 / len(data), "word_length": sum(len(w.encode()) for w in words) / len(words), "distinct_words": len(set(words)) / len(words), "top_word": 2 / len(words), "long_words": 1 / len(words),
        "upper_words": 2 / len(words), "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines), "short_lines": sum(len(x.encode()) < 30 for x in lines) / len(lines),
    }
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_weights_are_the_lassos():
    """The optimum's conditions: no step along any rule lowers the penalised loss."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, len(Q.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5) | (r.random(600) < 0.1)).astype(float)
    rules, found = Q.grow_rules(x, y), Q.fit(x, y)
    weight = dict(zip(found.rules, found.weights, strict=True))
    error = found.scores(x) - y
    slopes = Q.rule_matrix(x, rules).T @ error / len(y)
    for rule, slope in zip(rules, slopes, strict=True):
        w = weight.get(rule, 0.0)
        assert abs(slope + Q.LASSO * np.sign(w)) < 3e-4 if w else abs(slope) < Q.LASSO + 3e-4
    assert abs(error.mean()) < 1e-3 and 0 < len(weight) < len(rules)


def test_a_repeated_doc_id_brings_no_more_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 50)
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append(len(y)) or Q.Ensemble(0.0, (), ()))
    docs, labels = frames(spark, 300)
    Q.learn(Q.with_statistics(docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id < 40"))), labels)
    assert 0 < seen[0] <= 50
