import random

import corpus_pipeline as P
from cellarium.llm import near_copies as N

SCHEMA = "doc_id long, text string, _d string, row string"


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(texts):
    """Smallest position reachable by similarities of 0.8 or more."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if root(i) != root(j) and alike(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(sets))]


def texts():
    """Copies with a few words changed, on both sides of 0.8, and a chain whose ends aren't alike."""
    r = random.Random(4)
    out = [None, "", " \n", "one TWO", "ONE two", "a b c"]
    for n in (30, 60, 200, 700):
        for _ in range(6):
            base = [f"w{r.randrange(2000)}" for _ in range(n)]
            out.append(" ".join(base))
            for k in range(5):
                words = list(base)
                for _ in range(max(1, n * (k + 1) // 150)):
                    words[r.randrange(n)] = "changed"
                out.append(" ".join(words).upper() if k == 2 else " ".join(words))
    chain = [f"c{i}" for i in range(400)]
    for k in range(12):
        out.append(" ".join(chain[10 * k : 10 * k + 250]))
    r.shuffle(out)
    return out


def test_classes_like_brute_force(spark):
    rows = [(3 * i, t, "clash", "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute([t for _, t, *_ in rows])
    assert {rows[w][0] for w in want} != {d for d, *_ in rows}
    out = {r.doc_id: r for r in N.near_classes(df).collect()}
    assert [out[d].component_id for d, *_ in rows] == [rows[w][0] for w in want]
    stay = N.near_dedup(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({rows[w][0] for w in want})
    assert N.near_dedup(df.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same words here", "", ""), (5, "same words here", "", ""), (5, "same words here", "", ""), (None, "other words there now", "", "")]
    out = N.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_pipeline_drops_what_the_fingerprint_of_op3_misses(spark):
    words = [f"w{i}" for i in range(120)]
    copy = ["x" if i in (20, 80) else w for i, w in enumerate(words)]
    assert 0.8 <= alike(shingle_set(" ".join(words)), shingle_set(" ".join(copy))) < 0.9
    df = spark.createDataFrame([(1, " ".join(words), "", ""), (2, " ".join(copy), "", "")], SCHEMA)
    assert [r.doc_id for r in P.drop_near_copies(spark, df, "").collect()] == [1]


def test_candidates_come_from_the_index_of_op3(spark, monkeypatch):
    """Without the links of the Gray index only texts of one fingerprint would meet: a pair that shares none is found through it alone."""
    r = random.Random(9)
    for _ in range(2000):
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        copy = ["x" if i in (20, 40) else w for i, w in enumerate(words)]
        marks = [N.minhash_digits(N.shingles(" ".join(t))) for t in (words, copy)]
        apart = (marks[0] != marks[1]).sum(axis=1)
        if apart.min() in (1, 2):
            break
    assert alike(shingle_set(" ".join(words)), shingle_set(" ".join(copy))) < 0.8 <= 1
    df = spark.createDataFrame([(1, " ".join(words), "", ""), (2, " ".join(copy), "", "")], SCHEMA)
    least = 0.6
    assert [x.component_id for x in N.near_classes(df, least=least).collect()] == [1, 1]
    monkeypatch.setattr(N, "family_links", lambda fps, widths: N.F.broadcast(fps.select("family", N.F.col("fp").alias("u"), N.F.col("fp").alias("v"))).filter("false"))
    assert sorted(x.component_id for x in N.near_classes(df, least=least).collect()) == [1, 2]
