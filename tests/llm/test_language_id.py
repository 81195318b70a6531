import random
import zlib

import pytest
import zstandard

from cellarium.llm import language_id as L

WORDS = {
    "en": "the of and that with this from which their would about there could other into these people water great small".split(),
    "de": "der die und das nicht ein eine ich auf für werden über können schon zwischen straße während gegen immer großen".split(),
    "fr": "le la les des une dans pour qui avec sur être très où déjà même leurs après façon toujours peuple".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def rows(n=240, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", "fr"])
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.choice([8, 30, 200]))).capitalize() + ".", lang, "s", "clash"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def dictionaries(docs):
    return L.learn(docs)


def test_held_out_accuracy(docs, dictionaries):
    out = L.predict(docs, dictionaries).collect()
    truth = {i: lang for i, _, lang, *_ in rows()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)
    tested = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) >= 0.97 * len(tested)


def test_held_out_rows_teach_nothing(spark, docs, dictionaries):
    other = [(i, "zzz " * 50 if zlib.crc32(str(i).encode()) % 5 == 0 else t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else g, s, c) for i, t, g, s, c in rows()]
    assert L.learn(spark.createDataFrame(other, SCHEMA)) == dictionaries
    assert all(len(d) <= L.DICTIONARY_BYTES for d in dictionaries.values())


def test_cases(spark, dictionaries):
    cases = [(1, None, None, "s", "c"), (2, "", None, "s", "c"), (3, "123 !? ***", None, "s", "c"), (3, "123 !? ***", None, "s", "c"), (None, "über die Straße", None, None, "c"), (5, "the water and " * 30000, "de", "s", "c"), (6, "漢", None, "s", "c")]
    df = spark.createDataFrame(cases, SCHEMA)
    out = [(r.doc_id, r.lang_pred, r.score) for r in L.predict(df, dictionaries).collect()]
    assert sorted(map(str, out[:4])) == sorted(map(str, [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (3, "und", 0.0)]))
    told = {d: p for d, p, _ in out}
    assert told[None] == "de" and told[5] == "en" and told[6] in dictionaries
    stay = L.reject(df, dictionaries)
    assert stay.columns == df.columns
    assert {r.doc_id for r in stay.collect()} == {None, 5, 6}


def test_few_languages(spark, docs):
    assert {r.lang_pred for r in L.predict(docs, {}).collect()} == {"und"}
    assert L.learn(docs.limit(0)) == {}
    one = L.predict(docs, {"en": b"the of and"}).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}


def test_whole_texts_count(dictionaries):
    """What comes late in a long text decides too."""
    c = L.Classifier(dictionaries)
    assert c.classify("the water " * 50 + " ".join(WORDS["de"]) * 40)[0] == "de"


def test_narrow_margins_are_rejected_and_clean_texts_stay(spark, dictionaries):
    r = random.Random(9)
    noise = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(n))
    clean = lambda lang, n: " ".join(r.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, noise(n), "en", "noise", "c") for i, n in enumerate([20, 100, 500, 2000] * 10)]
    rows += [(100 + i, clean(lang, n), lang, "clean", "c") for i, (lang, n) in enumerate((g, n) for g in WORDS for n in (1, 2, 12, 100, 500, 2000) * 5)]
    rows += [(300 + i, clean("en", n) + " " + clean("de", n), "en", "mixed", "c") for i, n in enumerate([50, 200, 1000] * 10)]
    stay = [(x.doc_id, x.source) for x in L.reject(spark.createDataFrame(rows, SCHEMA), dictionaries).collect()]
    assert {s for _, s in stay} >= {"clean", "mixed"}
    assert {d for d, s in stay if s != "noise"} == {d for d, _, _, s, _ in rows if s != "noise"}
    # Some 1 in 100 noise texts passes by chance.
    assert sum(s == "noise" for _, s in stay) <= 2


def test_predictions_like_brute_force(spark, docs, dictionaries):
    """Every text compressed whole, piece by piece, with each dictionary by the library's plain calls."""
    p = zstandard.ZstdCompressionParameters(**L.PARAMETERS, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(data, content):
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(dict_data=given, compression_params=p).compress(data[i : i + L.PIECE])) for i in range(0, len(data), L.PIECE))

    text = {i: t for i, t, *_ in rows()}
    for r in L.predict(docs, dictionaries).collect():
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text[r.doc_id].lower()).split()
        sizes = sorted((size(" ".join(words).encode(), content), place, name) for place, (name, content) in enumerate(dictionaries.items()))
        assert r.lang_pred == sizes[0][2]
        margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        assert abs(r.margin - margin) < 1e-12 and abs(r.score - margin / (margin + L.HALF_MARGIN)) < 1e-12


def test_no_more_languages_than_the_bound(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    junk = spark.createDataFrame([(1000 + i, "x y z", f"junk{i}", "s", "c") for i in range(30)], SCHEMA)
    learned = L.learn(docs.unionByName(junk))
    assert len(learned) == 2 and "en" in learned


def test_rejection_of_an_empty_table(docs, dictionaries):
    assert L.reject(docs.limit(0), dictionaries).count() == 0 and L.reject(docs, {}).count() == 0
